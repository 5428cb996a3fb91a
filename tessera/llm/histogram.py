"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Documents are encoded in Arrow batches; each batch gives one row per length, so the only shuffle moves partial
counts. Length n is the number of ids. With docs_at_least(n) and tokens_below(n), a context limit L keeps
tokens_below(n) + L * docs_at_least(n) tokens in truncated documents, n being the least length >= L.

Nulls and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import running, table
from tessera.llm.tokens import default_path, encode


def encoded_lengths(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """length, n_docs: partial counts, one row per length and batch."""
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(len(ids) for ids in encode(batch.column(0).to_pylist(), path))
            yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "length long, n_docs long")


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per length that occurs.

    length, n_docs, n_tokens (in documents of this length), docs_at_least, tokens_at_least (in documents of this
    length or more), docs_below, tokens_below, truncated_tokens (all documents cut to `length` tokens).
    """
    hist = table(encoded_lengths(docs, text, tokenizer).groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    hist = hist.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "_b": -F.shiftright("length", 8)})
    out = running(hist, [], "_b", [F.desc("length")], {"docs_above": F.col("n_docs"), "tokens_above": F.col("n_tokens")})
    total = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_tokens"))
    out = out.crossJoin(F.broadcast(total))  # one row
    at_least = F.col("docs_above") + F.col("n_docs")
    tokens_at_least = F.col("tokens_above") + F.col("n_tokens")
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("_docs") - at_least).alias("docs_below"),
        (F.col("_tokens") - tokens_at_least).alias("tokens_below"),
        (F.col("_tokens") - tokens_at_least + F.col("length") * at_least).alias("truncated_tokens"),
    )


def at_limits(hist: DataFrame, limits: Iterable[int]) -> DataFrame:
    """context_limit, truncated_tokens, docs_cut (documents longer than the limit) for each stated limit; no limits give no rows."""
    none = hist.sparkSession.createDataFrame([], "context_limit long, truncated_tokens long, docs_cut long")
    rows = [none, *(hist.agg(
        F.lit(int(n)).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.least("length", F.lit(n)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(F.col("length") > n, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    ) for n in limits)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def quantiles(hist: DataFrame, probs: Iterable[float]) -> DataFrame:
    """prob, length: the least length that at least ceil(prob * documents) documents don't exceed; no probabilities give no rows."""
    out = hist.sparkSession.createDataFrame([], "prob double, length long")
    for p in probs:
        need = F.ceil(F.lit(float(p)) * (F.col("docs_below") + F.col("docs_at_least")))
        row = hist.filter(F.col("docs_below") + F.col("n_docs") >= need).agg(F.lit(float(p)).alias("prob"), F.min("length").alias("length"))
        out = out.union(row)
    return out
