"""Ranked search: inverse document frequency summed over matched terms, a cap per file, the top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import TokenConfig
from tessera.functions.text import text_tokens
from tessera.operators.blocks import unpacked
from tessera.operators.index import Index

TOP_K, MAX_PER_FILE = 20, 2
#: Ranges of chunk ids that candidates are looked up by, at most; scores that differ by less count as equal.
RANGES, CLOSE = 4096, 1e-9


def query_terms(spark: SparkSession, q: str, config: TokenConfig) -> list[str]:
    """The distinct tokens of a query, by the same expression as the index."""
    return spark.range(1).select(text_tokens(F.lit(q), config).alias("t")).head()["t"]


def idf(n_chunks: int, df: F.Column) -> F.Column:
    return F.log1p(F.lit(n_chunks) / df)


def _summed(hits: DataFrame) -> DataFrame:
    """chunk_id, score, why of hits (chunk_id, term, idf): frequencies added in term order, so equal matches score equally."""
    matched = hits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("m"))  # at most the query's terms
    return matched.select("chunk_id", F.aggregate("m", F.lit(0.0), lambda a, x: a + x["idf"]).alias("score"), F.transform("m", lambda x: x["term"]).alias("why"))


def _weighed(hits: DataFrame, weights: DataFrame) -> DataFrame:
    return hits.join(F.broadcast(weights), "term")  # a row per query term


def scores(postings: DataFrame, n_chunks: int, terms: list[str]) -> DataFrame:
    """chunk_id, score, why of every chunk that has a term of the query."""
    hits = postings.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return _summed(_weighed(hits, df.select("term", idf(n_chunks, F.col("df")).alias("idf"))))


def top(scored: DataFrame, top_k: int = TOP_K, max_per_file: int = MAX_PER_FILE) -> DataFrame:
    """At most max_per_file rows of a path, then the best top_k; ties by chunk_id.

    Spark limits the rows of a path before it shuffles them (a group limit), so no task orders all hits of a path.
    """
    k, per = limits(top_k, max_per_file)
    best = Window.partitionBy("path").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= per).drop("_r").orderBy(F.desc("score"), "chunk_id").limit(k)


def limits(top_k: int, max_per_file: int) -> tuple[int, int]:
    return min(top_k, TOP_K) if top_k > 0 else TOP_K, max_per_file if max_per_file > 0 else MAX_PER_FILE


@dataclass(frozen=True)
class Pruned:
    """What a search reads: `essential` terms in full, of the `other` terms the blocks `needed`; hits: chunk_id, term, idf."""

    essential: list[str]
    other: list[str]
    needed: DataFrame | None
    hits: DataFrame


def prune(index: Index, terms: list[str], n_chunks: int, top_k: int = TOP_K, max_per_file: int = MAX_PER_FILE, path: str = "path") -> Pruned:
    """The hits that can be among the best top_k.

    A term adds the same to every chunk that has it, so the best that a chunk without the rarest terms can reach is the sum of
    the others' weights. Terms are added from the rarest on until the k-th best chunk so far (the cap per file observed)
    lies above that sum: then every result has one of these essential terms. Chunks that have one but could not reach
    the k-th best either are left out, and of the other terms only blocks are read that cover a chunk which is left.
    """
    spark = index.chunks.sparkSession
    k, per = limits(top_k, max_per_file)
    found = index.terms.filter(F.col("term").isin(terms)).select("term", "df", idf(n_chunks, F.col("df")).alias("idf")).collect()  # the query's terms
    known = sorted(found, key=lambda r: (-r["idf"], r["term"]))
    weights = spark.createDataFrame([(r["term"], r["idf"]) for r in known], "term string, idf double")
    read = lambda rows: _weighed(unpacked(rows), weights)
    names, worth, df = ([r[c] for r in known] for c in ("term", "idf", "df"))
    for j in range(1, len(known)):
        rest = sum(worth[j:])
        if sum(df[:j]) < k or sum(worth[:j]) <= rest + CLOSE:
            continue  # the k-th best can't lie above the rest
        hits = read(index.blocks.filter(F.col("term").isin(names[:j])))
        partial = _summed(hits).join(index.chunks.select("chunk_id", F.col(path).alias("path")), "chunk_id", "left")
        best = top(partial, k, per).select("score").collect()  # k rows
        if len(best) < k or best[-1]["score"] <= rest + CLOSE:
            continue
        left = partial.filter(F.col("score") + rest >= best[-1]["score"] - CLOSE).select("chunk_id")
        width = n_chunks // RANGES + 1
        at = sorted(r[0] for r in left.select(F.floor(F.col("chunk_id") / width)).distinct().collect())  # at most RANGES + 1
        covers = F.exists(F.array(*[F.lit(b).cast("long") for b in at]), lambda b: (b >= F.floor(F.col("first_id") / width)) & (b <= F.floor(F.col("last_id") / width)))
        needed = index.blocks.filter(F.col("term").isin(names[j:])).filter(covers)
        return Pruned(names[:j], names[j:], needed, hits.unionByName(read(needed)).join(left, "chunk_id", "left_semi"))
    return Pruned(names, [], None, read(index.blocks.filter(F.col("term").isin(names))))


def search(index: Index, q: str, config: TokenConfig | None = None, top_k: int = TOP_K, max_per_file: int = MAX_PER_FILE, n_chunks: int | None = None) -> DataFrame | None:
    """chunk_id, path, start_line, end_line, score, snippet, why; None if the query has no tokens or the index no chunks."""
    spark = index.chunks.sparkSession
    terms = query_terms(spark, q, config or TokenConfig())
    n = index.chunks.count() if n_chunks is None else n_chunks
    if not terms or not n:
        return None
    matched = scores(index.postings, n, terms) if index.blocks is None else _summed(prune(index, terms, n, top_k, max_per_file).hits)
    found = matched.join(index.chunks, "chunk_id", "left")
    checked = found.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("missing chunk "), F.col("chunk_id").cast("string"))).cast("string")))
    return top(checked, top_k, max_per_file).select("chunk_id", "path", "start_line", "end_line", "score", "snippet", "why")
