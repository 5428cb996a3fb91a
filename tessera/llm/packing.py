"""Packing by cutting-stock column generation.

Documents are encoded and cut at multiples of the context length, so only remainders need packing. Their lengths,
rounded up to `unit` tokens, form a histogram with at most context / unit classes. The linear program of the cutting
stock problem (fewest sequences that hold all pieces) is solved over that histogram by column generation: a revised
simplex whose new patterns are priced by unbounded-knapsack dynamic programming. Patterns are rounded down, what is
left is packed first-fit-decreasing, and every piece finds its place from its rank in its class. What the driver
holds (histogram, patterns) is bounded by the context length, never by the corpus.

A null or empty text has just the end token. Repeated rows are packed each. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, running, table
from tessera.llm.tokens import default_path, encode


def pieces(docs: DataFrame, context: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode documents and cut them at multiples of the context length.

    doc_id, start, length, ids_crc32, doc_tokens; with_ids adds the ids themselves. A null or empty text gives one piece,
    its end token; repeated rows and null ids give pieces each; other columns are not read.
    """
    path = tokenizer or default_path()
    schema = f"doc_id {dict(docs.select(F.col(doc_id)).dtypes)[doc_id]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, start, length, crc, total, kept = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist(), path)):
                ids = np.concatenate([ids, end]).astype("<u4")
                for at in range(0, len(ids), context):
                    piece = ids[at : at + context]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(piece.tolist())
            out = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's best value, and the copies of each size that give it."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            values = best[c - s[:n]] + p[:n]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], choice[c] = values[k], k
    copies, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            copies[order[choice[c]]] += 1
            c -= s[choice[c]]
    return float(best[capacity]), copies


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most: int = 6000) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as columns, their fractional uses, a lower bound) of the cutting-stock linear program."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    uses, bound = inverse @ demand, 0.0
    for _ in range(most):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, copies = knapsack(sizes, np.maximum(prices, 0), capacity)
        bound = max(bound, uses.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or uses.sum() - bound <= gap * bound:
            break
        column = inverse @ copies
        able = column > 1e-9
        ratios = np.full(m, np.inf)
        ratios[able] = uses[able] / column[able]
        leave = int(ratios.argmin())
        step = ratios[leave]
        uses = np.maximum(uses - step * column, 0)
        uses[leave] = step
        row = inverse[leave] / column[leave]
        inverse -= np.outer(column, row)
        inverse[leave] = row
        patterns[:, leave] = copies
    return patterns.astype(np.int64), uses, bound


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(uses, {class: copies}) that hold exactly the demand: rounded-down patterns, then first fit decreasing."""
    if not len(sizes):
        return []
    patterns, uses, _ = column_generation(sizes, demand.astype(float), capacity)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-uses):
        column = patterns[:, j]
        times = int(uses[j] + 1e-7)
        held = column > 0
        times = min([times, *(left[held] // column[held]).tolist()]) if held.any() else 0
        if times > 0:
            left -= times * column
            out.append((times, {int(i): int(column[i]) for i in np.nonzero(held)[0]}))
    room: list[int] = []
    filled: list[dict[int, int]] = []
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                filled.append({})
            room[at] -= int(sizes[i])
            filled[at][int(i)] = filled[at].get(int(i), 0) + 1
    return out + [(1, f) for f in filled]


def pack(cut: DataFrame, context: int = 2048, unit: int = 4) -> DataFrame:
    """Assign pieces (doc_id, start, length, ids_crc32, ...) to sequences: adds sequence_id and offset.

    Null ids are like others; equal pieces are placed each, in any order among themselves. No pieces give no rows.
    """
    spark = cut.sparkSession
    units = context // unit
    cut = cut.withColumn("_c", F.ceil(F.col("length") / unit).cast("int"))
    hist = {r["_c"]: r["n"] for r in cut.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # at most `units` rows
    sizes = np.array(sorted(hist), np.int64)
    plan = whole_patterns(sizes, np.array([hist[s] for s in sizes], np.int64), units)
    runs, taken, sequence = [], dict.fromkeys(range(len(sizes)), 0), 0
    for times, content in plan:
        slot = 0
        for i in sorted(content, reverse=True):
            n = content[i]
            runs.append((int(sizes[i]), taken[i], taken[i] + n * times, sequence, n, slot))
            taken[i] += n * times
            slot += n
        sequence += times
    # the runs of a class as arrays in ascending order of _lo; a row looks its run up, so no row meets other runs
    by_class = {}
    for c, lo, _, seq, copies, slot in sorted(runs):
        for column, v in zip(by_class.setdefault(c, ([], [], [], [])), (lo, seq, copies, slot), strict=True):
            column.append(v)
    table_of_runs = spark.createDataFrame([(c, *v) for c, v in by_class.items()], "_c int, _lo array<long>, _seq array<long>, _n array<long>, _slot array<long>")
    n = buckets_for(sum(hist.values()))
    mark = F.xxhash64("doc_id", "start", "ids_crc32")
    ranked = cut.withColumns({"_h": mark, "_b": F.pmod(mark, F.lit(n))})
    ranked = running(ranked, ["_c"], "_b", [F.col("_h"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")], {"_rank": F.lit(1)})
    placed = ranked.join(F.broadcast(table_of_runs), "_c")  # at most `units` rows; runs are bounded by the patterns
    at = F.size(F.filter("_lo", lambda lo: lo <= F.col("_rank"))) - 1
    placed = placed.withColumn("_k", at).withColumns({name: F.get(F.col(name), F.col("_k")) for name in ("_lo", "_seq", "_n", "_slot")})
    at = F.col("_rank") - F.col("_lo")
    placed = placed.withColumns({"sequence_id": F.col("_seq") + F.floor(at / F.col("_n")), "_slot": F.col("_slot") + at % F.col("_n")})
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.drop("_c", "_h", "_b", "_rank", "_k", "_lo", "_seq", "_n", "_slot")


def pack_documents(docs: DataFrame, context: int = 2048, end_id: int = 1, unit: int = 4, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack: one row per piece, with sequence_id and offset; with_ids keeps the ids."""
    cut = table(pieces(docs, context, end_id, text, doc_id, tokenizer, with_ids), "pieces")
    return pack(cut, context, unit)
