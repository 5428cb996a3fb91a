"""Line dedup by pairwise alignment.

A document is aligned with these earlier ones, and no others:

1. the first document (least doc_id) that has one of its lines, for each line that is not blank;
2. the first document that has one of its windows: a window is the shortest run of consecutive lines, from a line on or
   back to it, with at least `min_chars` characters and a line that is not blank (a shorter text is one window);
3. every earlier document that shares a rare line with it, one that at most RARE documents have.

So the pairs of a document are bounded by its own lines, however many documents share one: a divider in a million pages
makes a million pairs, all with the first page. Pairs are not made in rounds, and what one alignment deletes does not change
another.

Pairs are aligned by patience diff over line hashes; aligned blocks of consecutive lines with at least `min_chars`
characters are deleted from the later document; a copy of the earlier document goes whole. All decisions are taken on the input texts.

Null ids take no part, null texts have no lines and stay null. Rows with equal ids are never compared with each other;
equal rows get equal results. Empty texts and an empty table give the same back. Other columns are kept by
`remove_aligned` and can have any name that does not start with an underscore; those named like one that it adds
(lines_total, lines_removed, aligned_with) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, deal, lookup, mix, stored, table

#: Documents that a rare line has at most; multiplier of the window hashes (odd).
RARE = 8
_BASE = 0x9E3779B97F4A7C15


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both: equal ends first, then lines unique on both sides, recursively."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a = {x for x, n in Counter(a[i:i_end]).items() if n == 1}
        once_b = {x for x, n in Counter(b[j:j_end]).items() if n == 1}
        both = once_a & once_b
        if not both:
            continue
        place = {b[q]: q for q in range(j, j_end) if b[q] in both}
        found = [(p, place[a[p]]) for p in range(i, i_end) if a[p] in both]
        # the longest chain that also increases in b
        tails: list[int] = []
        at: list[int] = []
        previous = [-1] * len(found)
        for k, (_, q) in enumerate(found):
            n = bisect_left(tails, q)
            previous[k] = at[n - 1] if n else -1
            if n == len(tails):
                tails.append(q)
                at.append(k)
            else:
                tails[n], at[n] = q, k
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(found[k])
            k = previous[k]
        chain.reverse()
        p, q = i, j
        for x, y in chain:
            todo.append((p, x, q, y))
            pairs.append((x, y))
            p, q = x + 1, y + 1
        todo.append((p, i_end, q, j_end))
    pairs.sort()
    return pairs


def removable(a: Sequence[int], b: Sequence[int], sizes: Sequence[int], min_chars: int) -> list[int]:
    """Lines of b in aligned blocks of at least min_chars characters; all lines if a has the same ones."""
    if a == b:
        return list(range(len(b)))
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= min_chars:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def windows(h: np.ndarray, n: np.ndarray, full: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, last line) of the shortest windows of min_chars characters, not all blank, from and back to each line.

    A text with fewer characters is one window.
    """
    size = len(h)
    chars, some = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(full)])
    if not some[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if chars[-1] < min_chars:
        start, end = np.array([0]), np.array([size])
    else:
        at = np.arange(size + 1)
        ahead = np.maximum(np.searchsorted(chars, chars + min_chars), np.searchsorted(some, some + 1))
        back = np.minimum(np.searchsorted(chars, chars - min_chars, "right"), np.searchsorted(some, some - 1, "right")) - 1
        start, end = np.concatenate([at[ahead <= size], back[back >= 0]]), np.concatenate([ahead[ahead <= size], at[back >= 0]])
        start, end = np.divmod(np.unique(start * (size + 1) + end), size + 1)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate([one, np.full(size, _BASE, np.uint64)]))
        inverse = np.cumprod(np.concatenate([one, np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)) * power[:-1])])
        key = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return key.view(np.int64), start, end - 1


def _windows(base: DataFrame, kind: str, min_chars: int) -> DataFrame:
    """_id, _x, _w, _s, _e: hash, first and last line of each document's windows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            found = [windows(*(c[i:j] for c in columns), min_chars) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(w[0]) for w in found]))
            key, start, end = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["_id", "_x", "_w", "_s", "_e"])

    return base.select("_id", "_x", "_h", "_n", "_full").mapInArrow(apply, f"_id {kind}, _x long, _w long, _s int, _e int")


def _aligned(pairs: DataFrame, content: DataFrame, kind: str, min_chars: int) -> DataFrame:
    """_id, _x, _fid, _fx, _l: places of lines that go from a document by its alignment with an earlier one.

    The later documents of an earlier one follow it in a task, so its lines are there once; of a passage's first holder,
    which can be in very many pairs, in several tasks.
    """
    key = ["_fid", "_fx"]
    often = pairs.groupBy(*key).agg(F.count("*").alias("n"))
    earlier = content.select(F.col("_id").alias("_fid"), F.col("_x").alias("_fx"), "_h", "_n").join(often.select(*key), key, "left_semi")
    later, earlier = deal(pairs, earlier, key, often)
    later = later.join(content, ["_id", "_x"]).select(*key, "_part", F.lit(True).alias("_later"), "_id", "_x", "_h", "_n")
    earlier = earlier.select(*key, "_part", F.lit(False).alias("_later"), F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("long").alias("_x"), "_h", "_n")
    both = later.unionByName(earlier).repartition(*key, "_part").sortWithinPartitions(*key, "_part", "_later")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = []
        for batch in batches:
            own = batch.column(3).to_pylist()
            (lines, at), (sizes, _) = (_values(batch.column(c)) for c in (6, 7))
            found: list[list[int]] = []
            for i in range(batch.num_rows):
                these = lines[at[i] : at[i + 1]].tolist()
                if not own[i]:
                    first = these
                found.append(removable(first, these, sizes[at[i] : at[i + 1]].tolist(), min_chars) if own[i] else [])
            hit = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(hit) for c in (4, 5, 0, 1)), pa.array([f for f in found if f], pa.list_(pa.int32()))], ["_id", "_x", "_fid", "_fx", "_l"])

    return both.mapInArrow(align, f"_id {kind}, _x long, _fid {kind}, _fx long, _l array<int>")


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _pairs(content: DataFrame, kind: str, min_chars: int) -> Stored:
    """_id, _x, _fid, _fx: the pairs of documents (rows of content) that are aligned."""
    hashes = F.array_distinct(F.transform(F.filter(F.arrays_zip("_h", "_full"), lambda z: z["_full"]), lambda z: z["_h"]))
    own = content.select("_id", "_x", F.explode(hashes).alias("_key"))
    first = lambda rows: rows.groupBy("_key").agg(F.min(F.struct("_id", "_x")).alias("_first"), F.max("_id").alias("_most"), F.count("*").alias("n")).filter("_first._id < _most")
    lines = stored(first(own).withColumn("_holders", F.col("n")), "line-firsts")
    met = stored(lookup(own, lines.rows, ["_key"]), "line-met")
    places = stored(_windows(content, kind, min_chars).select("_id", "_x", F.col("_w").alias("_key")).distinct(), "line-places")
    several = stored(first(places.rows), "line-several")
    shared = lookup(places.rows, several.rows, ["_key"])
    firsts = met.rows.select("_id", "_x", "_first").unionByName(shared.select("_id", "_x", "_first")).filter(F.col("_first._id") < F.col("_id"))
    rare = met.rows.filter(F.col("_holders") <= RARE).select("_key", "_id", "_x")
    earlier = rare.select("_key", F.col("_id").alias("_fid"), F.col("_x").alias("_fx"))
    among = rare.join(earlier, "_key").filter("_fid < _id")  # RARE rows of a key at most
    pairs = firsts.select("_id", "_x", F.col("_first._id").alias("_fid"), F.col("_first._x").alias("_fx")).unionByName(among.select("_id", "_x", "_fid", "_fx"))
    out = stored(pairs.distinct(), "line-pairs")
    for t in (lines, met, places, several):
        t.drop()
    return out


def removals(docs: DataFrame, min_chars: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, _x (xxhash64 of the text), _lines (places of deleted lines), _partners (earlier documents aligned with deletions)."""
    kind = dict(docs.select(F.col(doc_id)).dtypes)[doc_id]
    lines = F.split(F.col("_t"), "\n", -1)
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).filter("_id is not null and _t is not null")
    base = base.select(
        "_id",
        F.xxhash64("_t").alias("_x"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_h"),
        F.transform(lines, lambda x: F.length(x)).alias("_n"),
        F.transform(lines, lambda x: F.length(F.trim(x)) > 0).alias("_full"),
    )
    content = stored(base.dropDuplicates(["_id", "_x"]), "lines")
    pairs = _pairs(content.rows, kind, min_chars)
    cut = _aligned(pairs.rows, content.rows.select("_id", "_x", "_h", "_n"), kind, min_chars)
    gone = cut.groupBy("_id", "_x").agg(F.array_distinct(F.flatten(F.collect_list("_l"))).alias("_lines"), F.count("*").alias("_partners"))
    out = table(gone, "line-removals")
    content.drop()
    pairs.drop()
    return out


def remove_aligned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with aligned lines deleted from text; adds lines_total, lines_removed, aligned_with (earlier documents)."""
    docs = docs.drop("lines_total", "lines_removed", "aligned_with")
    columns = docs.columns
    gone = removals(docs, text=text, doc_id=doc_id, **options).withColumnRenamed("_id", "_rid").withColumnRenamed("_x", "_rx")
    joined = docs.join(gone, docs[doc_id].eqNullSafe(F.col("_rid")) & (F.xxhash64(docs[text]) == F.col("_rx")), "left")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_lines", i.cast("int")))
    new_text = F.when(F.col("_lines").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines_total"),
        F.coalesce(F.array_size("_lines"), F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce("_partners", F.lit(0)).cast("long").alias("aligned_with"),
    )
