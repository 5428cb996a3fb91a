"""Document fingerprints by content-defined chunking.

Chunk boundaries are where a gear hash of the last 16 bytes is small: rarely small enough before the normal chunk
size, often beyond it (normalised chunking), so an insertion moves only the boundaries near it. A fingerprint is the
set of a text's chunk digests with their lengths; the likeness of two fingerprints is the bytes of their common chunks
over the bytes of the lesser set (containment, 0 to 1).

A fingerprint is hexadecimal: the sorted 64-bit entries, each 48 bits of digest and 16 bits of length. Null texts are
empty; an empty text's fingerprint is empty; two empty fingerprints are alike (1), an empty one is unlike any other
(0). `edited_neighbours` pairs documents in ascending doc_id (an integer; nulls first); rows with equal doc_id follow
each other in the order of a hash of their text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import random_words

LEAST, NORMAL, MOST = 16, 48, 256
#: Of 65536: chance of a boundary before and beyond the normal size.
STRICT, LOOSE = 512, 4096
GEAR = (random_words(256, 4) >> np.uint64(32)).astype(np.uint32)
#: Documents of one segment; a segment is a unit of the shuffle. More segments than this make segments larger.
SEGMENT_ROWS, MAX_SEGMENTS = 2000, 65_536


def _candidates(raw: np.ndarray) -> tuple[list[int], list[int]]:
    h = GEAR[raw]
    for s in (1, 2, 4, 8):  # doubles the window each time: 16 bytes
        longer = h.copy()
        longer[s:] += h[:-s] << np.uint32(s)
        h = longer
    z = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
    loose = np.flatnonzero(z < LOOSE)
    return loose[z[loose] < STRICT].tolist(), loose.tolist()


def chunk_entries(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The sorted distinct entries (48 bits of digest, 16 of length) of each text's chunks."""
    joined = b"".join(texts)
    strict, loose = _candidates(np.frombuffer(joined, np.uint8)) if joined else ([], [])
    out, end = [], 0
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        start, end = end, end + len(text)
        entries = []
        while start < end:
            cut = min(start + MOST, end)
            k = bisect_left(strict, start + LEAST - 1)
            if k < len(strict) and strict[k] < start + NORMAL:
                cut = min(cut, strict[k] + 1)
            else:
                k = bisect_left(loose, start + NORMAL)
                if k < len(loose):
                    cut = min(cut, loose[k] + 1)
            entries.append(digest(joined[start:cut]) >> 16 << 16 | cut - start)
            start = cut
        out.append(np.unique(np.array(entries, np.uint64)))
    return out


def fingerprint(entries: np.ndarray) -> str:
    return entries.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    length = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return length(np.intersect1d(a, b, assume_unique=True)) / min(length(a), length(b))


def edit(text: str, following: str) -> str:
    """The last half of text replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to segments of consecutive ids (of one id with very many texts: of consecutive text hashes); the
    first ones of a segment also go to the segment before (that of the first segment is the last), so texts are shuffled
    once and each segment is walked in order. Only rows equal in id and text always share a segment.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    rows = rows.select("doc_id", "_t", F.coalesce("doc_id", F.lit(-(2**63))).alias("_o"), F.xxhash64("_t").alias("_x"))
    count = rows.count()
    n = min(MAX_SEGMENTS, max(1, count // SEGMENT_ROWS))
    cuts: list[int] = []
    if n > 1:
        cuts = rows.agg(F.percentile_approx("_o", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(max(10_000, 40 * n))).alias("p")).head()["p"]
    segment_of = F.pandas_udf(_segments(np.array(cuts, np.int64)), "long")
    firsts = rows.select("_o", "_x").withColumn("_s", segment_of("_o", "_x")).groupBy("_s").agg(F.min(F.struct("_o", "_x")).alias("f")).orderBy("_s").collect()  # a row per segment
    segment_before = F.pandas_udf(_before(*(np.array(v, np.int64) for v in ([r["_s"] for r in firsts], [r["f"]["_o"] for r in firsts], [r["f"]["_x"] for r in firsts]))), "long")
    dealt = rows.withColumn("_s", segment_of("_o", "_x")).withColumn("_p", segment_before("_s", "_o", "_x"))
    homes = F.array_compact(F.array(F.struct(F.col("_s").alias("s"), F.lit(False).alias("tail")), F.when(F.col("_p") >= 0, F.struct(F.col("_p").alias("s"), F.lit(True).alias("tail")))))
    dealt = dealt.select(F.explode(homes).alias("_h"), "doc_id", "_t", "_o", "_x").select("_h.s", "_h.tail", "doc_id", "_t", "_o", "_x")
    dealt = dealt.repartition("s").sortWithinPartitions("s", "tail", "_o", "_x").select("s", "tail", "doc_id", "_t")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _stretches(batches):
            yield _compare(ids, texts)

    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _segments(cuts: np.ndarray):
    """Segments between cuts of the ids; an id that is r cuts at once has r segments of equal ranges of the text hash."""
    ids, times = np.unique(cuts, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(times)])

    def of(order: pd.Series, mark: pd.Series) -> pd.Series:
        o, x = order.to_numpy(), mark.to_numpy()
        if not len(ids):
            return pd.Series(np.zeros(len(o), np.int64))
        k = np.searchsorted(ids, o, side="right")
        own = np.maximum(k - 1, 0)
        inside = np.minimum((x.astype(float) / 2.0**64 + 0.5) * times[own], times[own] - 1).astype(np.int64)
        return pd.Series(np.where((k > 0) & (ids[own] == o), upto[own] + 1 + inside, upto[k]))

    return of


def _before(segments: np.ndarray, first: np.ndarray, mark: np.ndarray):
    """For the first rows of a segment the segment before it (before the first one: the last), for others -1."""

    def of(segment: pd.Series, order: pd.Series, x: pd.Series) -> pd.Series:
        at = np.searchsorted(segments, segment.to_numpy())
        return pd.Series(np.where((first[at] == order.to_numpy()) & (mark[at] == x.to_numpy()), segments[at - 1], -1))

    return of


def _stretches(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of neighbouring documents, the texts with the following one at the end."""
    ids: list = []
    texts: list[str] = []
    size, now, over = 0, None, False
    for batch in batches:
        for segment, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                now, over = segment, False
            elif over:
                continue
            text = text or ""
            texts.append(text)
            if tail:
                over = True
                yield ids, texts
                ids, texts, size = [], [], 0
                continue
            if size > limit and ids:
                yield ids, texts
                ids, texts, size = [], [text], 0
            ids.append(doc_id)
            size += len(text)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    raw = [t.encode() for t in edited]
    own = chunk_entries([t.encode() for t in texts])
    changed = chunk_entries(raw)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
        "fingerprint": [fingerprint(x) for x in own[:-1]],
        "edited_fingerprint": [fingerprint(x) for x in changed],
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
    })
