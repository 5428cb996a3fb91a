"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from a text's bytes, words and lines in numpy, many texts at once. Trees are grown on the
driver from a bounded sample of labelled rows (`max_labelled`, the least by a hash of doc_id), on features cut into
quantile bins, and flattened into arrays; every task then walks all rows through all trees at once. No text is
shuffled: the sample's ids are broadcast (at most max_labelled rows) and scoring is a single scan.

Labels of rows with crc32(doc_id as text) mod 3 = 1 are held out. Null labels are ignored, repeated ones count as the
greatest. Null and empty texts are scored from their (zero) statistics; a null doc_id hashes as the empty text. Without
labels of both kinds the score is their mean, or 0.5 without any. Repeated rows are scored each; an empty table gives
no rows; labels, lang, source and doc_id are no inputs of a score and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_slices
from tessera.llm.kernels import LOWER, NEWLINE, SPACE, distinct, grams, hash_runs, runs

MAX_LABELLED = 20_000
_SIGNS = b".,!?|*$%&#;:-_/()<>{}[]=+@~^\"'\\`"


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    per = np.bincount(doc_of * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    some = np.maximum(size, 1)
    low = LOWER[raw]
    starts, ends, doc = runs(low, offsets, SPACE)
    length = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    at_least = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / at_least
    hashes = hash_runs(low, starts, ends)
    kinds = np.bincount(distinct(hashes, doc)[1], minlength=n)
    triples, owner = grams(hashes, doc, n, 3)
    different = np.bincount(distinct(triples, owner)[1], minlength=n)
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    first, last = raw[starts], raw[ends - 1] if len(ends) else raw[:0]
    upper = (raw >= 0x41) & (raw <= 0x5A)
    shout = np.add.reduceat(upper.astype(np.int64), starts) if len(starts) else np.zeros(0)
    signs = np.add.reduceat((~letter[raw] & ~SPACE[raw] & ~((raw >= 0x30) & (raw <= 0x39))).astype(np.int64), starts) if len(starts) else np.zeros(0)
    ls, le, ld = runs(low, offsets, NEWLINE)
    lines = np.bincount(ld, minlength=n).astype(float)
    line_kinds = np.bincount(distinct(hash_runs(low, ls, le), ld)[1], minlength=n)
    some_lines = np.maximum(lines, 1)
    share = lambda x: np.bincount(doc, x, n) / at_least
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), mean,
        np.sqrt(np.maximum(np.bincount(doc, length * length, n) / at_least - mean * mean, 0)),
        size / some_lines, words / some_lines,
        per[:, 0x41:0x5B].sum(1) / some, per[:, 0x61:0x7B].sum(1) / some, per[:, 0x30:0x3A].sum(1) / some,
        per[:, 0x80:].sum(1) / some, per[:, SPACE].sum(1) / some, per[:, NEWLINE].sum(1) / some,
        kinds / at_least, different / np.maximum(np.bincount(owner, minlength=n), 1), line_kinds / some_lines,
        share(length <= 3), share(length >= 12), share(shout >= np.maximum(length - 2, 1)), share(signs >= 2), share(signs == length),
        share((first >= 0x41) & (first <= 0x5A)), share(~letter[last] if len(last) else np.zeros(0)), share(SPACE[last] if len(last) else np.zeros(0)),
        per[:, [0x2E, 0x21, 0x3F]].sum(1) / at_least, per.max(1) / some,
        *[per[:, c] / some for c in _SIGNS],
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(columns)))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth, flattened: node k of a tree has children 2k + 1 and 2k + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(feature))]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Fit by Newton steps on binned features; a split needs `least` of hessian on either side."""
    mean = float(y.mean()) if len(y) else 0.5
    inner = 2**depth - 1
    if len(y) == 0 or mean in (0.0, 1.0):
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(mean / (1 - mean))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    cells = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin k: x <= edge k
    n_features = x.shape[1]
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    columns = np.arange(n_features) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (n_features * bins) + columns + cells).ravel()
            shape = (width, n_features, bins)
            gs = np.bincount(at, np.repeat(g, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, c = divmod(int(best[k]), bins)
                if gain[k, f, c] > 1e-9 and c < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, depth, np.array(features), np.array(thresholds), np.array(values))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from the labelled rows that are not held out, at most max_labelled of them."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.select("_y", "_text", "_id", F.xxhash64("_text").alias("_h"))
    kind = dict(rows.dtypes)["_id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column(1)):
                x = statistics(raw, offsets)
                known = [batch.column(k).slice(i, j - i) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*known, pa.array(list(x), pa.list_(pa.float64()))], ["y", "id", "h", "x"])

    # an id that repeats counts once, with the text of the least hash: at most max_labelled rows reach the driver
    found = rows.mapInArrow(measure, f"y double, id {kind}, h long, x array<double>")
    found = found.groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("r.y", "r.x").toPandas()
    if not len(found):
        return grow(np.zeros((0, 1)), np.zeros(0))
    x, y = np.stack(found["x"].to_numpy()), found["y"].to_numpy()
    order = np.lexsort((*x.T[:6], y))  # the order of rows must not matter
    return grow(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with a column quality_score (0 to 1), the last one; a column of that name in docs is replaced."""
    docs = docs.drop("quality_score")
    columns = docs.columns
    at = columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [trees.score(statistics(raw, offsets)) for _, _, raw, offsets in text_slices(batch.column(at))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*columns, "quality_score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(apply, StructType(docs.schema.fields[:]).add("quality_score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    trees = train(docs, labels, text=text, doc_id=doc_id, max_labelled=max_labelled)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    columns = ids.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [trees.score(statistics(raw, offsets)) for _, _, raw, offsets in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    scored = ids.select(*columns).mapInArrow(apply, f"doc_id {ids.dtypes[0][1]}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
