"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. Each vector is described by its `nearest` pivots in
order of closeness and enters their inverted lists, separately for each label; vectors that share at least `shared`
pivots are candidates, met in the list of their least shared pivot only, and they alone are verified by cosine in double
precision.
Long lists are cut into blocks, and every two blocks of a list meet in one task, so no task holds a whole list and no
pair leaves a task: a task gives each vector's number of links and the least vector of its part of the component.
Equal vectors are one class, counted with its members.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label or a null
vec_id, link with nothing. Vectors of different dimension are not compared. Repeated rows are members of their class
each (equal vec_ids too). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_KEYS, by_key, lookup, matrix, stored, table
from tessera.llm.components import components

#: Pivots are 4 * sqrt(classes), within these bounds; the list of a pivot grows as the square root of the data.
MIN_PIVOTS, MAX_PIVOTS = 64, 16_384
#: Vectors of a block; two blocks meet in a task.
BLOCK = 512


def _unit(x: np.ndarray) -> np.ndarray:
    # components are scaled first, so squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pivot: int, shared: int, threshold: float, each: int = 1 << 15) -> np.ndarray:
    """Which rows of x and y share enough pivots, `pivot` being the least of them, and reach the cosine."""
    kinds = np.unique(np.concatenate([px.ravel(), py.ravel()]))

    def marks(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(kinds)), np.float32)
        out[np.arange(len(p))[:, None], np.searchsorted(kinds, p)] = 1
        return out

    a, b, less = marks(px), marks(py), int(np.searchsorted(kinds, pivot))
    found = a @ b.T >= shared
    if less:
        found &= a[:, :less] @ b[:, :less].T == 0
    row, column = np.nonzero(found)  # the candidates: only they are verified
    for at in range(0, len(row), each):
        i, j = row[at : at + each], column[at : at + each]
        found[i, j] = (x[i] * y[j]).sum(axis=1) >= threshold
    return found


def _apart(points: np.ndarray, most: int, close: float = 0.7) -> np.ndarray:
    """Up to `most` of the points, none close to an earlier one: a crowd of near copies must not share its lists out."""
    kept: list[int] = []
    for at in range(0, len(points), 1024):
        part = points[at : at + 1024]
        free = ~(part @ points[kept].T >= close).any(axis=1) if kept else np.ones(len(part), bool)
        inner = part @ part.T >= close
        for i in np.flatnonzero(free):
            if free[i] and len(kept) < most:
                kept.append(at + int(i))
                free &= ~inner[i]
    return points[kept]


def near_vectors(rows: DataFrame, threshold: float = 0.93, nearest: int = 8, shared: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the input. A null vec_id has a null component_id and kept."""
    single = rows.schema[embedding].dataType.simpleString() == "array<float>"  # floats travel as they are, the cosine is taken in double precision
    v = F.col("_v")
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("_v"), F.xxhash64(F.col(label).cast("string")).alias("_label"), F.col(label).isNotNull().alias("_has"))
    usable = F.col("_has") & F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = base.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    base = base.withColumns({"_k1": F.xxhash64("_v"), "_k2": F.xxhash64(F.lit(7), "_v"), "_dim": F.size("_v")})
    key = ["_label", "_dim", "_k1", "_k2"]
    classes = base.filter("_ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("_v").alias("_v"))
    # classes can have the same least id when ids repeat: a class is known by its number
    classes = table(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    linked = _index(classes, n, threshold, nearest, shared, block, "<f4" if single else "<f8") if n else rows.sparkSession.createDataFrame([], "c long, n long, comp long")
    linked = stored(linked, "vector-links")
    per = linked.rows.groupBy("c").agg(F.sum("n").alias("_n"))
    comp = components(linked.rows.filter("c <> comp").select(F.col("c").alias("a"), F.col("comp").alias("b")))
    comp = comp.join(classes.select(F.col("c").alias("id"), "rep"), "id")
    least = stored(comp.groupBy("component").agg(F.min("rep").alias("_least"), F.count("*").alias("n")), "vector-components")
    named = lookup(comp.select("id", "component"), least.rows, ["component"], "n").select(F.col("id").alias("c"), "_least")
    known = classes.select(*key, "c", "rep", "mult").join(per, "c", "left").join(named, "c", "left")
    links = (F.col("mult") - 1 + F.coalesce("_n", F.lit(0))).cast("long")
    known = table(known.select(*key, "mult", links.alias("n_links"), F.coalesce("_least", "rep").alias("component_id")), "vector-names")
    linked.drop()
    least.drop()
    out = lookup(base.filter("_ok").select("vec_id", *key), known, key, "mult").select("vec_id", "n_links", "component_id")
    alone = base.filter("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _index(classes: DataFrame, n: int, threshold: float, nearest: int, shared: int, block: int, kind: str) -> DataFrame:
    """c, n, comp: links found in each task, weighted by class size, and the least class of the linked ones there."""
    spark = classes.sparkSession
    n_pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << round(math.log2(4 * math.sqrt(n)))))
    sample = classes.orderBy("_k1", "_k2").limit(2 * n_pivots).select("_dim", "_v").toPandas()  # bounded by MAX_PIVOTS
    width = int(sample["_dim"].max())
    points = np.zeros((len(sample), width))
    for i, x in enumerate(sample["_v"]):
        points[i, : len(x)] = x
    points = _apart(_unit(points).astype(np.float32), n_pivots)
    nearest = min(nearest, len(points))
    shared = min(shared, nearest)
    given = spark.sparkContext.broadcast(points)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = [np.asarray(x, kind) for x in part.column(4).to_pylist()]
                dense = np.zeros((len(lists), width), np.float32)
                for i, x in enumerate(lists):
                    dense[i, : min(width, len(x))] = _unit(x[None].astype(float))[0][:width]
                close = dense @ points.T
                top = np.argpartition(-close, nearest - 1, axis=1)[:, :nearest]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1), 1).astype("<i4")
                perms = pa.array(list(top), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), perms, pa.array([x.tobytes() for x in lists], pa.binary())], ["_label", "_dim", "c", "mult", "perm", "vec"])

    described = classes.select("_label", "_dim", "c", "mult", "_v").mapInArrow(describe, "_label long, _dim int, c long, mult long, perm array<int>, vec binary")
    described = table(described, "vector-permutations")
    # two vectors that share `shared` pivots share one of the lists without each one's last shared - 1 (by number)
    lists = F.slice(F.array_sort("perm"), 1, nearest - shared + 1)
    key = ["_label", "_dim", "pivot"]
    postings = described.withColumn("pivot", F.explode(lists))
    long = table(postings.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_g")).filter("_g > 1"), "long-lists")
    number = long.limit(HOT_KEYS + 1).count()
    cells = postings.join(F.broadcast(long) if number <= HOT_KEYS else long, key, "left") if number else postings.withColumn("_g", F.lit(1))
    cells = cells.withColumn("_g", F.coalesce("_g", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("c", F.lit(3)), F.col("_g")).cast("int"))
    cells = cells.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    cells = cells.select(*key, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "c", "mult", "perm", "vec")
    grouped = [*key, "_i", "_j"]
    cells = cells.repartition(*grouped).sortWithinPartitions(*grouped)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, pivot, i, j), rows in by_key(batches, 5):
            if rows.num_rows < 2:
                continue
            of = rows.column("_b").to_numpy()
            first, second = np.flatnonzero(of == i), np.flatnonzero(of == j)
            c, mult = rows.column("c").to_numpy(), rows.column("mult").to_numpy()
            perm, vec = np.array(rows.column("perm").to_pylist(), np.int32), _unit(matrix(rows.column("vec"), kind).astype(float))
            hit = _links(vec[first], vec[second], perm[first], perm[second], pivot, shared, threshold)
            if i == j:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            count = np.zeros(len(c), np.int64)
            np.add.at(count, first, hit @ mult[second])
            if i != j:
                np.add.at(count, second, hit.T @ mult[first])
            least = c.copy()
            while True:  # the least class within reach in this cell
                before = least.copy()
                far = np.where(hit, least[second][None, :], np.iinfo(np.int64).max)
                least[first] = np.minimum(least[first], far.min(axis=1))
                far = np.where(hit, least[first][:, None], np.iinfo(np.int64).max)
                least[second] = np.minimum(least[second], far.min(axis=0))
                if (least == before).all():
                    break
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(count[some]), pa.array(least[some])], ["c", "n", "comp"])

    return cells.mapInArrow(verify, "c long, n long, comp long")
