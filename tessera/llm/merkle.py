"""Merkle manifest of a dataset: a tree of digests for each group, a tree over the groups' roots, a proof for each row.

The tree is built by keyed combining. Nodes are dealt by blocks of consecutive places; in a task, a partial parent
accumulates the digests of its children by their place and, as soon as it has as many as its place and the group's size say,
becomes a node itself, which is an event for the next parent. What a block can't settle, its top, is the frontier: one node
for each block goes to the next round, dealt again, until a single node of the group is left. Parents know their children, so
following these links back down gives every node that came in the other children on its way to the top: its proof inside
the block. Proofs of the rounds are joined from the top down, where a node has at most a block of nodes below it.

Digests are lower-case hexadecimal SHA-256 of the concatenated inputs. A field is '-' if null, else its number of UTF-8 bytes,
':' and the value. A parent is the digest of up to `arity` consecutive nodes, the last one of what is left; a lone node is
the root itself. Rows of a group ascend by the order column (nulls first), then by digest; groups by name (null first).

Repeated rows are leaves each. Empty and long texts are fields like others. An empty table gives no rows. Only the named
fields are read; other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.llm.common import Stored, by_key, lookup, running, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a block at most.
BLOCK = 256
PATH = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


class Partial:
    """The partial parents of a block, and the links from each node to its siblings."""

    def __init__(self, size: int, level: int, arity: int):
        self.size, self.arity, self.base = size, arity, level
        self.parents: dict[tuple[int, int], dict[int, str]] = {}
        self.siblings: dict[tuple[int, int], tuple[str, str]] = {}

    def count(self, level: int) -> int:
        return -(-self.size // self.arity**level)

    def add(self, place: int, value: str, top: int) -> str | None:
        """A node of the base level comes in; the digest of the top, once it is known."""
        level = self.base
        while level < top and self.count(level) > 1:
            up = place // self.arity
            children = self.parents.setdefault((level, up), {})
            children[place] = value
            if len(children) < min(self.arity, self.count(level) - up * self.arity):
                return None
            order = sorted(children)
            digests = [children[p] for p in order]
            for i, p in enumerate(order):
                self.siblings[level, p] = "".join(digests[:i]), "".join(digests[i + 1 :])
            value = hashlib.sha256("".join(digests).encode()).hexdigest()
            del self.parents[level, up]
            level, place = level + 1, up
        return value

    def path(self, place: int, top: int) -> list[tuple[str, str]]:
        out, level = [], self.base
        while level < top and self.count(level) > 1:
            out.append(self.siblings[level, place])
            level, place = level + 1, place // self.arity
        return out


def _round(nodes: DataFrame, level: int, depth: int, arity: int, carried: Sequence[str]) -> DataFrame:
    """nodes (g, size, place, digest, carried) of a level with path (siblings in their block), block and top (its digest)."""
    span = arity**depth
    rows = nodes.select("g", F.floor(F.col("place") / span).cast("long").alias("block"), "size", "place", "digest", *carried)
    schema = StructType(rows.schema.fields[:]).add("path", PATH).add("top", StringType())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for _, part in by_key(batches, 2):
            places, digests = part.column("place").to_pylist(), part.column("digest").to_pylist()
            partial, top = Partial(part.column("size")[0].as_py(), level, arity), None
            for p, d in zip(places, digests, strict=True):
                top = partial.add(p, d, level + depth) or top
            paths = [partial.path(p, level + depth) for p in places]
            flat = [x for p in paths for x in p]
            both = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], ["before", "after"])
            found = pa.ListArray.from_arrays(np.cumsum([0, *map(len, paths)]).astype(np.int32), both)
            table = part.append_column("path", found).append_column("top", pa.array([top] * len(places), pa.string()))
            held += table.combine_chunks().to_batches()
            if len(held) >= 64:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "place").mapInArrow(combine, schema)


def grow(nodes: DataFrame, largest: int, arity: int = 2, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[Stored]]:
    """(nodes with path, roots, tables that both are read from): the trees over nodes (g, size, place from 0, digest), the largest of `largest` nodes.

    path holds for each level the siblings' digests before and after the node, joined; roots has g, size and root.
    """
    depth, span = 1, arity
    while span * arity <= BLOCK:
        depth, span = depth + 1, span * arity
    rounds, level, left = [], 0, largest
    while True:
        rounds.append(stored(_round(nodes, level, depth, arity, carried if not level else ()), "merkle-round"))
        left, level = -(-left // span), level + depth
        if left <= 1:
            break
        first = rounds[-1].rows.filter(F.col("place") == F.col("block") * span)
        nodes = first.select("g", "size", F.col("block").alias("place"), F.col("top").alias("digest"))
    roots = rounds[-1].rows.filter("place = 0").select("g", "size", F.col("top").alias("root"))
    path = rounds[-1].rows
    for below in reversed(rounds[:-1]):
        above = path.select("g", F.col("place").alias("block"), F.col("path").alias("_above"))
        path = below.rows.join(above, ["g", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above")
    return path.select("g", "place", "digest", *carried, "path"), roots, rounds


def manifest(leaves: DataFrame, arity: int = 2) -> DataFrame:
    """leaves (g: group's name, not null; key: order inside it; leaf; others) with subroot, root and path."""
    carried = [c for c in leaves.columns if c not in ("g", "leaf")]
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("g", "key", "leaf", "_tie").withColumn("_b", F.spark_partition_id())
    ranged = stored(ranged, "merkle-leaves")
    sizes = ranged.rows.groupBy("g").agg(F.count("*").alias("size"))
    sizes = stored(sizes.withColumn("n", F.col("size")), "merkle-sizes")
    placed = running(ranged.rows, ["g"], "_b", [F.col("key"), F.col("leaf"), F.col("_tie")], {"place": F.lit(1)})
    nodes = lookup(placed, sizes.rows, ["g"]).withColumnRenamed("leaf", "digest").withColumn("place", F.col("place").cast("long"))
    largest = sizes.rows.agg(F.coalesce(F.max("size"), F.lit(0))).head()[0]
    rows, roots, _ = grow(nodes, largest, arity, carried)
    ranged.drop()
    sizes.drop()
    ranked = roots.repartitionByRange("g").withColumn("_b", F.spark_partition_id())
    ranked = stored(ranked, "merkle-roots")
    groups = ranked.rows.count()
    tops = running(ranked.rows.withColumn("_all", F.lit("")), ["_all"], "_b", [F.col("g")], {"place": F.lit(1)})
    tops = tops.select(F.lit("").alias("g"), F.lit(groups).cast("long").alias("size"), F.col("place").cast("long").alias("place"), F.col("root").alias("digest"), F.col("g").alias("_g"), F.col("size").alias("n"))
    above, root, used = grow(tops, groups, arity, ["_g", "n"])
    ranked.drop()
    above = above.select(F.col("_g").alias("g"), "n", F.col("digest").alias("subroot"), F.col("path").alias("_above"))
    above = stored(above.crossJoin(F.broadcast(root.select("root"))), "merkle-tops")  # one row
    for t in used:
        t.drop()
    out = lookup(rows.withColumnRenamed("digest", "leaf"), above.rows, ["g"])
    return out.select(*leaves.columns, "subroot", "root", F.concat("path", "_above").alias("path"))


def proof_digest(path: Column) -> Column:
    """The digest of a proof: all siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda a, x: digest(x["before"], a, x["after"]))


def document_manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", arity: int = 2, fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, changed_leaf (with the fields of `changed` in place of the table's), subroot, root, path of each document."""
    leaf = digest(*[field(F.col(c)) for c in fields])
    other = digest(*[field((changed or {}).get(c, F.col(c))) for c in fields])
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null comes first
    rows = docs.select(name.alias("g"), F.col(order).alias("key"), leaf.alias("leaf"), other.alias("changed_leaf"))
    return manifest(rows, arity).select(F.col("key").alias(order), "leaf", "changed_leaf", "subroot", "root", "path")
