"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked, so the graph is one of cliques. All documents start on hashed shards. In every round
the linked documents look at their neighbours' shards (a join of the labels with each group's most frequent one) and
want to move there; quotas, the places that linked documents don't hold, admit the moves, largest groups first. Rounds
end when no edge is cut or their number falls no more. Then groups are settled, largest first: each on the shard
where most of it is, if that has room for all of it, else on another one that has; a group larger than a shard
fills whole shards. Documents without links fill what is left, so row counts differ by at most one (law `rows`) and
a group is cut only when it must be.

As members of a group on one shard are interchangeable, rounds work on counts per (group, shard), and a cut edge is one
between a member and the shard where most of its group is; what the driver sees is the room of each shard and the wishes
per shard and size class. Null texts are linked with nothing; empty texts are equal texts. Repeated rows are
documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import buckets_for, running, table


def capacities(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (j < rows % n_shards) for j in range(n_shards)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def shard(docs: DataFrame, n_shards: int = 40, text: str = "text", doc_id: str = "doc_id", max_rounds: int | None = None, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null).

    cuts, if given, receives the number of cut edges before each round of propagation, and at the end.
    """
    t = F.col(text)
    base = table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.md5(t.cast("binary"))).alias("_g"),
            F.xxhash64(F.col(doc_id), t).alias("_h"),
        ),
        "shard-rows",
    )
    rows = base.count()
    n_buckets = buckets_for(rows)
    base = base.withColumn("_b", F.pmod("_h", F.lit(n_buckets)))
    groups = table(base.filter("_g is not null").groupBy("_g").agg(F.count("*").alias("_members")).filter("_members > 1"), "shard-groups")
    linked = base.join(groups, "_g")
    few = max(4, rows // 100_000)  # partitions of tables with a row per group
    labels = table(linked.groupBy("_g", F.pmod("_h", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")).coalesce(few), "shard-labels")
    labels = _propagate(labels, capacities(rows, n_shards), few, cuts if cuts is not None else [])
    lots = _settle(labels, rows, n_shards, max_rounds or 4 * n_shards + 16, few)

    # members of a group with several lots take their places in hashed order
    ends = Window.partitionBy("_g").orderBy("shard")
    lots = lots.withColumns({"_hi": F.sum("n").over(ends), "_lots": F.count("*").over(Window.partitionBy("_g"))})
    lots = table(lots.select("_g", "shard", (F.col("_hi") - F.col("n")).alias("_lo"), "_hi", "_lots").coalesce(few), "shard-lots")
    if cuts is not None:
        whole = lots.groupBy("_g").agg(F.sum(F.col("_hi") - F.col("_lo")).alias("m"), F.max(F.col("_hi") - F.col("_lo")).alias("most"))
        cuts.append(whole.agg(F.coalesce(F.sum(F.col("m") - F.col("most")), F.lit(0)).alias("n")).head()["n"])
    room = capacities(rows, n_shards)
    for r in lots.groupBy("shard").agg(F.sum(F.col("_hi") - F.col("_lo")).alias("n")).collect():  # a row per shard
        room[r["shard"]] -= r["n"]
    order = [F.col("_h"), F.col("doc_id"), F.col("size")]
    columns = ["doc_id", "size", "text_crc32", "_h", "_b", "shard"]
    placed = linked.join(lots.filter("_lots = 1"), "_g").select(*columns)
    divided = lots.filter("_lots > 1")
    if divided.head(1):
        ranked = running(linked.join(divided.select("_g").distinct(), "_g"), ["_g"], "_b", order, {"_rank": F.lit(1)})
        placed = placed.unionByName(ranked.join(divided, "_g").filter("_rank >= _lo and _rank < _hi").select(*columns))

    single = base.join(groups, "_g", "left_anti")
    bounds, total = [], 0
    for n in room:
        total += n
        bounds.append(total)
    alone = running(single, [], "_b", order, {"_rank": F.lit(1)})
    filled = alone.withColumn("shard", F.size(F.filter(_longs(bounds), lambda b: b <= F.col("_rank"))))
    out = table(placed.unionByName(filled.select(*columns)).coalesce(2 * few), "shard-placed")
    out = running(out, ["shard"], "_b", order, {"slot": F.lit(1)})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _size_class(m: Column) -> Column:
    """Larger groups come first: a class of sizes, then a hash."""
    return (F.lit(63) - F.floor(F.log2(m)).cast("int")) * 16 + F.pmod(F.xxhash64("_g", F.lit(1)), F.lit(16)).cast("int")


def _admitted(wanted: list, free: list[int]) -> tuple[list[int], list[int]]:
    """(until, left): the size classes below `until` may move to a shard, whole classes in order as far as its room goes."""
    until, left, full = [0] * len(free), list(free), set()
    for r in wanted:
        s = r["shard"]
        if s not in full and r["n"] <= left[s]:
            until[s], left[s] = r["_p"] + 1, left[s] - r["n"]
        else:
            full.add(s)
    return until, left


def _propagate(labels: DataFrame, room: list[int], few: int, cuts: list[int], rounds: int = 12) -> DataFrame:
    """Labels (_g, shard, n) after rounds in which members move to the shard where most of their group is."""
    for _ in range(rounds):
        most = labels.groupBy("_g").agg(F.max(F.struct("n", F.xxhash64("_g", "shard").alias("h"), "shard")).alias("b"), F.sum("n").alias("m"))
        asked = labels.join(most.select("_g", "b.shard", "m").withColumnRenamed("shard", "_to"), "_g").withColumn("_p", _size_class(F.col("m")))
        asked = table(asked.select("_g", "shard", "n", "_to", "_p").coalesce(few), "shard-wishes")
        held = {r["shard"]: r["n"] for r in asked.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        free = [c - held.get(s, 0) for s, c in enumerate(room)]
        wanted = asked.filter("shard <> _to").groupBy(F.col("_to").alias("shard"), "_p").agg(F.sum("n").alias("n")).orderBy("shard", "_p").collect()  # at most 1024 rows per shard
        cut = sum(r["n"] for r in wanted)
        until, left = _admitted(wanted, free)
        if not cut or left == free or cuts and cut >= cuts[-1]:
            cuts.append(cut)
            return labels
        cuts.append(cut)
        goes = F.col("_p") < F.get(_longs(until), F.col("_to"))
        moved = asked.select("_g", F.when(goes, F.col("_to")).otherwise(F.col("shard")).alias("shard"), "n")
        labels = table(moved.groupBy("_g", "shard").agg(F.sum("n").alias("n")).coalesce(few), "shard-labels")
    return labels


def _settle(moving: DataFrame, rows: int, n_shards: int, max_rounds: int, few: int) -> DataFrame:
    """Lots (_g, shard, n) that hold all linked documents within the shards' capacities, from labels of the same form."""
    free = capacities(rows, n_shards)
    done = []
    for k in count():
        room, most = _longs(free), max(free)
        votes = moving.groupBy("_g").agg(F.collect_list(F.struct("n", (-F.col("shard")).alias("s"))).alias("v"), F.sum("n").alias("m"))  # at most n_shards each
        votes = votes.withColumn("need", F.least(F.col("m"), F.lit(most)))
        best = F.array_max(F.filter("v", lambda x: F.get(room, -x["s"]) >= F.col("need")))
        others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.get(room, s) >= F.col("need"))
        any_other = F.get(others, F.pmod(F.xxhash64("_g", F.lit(k)), F.size(others).cast("long")).cast("int"))
        asked = table(votes.select("_g", "m", "need", F.coalesce(-best["s"], any_other).cast("int").alias("shard"), _size_class(F.col("m")).alias("_p")).coalesce(few), "shard-wants")
        wanted = asked.groupBy("shard", "_p").agg(F.sum("need").alias("n")).orderBy("shard", "_p").collect()  # at most 1024 rows per shard
        if not wanted:
            break
        until, left = _admitted(wanted, free)
        got = F.when(F.col("_p") < F.get(_longs(until), F.col("shard")), F.col("need")).otherwise(F.lit(0))
        if left == free or k >= max_rounds:  # not even a first class fits, or it takes long: group by group, which places a group at least
            asked = running(asked.withColumn("_h", F.xxhash64("_g")), ["shard"], "_p", [F.desc("m"), F.col("_h"), F.col("_g")], {"_before": F.col("need")})
            got = F.when(F.col("_before") + F.col("need") <= F.get(room, F.col("shard")), F.col("need")).otherwise(F.lit(0))
            asked = table(asked.withColumn("got", got).coalesce(few), "shard-moves")
            got = F.col("got")
            left = list(free)
            for r in asked.groupBy("shard").agg(F.sum("got").alias("n")).collect():
                left[r["shard"]] -= r["n"]
        free = left
        done.append(asked.filter(got > 0).select("_g", "shard", got.alias("n")))
        # what a group could not place keeps the label it asked for
        moving = asked.filter(F.col("m") > got).select("_g", "shard", (F.col("m") - got).alias("n"))
    if not done:
        return moving
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    return settled.groupBy("_g", "shard").agg(F.sum("n").alias("n"))
