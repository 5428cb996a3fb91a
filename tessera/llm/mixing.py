"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule, a linear ramp over training time t in [0, 1] whose integral is the source's
target. A source's documents form a stream in hashed order, repeated as often as the target asks; the word at
cumulative place c of that stream is due when the integrated demand reaches c, so inverting the integral gives every
pass of a document its training position, and range-sorting by position is the curriculum.

Null texts have size 0 and are never taken. A null source is a source of its own, last. Repeated rows are documents of
their own; rows that tie in doc_id and text are interchangeable, so reruns agree. An empty table gives no rows. Other
columns are kept by `curriculum` and not read by `mix`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, lookup, running, table
from tessera.operators.index import numbered

#: So many sources are listed on the driver to share out the words; more are shared out in Spark, by the same rule.
MAX_LISTED = 10_000

WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters that are no space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets by weight, each at most `most` times its size; the excess is shared anew until none is above."""
    target, free = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    left = total
    while free:
        weight = math.fsum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
        left -= math.fsum(target[i] for i in over)
        capped = set(over)
        free = [i for i in free if i not in capped]
    return target


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), total_share: float = 1.5, most: int = 2, slopes: Sequence[float] = (-0.5, 0.0, 0.5), text: str = "text", source: str = "source", doc_id: str = "doc_id", with_text_hash: bool = False) -> DataFrame:
    """One row per document, sorted by first position.

    doc_id, size, source_size, target, taken (words, repeats counted), passes (array of training positions in [0, 1], one for each pass
    that takes words), position (the first, null when nothing is taken). weights and slopes repeat over the sources
    in code-point order, a slope s giving the demand 1 + s * (2t - 1) at time t.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_k"), F.xxhash64(text).alias("_x"))
    rows = table(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    listed = per.limit(MAX_LISTED + 1).collect()
    if len(listed) <= MAX_LISTED:
        listed.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
        sizes = [r["size"] for r in listed]
        targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(listed))], total_share * sum(sizes), most)
        plan = spark.createDataFrame(
            [(i, r["source"], r["n"], s, float(t), float(slopes[i % len(slopes)])) for i, (r, s, t) in enumerate(zip(listed, sizes, targets, strict=True))],
            "_s long, source string, n long, source_size long, target double, _slope double",
        )
    else:
        plan = _many_sources(per, weights, total_share, most, slopes)
    n = buckets_for(rows.count())
    name = [F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none")]
    rows, plan = (d.select("*", *name).drop("source") for d in (rows, plan))
    key = ["_name", "_none"]
    rows = rows.join(F.broadcast(plan.drop("n")), key) if len(listed) <= MAX_LISTED else lookup(rows, plan, key)
    rows = rows.drop(*key)
    digits = max(1, (n.bit_length() - 1 + 3) // 4)
    # rows without an id all have one key and follow each other by text hash: they get buckets of their own between the others'
    nameless = F.md5(F.lit(""))
    share = F.when(F.col("_k") < nameless, 0).when(F.col("_k") > nameless, n + 1).when(F.col("doc_id").isNull(), 1 + F.shiftright("_x", 64 - (n.bit_length() - 1)) + F.lit(n // 2)).otherwise(n + 1)
    rows = rows.withColumn("_b", F.conv(F.substring("_k", 1, digits), 16, 10).cast("long") * (n + 2) + share)
    empty = rows.filter("size = 0").withColumn("_at", F.lit(0).cast("long")).drop("_b")
    rows = running(rows.filter("size > 0"), ["_s"], "_b", [F.col("_k"), F.col("doc_id"), F.col("_x")], {"_at": F.col("size")}).drop("_b").unionByName(empty)
    # pass k of a document begins at place k * source_size + at; it takes what lies below the target
    starts = [F.col("_at") + F.lit(k) * F.col("source_size") for k in range(most)]
    quota = F.floor(F.col("target") + F.lit(0.5))
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), quota - s)) for s in starts]
    taken = takes[0]
    for t in takes[1:]:
        taken = taken + t
    due = [F.when(t > 0, _position(s / F.col("target"), F.col("_slope"))) for s, t in zip(starts, takes, strict=True)]
    out = rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.array_compact(F.array(*due)).alias("passes"), F.col("_x").alias("_text"))
    return out.withColumn("position", F.try_element_at("passes", F.lit(1))).orderBy(F.col("position").asc_nulls_last(), "doc_id", "_text").drop(*([] if with_text_hash else ["_text"]))


def _many_sources(per: DataFrame, weights: Sequence[float], total_share: float, most: int, slopes: Sequence[float]) -> DataFrame:
    """_s, source, n, source_size, target, _slope: `share_out` as rounds over a table of sources."""
    named = numbered(per.filter("source is not null"), ["source"], "_s").rows.withColumn("_s", F.col("_s") - 1)
    last = named.count()
    every = named.unionByName(per.filter("source is null").withColumn("_s", F.lit(last).cast("long")))
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), (F.col("_s") % len(values)).cast("int"))
    every = table(every.select("_s", "source", "n", F.col("size").alias("source_size"), pick(weights).alias("_w"), pick(slopes).alias("_slope"), F.lit(None).cast("double").alias("target")), "sources")
    left = total_share * (every.agg(F.sum("source_size").alias("s")).head()["s"] or 0)
    while True:
        free = F.col("target").isNull() & (F.col("_w") > 0)
        weight = every.filter(free).agg(F.sum("_w").alias("w")).head()["w"]
        if not weight:
            break
        over = free & (F.lit(left) * F.col("_w") / F.lit(weight) > F.col("source_size") * most)
        capped = every.filter(over).agg(F.sum("source_size").alias("s")).head()["s"]
        now = F.when(over, (F.col("source_size") * most).cast("double")) if capped is not None else F.when(free, F.lit(left) * F.col("_w") / F.lit(weight))
        every = table(every.withColumn("target", F.coalesce("target", now)), "sources")
        if capped is None:
            break
        left -= capped * most
    return every.withColumn("target", F.coalesce("target", F.lit(0.0))).drop("_w")


def _position(u: Column, slope: Column) -> Column:
    """The time t at which the integral t + slope * (t * t - t) of a source's demand reaches u."""
    root = F.sqrt(F.greatest(F.lit(0.0), F.pow(F.lit(1.0) - slope, F.lit(2.0)) + F.lit(4.0) * slope * u))
    return F.when(slope == 0, u).otherwise((root - (F.lit(1.0) - slope)) / (F.lit(2.0) * slope) + F.lit(0.0))


def curriculum(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents in training order with their own columns, one row for each pass.

    A pass is kept whole: a document is given as often as the words it takes fill it, halves rounded up.
    """
    mixed = mix(docs, text=text, source=source, doc_id=doc_id, with_text_hash=True, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0))
    # repeated ids must not multiply each other's rows: they are told apart by their text, equal rows by a number
    passes = mixed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_words"), "_text", F.slice("passes", F.lit(1), copies.cast("int")).alias("_p"))
    return _with_passes(docs, passes, text, doc_id)


def _with_passes(docs: DataFrame, passes: DataFrame, text: str, doc_id: str) -> DataFrame:
    from pyspark.sql import Window

    columns = docs.columns
    left = docs.withColumns({"_size": words(F.col(text)), "_hash": F.xxhash64(text)}).filter("_size > 0")
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy(doc_id, "_hash").orderBy("_size")))
    right = passes.filter("_words > 0").withColumn("_m", F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_words", F.col("_p").desc())))
    joined = left.join(right, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")) & (F.col("_n") == F.col("_m")))
    out = joined.withColumn("_pass", F.explode("_p")).orderBy("_pass", doc_id)
    return out.select(*[F.col(f"`{c}`") for c in columns])
