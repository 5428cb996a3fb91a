"""Connected components of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: every id that occurs in links with the least id it can reach.

    Each round takes the least label among neighbours, then the label of that label (which halves the distance), until
    nothing changes; every round's labels are a table of their own and the round before's is deleted. The rows of a hub
    (an id with very many links, or a label that very many ids have) are dealt to parts, so no task gathers them.
    Links can be repeated and in either direction; a link with a null end links nothing. Without links there are no rows.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.rows.groupBy("v").agg(F.min("u").alias("l"), F.count("*").alias("n")).select("v", F.least("v", "l").alias("l"), "n"), "labels")
    moved = bool(labels.rows.head(1))
    while moved:
        known = labels.rows
        nearest = lookup(both.rows, known.select(F.col("v").alias("u"), "l", "n"), ["u"], "n").groupBy("v").agg(F.min("l").alias("m"))
        step = stored(known.join(nearest, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"), "n"), "labels")
        further = step.rows.groupBy("l").agg(F.count("*").alias("k")).join(known.select(F.col("v").alias("l"), F.col("l").alias("further")), "l")
        after = lookup(step.rows, further, ["l"], "k").select("v", "was", F.least("l", "further").alias("l"), "n")
        after = stored(after, "labels")
        moved = bool(after.rows.filter("l < was").head(1))
        step.drop()
        labels.drop()
        labels = after
    both.drop()
    return labels.rows.select(F.col("v").alias("id"), F.col("l").alias("component"))
