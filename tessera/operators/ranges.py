"""Numbers and prefix sums in a total order, range by range, and tables in the shared folder that fix the ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, which one task orders.
RANGE_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store; nothing happens if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass(frozen=True)
class Saved:
    """A table that was written; `drop` deletes it once what is made from it is written too."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        delete(self.rows.sparkSession, self.path)


def saved(df: DataFrame, name: str, folder: str | None = None) -> Saved:
    """Write df as Parquet (in the shared folder, or in another) and read it back."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Saved(df.sparkSession.read.schema(df.schema).parquet(path), path)


def prefix_sums(rows: DataFrame, order: Sequence[str], weight: Column, name: str, folder: str | None = None) -> Saved:
    """rows with `name`: the sum of the weights of the rows before, in the order of the columns `order`.

    Rows are dealt to ranges of about RANGE_ROWS rows by sampled bounds, and the ranges are written, so that every later
    evaluation sees the same ones. A window only ever covers a range; the sums of the ranges before are a small table.
    Rows that tie in `order` are in any order among themselves.
    """
    n = rows.count()
    ranged = rows.repartitionByRange(n // RANGE_ROWS + 1, *order).withColumn("_range", F.spark_partition_id()).withColumn("_w", weight.cast("long"))
    kept = saved(ranged, "ranges", folder)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.rows.groupBy("_range").agg(F.sum("_w").alias("_sum"))  # a row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    out = kept.rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(F.broadcast(offsets), "_range")
    return Saved(out.withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_w", "_in", "_before"), kept.path)


def numbered(rows: DataFrame, order: Sequence[str], name: str, folder: str | None = None) -> Saved:
    """rows with a dense 1-based number in the given order."""
    out = prefix_sums(rows, order, F.lit(1), name, folder)
    return Saved(out.rows.withColumn(name, F.col(name) + 1), out.path)
