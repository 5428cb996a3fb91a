"""A keyed store of files' tokens: buckets by path, segments of changes, deletion marks, compaction of changed buckets."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranges import delete
from tessera.sources import store

#: Segments that a bucket can have before its changes are merged, and names of applied segments that are remembered.
MOST_SEGMENTS, RECENT = 8, 64
_CHUNK = "struct<start_line: bigint, end_line: bigint, snippet: string, tokens: array<string>>"
#: An entry without chunks is a file that was seen but is not indexed; `gone` marks a deletion.
SCHEMA = f"path string, mtime bigint, size bigint, hash64 bigint, chunks array<{_CHUNK}>, gone boolean"


class TokenStore:
    """The latest entry of every path, below `root`.

    A change is a segment: a folder with one part for each bucket that it touches, so what a change writes grows with the
    change. The record lists the segments in order with the buckets that are still read from them, and is replaced at once.
    When a bucket has more than MOST_SEGMENTS, the buckets that changed are merged into a new segment; other buckets'
    files stay where they are.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        record = f"{self.root}/segments"
        self.record = json.loads(store.read_text(spark, record)) if store.exists(spark, record) else {"buckets": buckets, "segments": []}

    def _save(self) -> None:
        store.replace_text(self.spark, f"{self.root}/segments", json.dumps(self.record))

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.record["buckets"])).cast("int"))

    def _entries(self, only: set[int] | None = None) -> DataFrame:
        """All entries with the number of their segment (and their bucket)."""
        parts = []
        for number, s in enumerate(self.record["segments"]):
            paths = [f"{self.root}/{s['id']}/bucket={b}" for b in s["buckets"] if only is None or b in only]
            if paths:
                read = self.spark.read.schema(f"{SCHEMA}, bucket int").option("basePath", f"{self.root}/{s['id']}").parquet(*paths)
                parts.append(read.withColumn("_seq", F.lit(number)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{SCHEMA}, bucket int, _seq int")

    def _latest(self, only: set[int] | None = None) -> DataFrame:
        entries = self._entries(only)
        if len(self.record["segments"]) < 2:
            return entries
        newest = entries.groupBy("path").agg(F.max("_seq").alias("_seq"))  # reads paths only
        return entries.join(newest, ["path", "_seq"])

    def manifest(self) -> DataFrame:
        """path, mtime, size, hash64 of every file that was seen, without reading tokens."""
        return self._latest().filter("not gone").select("path", "mtime", "size", "hash64")

    def entries(self) -> DataFrame:
        """path, mtime, size, hash64, chunks of every file that was seen (chunks null: not indexed)."""
        return self._latest().filter("not gone").select("path", "mtime", "size", "hash64", "chunks")

    def tokens(self) -> DataFrame:
        """path, mtime, size, hash64, chunks of the indexed files."""
        return self.entries().filter("chunks is not null")

    def apply(self, changed: DataFrame, gone: DataFrame | None = None, name: str | None = None) -> int:
        """Add a segment of changed entries and deleted paths; returns the rows written. A segment whose name is known is not added again."""
        name = name or uuid.uuid4().hex
        if name in self.record.get("recent", []):
            return 0
        rows = changed.select(*[F.col(f) for f in ("path", "mtime", "size", "hash64")], F.col("chunks").cast(f"array<{_CHUNK}>"), F.lit(False).alias("gone"))
        if gone is not None:
            marks = gone.select("path", *[F.lit(None).cast("bigint").alias(f) for f in ("mtime", "size", "hash64")], F.lit(None).cast(f"array<{_CHUNK}>").alias("chunks"), F.lit(True).alias("gone"))
            rows = rows.unionByName(marks)
        written = self._write(rows, name)
        self.record["recent"] = [*self.record.get("recent", []), name][-RECENT:]
        self._save()
        self._compact()
        return written

    def _write(self, rows: DataFrame, name: str) -> int:
        path = f"{self.root}/{name}"
        self._bucket(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        per = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(path).groupBy("bucket").count().collect()  # a row per bucket
        if per:
            self.record["segments"].append({"id": name, "buckets": sorted(r["bucket"] for r in per), "rows": sum(r["count"] for r in per)})
        else:
            delete(self.spark, path)
        return sum(r["count"] for r in per)

    def _compact(self) -> None:
        held = [b for s in self.record["segments"] for b in s["buckets"]]
        if not any(held.count(b) > MOST_SEGMENTS for b in set(held)):
            return
        changed = {b for b in set(held) if held.count(b) > 1}
        old = self.record["segments"]
        latest = self._latest(changed).filter("not gone").drop("_seq", "bucket")
        self.record["segments"] = [dict(s) for s in old]
        self._write(latest, uuid.uuid4().hex)
        for s in self.record["segments"][: len(old)]:
            s["buckets"] = [b for b in s["buckets"] if b not in changed]
        empty = [s["id"] for s in self.record["segments"] if not s["buckets"]]
        self.record["segments"] = [s for s in self.record["segments"] if s["buckets"]]
        self._save()
        for name in empty:
            delete(self.spark, f"{self.root}/{name}")
