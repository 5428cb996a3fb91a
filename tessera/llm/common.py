"""Helpers shared by the training-data operators: shared-folder tables, bucketed running sums, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handled at once by the numpy kernels; their temporaries take some tens of times as much.
SLICE_BYTES = 1_500_000
#: Rows of one key that are left together, keys with more of them that are broadcast (some 50 bytes each), and parts of a key
#: at most (more rows than HOT times that make larger parts).
HOT, HOT_KEYS, MOST_PARTS = 5_000, 100_000, 4096


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@dataclass(frozen=True)
class Stored:
    """A table in the shared folder; `drop` deletes it once everything made from it is a table of its own."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        context = self.rows.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> Stored:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def table(df: DataFrame, name: str) -> DataFrame:
    """A stored table that stays: the result is read from it."""
    return stored(df, name).rows


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffles of what is written by now: its cleaner follows the driver's garbage collection, which
    can otherwise be hours away."""
    spark.sparkContext._jvm.System.gc()


def deal(rows: DataFrame, values: DataFrame, keys: Sequence[str], counts: DataFrame, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """rows and values with a column _part: rows of a key with more than HOT of them, which n of counts says, are dealt to
    parts by a hash of all their columns, and the row that values has for the key goes to each part.

    counts is read up to three times: a stored table or a small one.
    """
    keys = list(keys)
    hot = counts.filter(F.col(n) > HOT).select(*keys, F.least(F.ceil(F.col(n) / HOT), F.lit(MOST_PARTS)).cast("int").alias("_parts"))
    number = hot.limit(HOT_KEYS + 1).count()
    if not number:
        return rows.withColumn("_part", F.lit(0)), values.withColumn("_part", F.lit(0))
    hot = F.broadcast(hot) if number <= HOT_KEYS else hot
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0)).cast("int")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return rows.join(hot, keys, "left").withColumn("_part", part).drop("_parts"), values.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")


def lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with the one row that values has for their keys, however many rows share a key.

    The column n of values, which goes, says how many rows have the key; hot ones are dealt to parts. values is read up
    to three times: a stored table or a small one. A null key meets nothing, as in any join: callers split such rows off or
    use keys that are never null.
    """
    marked, spread = deal(rows, values.drop(n), keys, values, n)
    return marked.join(spread, [*keys, "_part"], how).drop("_part")


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add exclusive running sums within keys, in the order (bucket, *order), without a window over a whole key.

    bucket is a column that grows with the order. One sum per (keys, bucket) is formed first, the sums before each
    bucket are taken over that small table, and rows are only ordered inside their bucket. keys and bucket: not null.
    """
    by = [*keys, bucket]
    totals = df.groupBy(*by).agg(*[F.sum(w).alias(f"_t_{n}") for n, w in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumns({f"_w_{n}": F.coalesce(F.sum(w).over(within), F.lit(0)) for n, w in sums.items()})
    joined = inner.join(offsets, by)
    return joined.withColumns({n: F.col(f"_o_{n}") + F.col(f"_w_{n}") for n in sums}).drop(*[f"_{x}_{n}" for n in sums for x in "ow"])


def buckets_for(rows: int, each: int = 20_000) -> int:
    """A power of two of buckets with about `each` rows."""
    return 1 << max(4, (max(rows, 1) // each).bit_length())


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes; a larger row has a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. The bytes are a view where the column has no nulls."""
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    offsets = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of a string column."""
    raw, offsets = text_bytes(column)
    for i, j in slices(np.diff(offsets), limit):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the xor-shift-multiply finaliser with fixed odd constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words; the first words are the same for every n."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of rows with the same first n_keys columns; rows come sorted by them."""
    parts: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in batch.columns[:n_keys]:
            values = c.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[int(s)].as_py() for k in range(n_keys))
            if key != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                parts, now = [], key
            parts.append(batch.slice(int(s), int(e - s)))
    if parts:
        yield now, pa.Table.from_batches(parts)


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)
