"""Files of any store through its Hadoop file system: listings, small records that are replaced at once, leases of readers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small record, whole."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small record aside and rename it over the old one: a reader sees the old record or the new one."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, fs.makeQualified(p), overwrite)


def lease(spark: SparkSession, root: str, version: str) -> str:
    """Hold a version of an index: it is not deleted while the lease is there and younger than its time. Returns the lease."""
    path = f"{root.rstrip('/')}/leases/{version.rsplit('/', 1)[-1]}.{uuid.uuid4().hex}"
    replace_text(spark, path, str(int(time.time())))
    return path


def leases(spark: SparkSession, root: str, seconds: int) -> set[str]:
    """The versions with a lease that is younger than so many seconds; older leases are deleted."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/leases")
    if not fs.exists(p):
        return set()
    held, now = set(), time.time()
    for status in fs.listStatus(p):
        if status.getModificationTime() / 1000 + seconds < now:
            fs.delete(status.getPath(), False)
        else:
            held.add(status.getPath().getName().split(".", 1)[0])
    return held


def release(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, False)


def children(spark: SparkSession, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, seconds of change, bytes) of what is in a folder, hidden names too, links left out."""
    fs, p = _fs(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    raw = fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else None  # which follows links in its listings
    for s in fs.listStatus(p):
        if s.isSymlink() or raw is not None and raw.getFileLinkStatus(path(s.getPath().toUri().getPath())).isSymlink():
            continue
        yield s.getPath().getName(), s.isDirectory(), s.getModificationTime() // 1000, s.getLen()
