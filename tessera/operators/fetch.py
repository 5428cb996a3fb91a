"""Bounded fetch of numbered source lines by chunk id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_newlines, numbered_lines
from tessera.operators.paths import safe_path

MAX_IDS, MAX_LINES = 5, 120


def line_limit(n: int) -> int:
    return min(n, MAX_LINES) if n > 0 else MAX_LINES


def fetched(content: Column, start: Column, end: Column, max_lines: int) -> Column:
    """struct(returned_from, returned_to, lines) of a range, clamped to the text without its trailing newlines."""
    text = F.regexp_replace(normalize_newlines(content), "\n+\\z", "")
    lines = F.split(text, "\n", -1)
    first = F.least(F.greatest(start, F.lit(1)), F.size(lines))
    last = F.least(F.greatest(end, first), F.size(lines), first + (line_limit(max_lines) - 1))
    some = F.struct(first.cast("int").alias("returned_from"), last.cast("int").alias("returned_to"), numbered_lines(F.slice(lines, first, last - first + 1), first).alias("lines"))
    none = F.struct(F.lit(0).alias("returned_from"), F.lit(0).alias("returned_to"), F.array().cast("array<string>").alias("lines"))
    return F.when(text == "", none).otherwise(some)


def fetch(chunks: DataFrame, content: DataFrame, ids: Sequence[int], max_lines: int = MAX_LINES) -> DataFrame:
    """chunk_id, path, start_line, end_line, returned_from, returned_to, lines, in the order of the first ids.

    content has path and content. An unknown id, an unsafe path or a missing file fails the request.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(i, int(x)) for i, x in enumerate(list(ids)[:MAX_IDS])], "pos int, chunk_id long")
    found = F.broadcast(asked).join(chunks.filter(F.col("chunk_id").isin([int(x) for x in list(ids)[:MAX_IDS]])), "chunk_id", "left")  # at most MAX_IDS rows
    text = content.select(F.col("path").alias("_path"), F.col("content").alias("_text"))
    hit = text.join(F.broadcast(found.select(F.col("path").alias("_path")).distinct()), "_path")
    rows = found.join(hit, F.col("path") == F.col("_path"), "left")
    problem = F.when(F.col("path").isNull(), F.concat(F.lit("missing chunk "), F.col("chunk_id").cast("string"))).when(~safe_path(F.col("path")), F.concat(F.lit("path rejected: "), F.col("path"))).when(F.col("_text").isNull(), F.concat(F.lit("no such file: "), F.col("path")))
    checked = rows.withColumn("_text", F.when(problem.isNull(), F.col("_text")).otherwise(F.raise_error(problem).cast("string")))
    out = checked.withColumn("_f", fetched(F.col("_text"), F.col("start_line"), F.col("end_line"), max_lines))
    return out.orderBy("pos").select("chunk_id", "path", "start_line", "end_line", "_f.returned_from", "_f.returned_to", "_f.lines")
