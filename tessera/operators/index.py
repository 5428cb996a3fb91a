"""The inverted index: files, chunks, postings and terms as tables, in versions of which the meta record names one."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.config import SCHEMA_VERSION, EngineConfig, TokenConfig
from tessera.functions.text import normalize_newlines, path_tokens, snippet, split_lines, trim_space
from tessera.operators.blocks import document_frequency, listed, merged, unpacked
from tessera.operators.chunk import chunked_lines, undeclared, whole_lines
from tessera.operators.hashing import fnv64_bulk
from tessera.operators.literals import quoteless, without_literals
from tessera.operators.ranges import Saved, delete, numbered, prefix_sums, saved
from tessera.operators.words import with_tokens
from tessera.sources import store


@dataclass(frozen=True)
class Index:
    files: DataFrame  # file_id, path, mtime, size, hash64
    chunks: DataFrame  # chunk_id, file_id, path, start_line, end_line, snippet
    postings: DataFrame  # term, chunk_id
    terms: DataFrame | None  # term, df, offset; of a saved index
    blocks: DataFrame | None = None  # term, first_id, last_id, n, ids; of a saved index
    tokens: DataFrame | None = None  # chunk_id, tokens (an array, or joined by a space), the postings by chunk; of an index that is not written yet
    scratch: tuple[Saved, ...] = ()  # tables that the others are read from, until they are written


def tokenized(files: DataFrame, config: EngineConfig, content: str = "content", joined: bool = False, direct: bool = False) -> DataFrame:
    """path, mtime, size, hash64, chunks: array of (start_line, end_line, snippet, tokens) per file.

    String literals are recognised over the whole file, tokens are those of a chunk's lines and of the path. Contents are
    hashed where they are read (unless files has hash64 already) and then shuffled once, as lines. joined: a chunk's tokens
    are a text with a space between them, which is cheaper to write and to read again than an array. direct: files that are one
    block and whose literals need no other line's are cut where they are read, and only the others' lines are shuffled; files
    is then read more than once, which pays for a table. Rows that share a path are always taken together, as lines.
    """
    if direct:
        c = F.col(content)
        alone = c.isNull() | (undeclared(c) if config.token.string_literals else quoteless(c) & undeclared(c))
        again = files.groupBy("path").agg(F.count("*").alias("_n")).filter("_n > 1").select("path")
        more = None
        if again.head(1):
            files, more = files.join(again, "path", "left_anti"), files.join(again, "path", "left_semi")
        rest = files.filter(~alone)
        per = _cut_whole(files.filter(alone), config, content).unionByName(_cut(rest if more is None else rest.unionByName(more), config, content))
    else:
        per = _cut(files, config, content)

    def described(c: Column) -> Column:
        return F.struct(c["start"].alias("start_line"), c["end"].alias("end_line"), snippet(F.col("_trimmed"), c["start"], c["end"], config.max_snippet_bytes, trimmed=True).alias("snippet"))

    per = per.withColumn("_trimmed", F.transform("lines", trim_space))  # once, not for each chunk that holds a line
    per = per.select("path", "_file.mtime", "_file.size", "_file.hash64", F.transform("chunks", described).alias("chunks"), "_code", path_tokens(F.col("path"), config.token).alias("_own"))
    out = with_tokens(per, _literal_free(config), "chunks", "_code", "_own")
    if joined:
        return out
    apart = lambda c: c.withField("tokens", F.filter(F.split(c["tokens"], " "), lambda x: x != ""))
    return out.withColumn("chunks", F.transform("chunks", apart))


def _hashed(files: DataFrame, content: str) -> DataFrame:
    return files if "hash64" in files.columns else fnv64_bulk(files.select("path", "mtime", "size", content), content)


def _cut_whole(files: DataFrame, config: EngineConfig, content: str) -> DataFrame:
    """path, _file, lines, chunks, _code (lines without literals) of files that are one block without literals that count."""
    rows = _hashed(files.filter(F.col(content).isNotNull()), content).withColumn("_file", F.struct("mtime", "size", "hash64"))
    return whole_lines(rows, config.chunk, "_file", content=content).withColumn("_code", F.col("lines"))


def _cut(files: DataFrame, config: EngineConfig, content: str) -> DataFrame:
    """path, _file, lines, chunks, _code (lines without literals) of any files, whose lines are shuffled."""
    hashed = _hashed(files, content)
    lines = hashed.select("path", F.struct("mtime", "size", "hash64").alias("_file"), F.posexplode(split_lines(normalize_newlines(F.col(content)))).alias("_p", "text"))
    lines = lines.select("path", (F.col("_p") + 1).alias("line"), "text", F.when(F.col("_p") == 0, F.col("_file")).alias("_file"))
    if config.token.string_literals:
        return chunked_lines(lines, config.chunk, "_file").withColumn("_code", F.col("lines"))
    return chunked_lines(without_literals(lines), config.chunk, "_file", each=("code",)).withColumnRenamed("code", "_code")


def _literal_free(config: EngineConfig) -> TokenConfig:
    return replace(config.token, string_literals=True)  # literals are gone already where they must not count


def assemble(tokens: DataFrame) -> Index:
    """Ids by path, chunks by path and ordinal, and postings. tokens is read twice: a saved table, with arrays or joined."""
    rows = tokens.select("path", "mtime", "size", "hash64", F.size("chunks").alias("_n"))
    files = numbered(rows, ["path"], "file_id")
    first = prefix_sums(files.rows.select("path", "file_id", "_n"), ["path"], F.col("_n"), "_first")
    cut = tokens.select("path", F.posexplode("chunks").alias("ordinal", "c")).join(first.rows.select("path", "file_id", "_first"), "path")
    chunks = cut.withColumn("chunk_id", F.col("_first") + F.col("ordinal") + 1)
    own = chunks.select("chunk_id", F.col("c.tokens").alias("tokens"))
    each = F.explode("tokens") if isinstance(own.schema["tokens"].dataType, ArrayType) else F.explode(F.split("tokens", " "))
    postings = own.select(each.alias("term"), "chunk_id").filter("term <> ''")
    return Index(
        files.rows.select("file_id", "path", "mtime", "size", "hash64"),
        chunks.select("chunk_id", "file_id", "path", F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.snippet").alias("snippet")),
        postings,
        None,
        tokens=own,
        scratch=(files, first),
    )


def terms(blocks: DataFrame, folder: str | None = None) -> Saved:
    """term, df, offset: 4 bytes for each posting of the terms before, in byte order."""
    df = saved(document_frequency(blocks), "term-counts", folder)  # counted, sampled and dealt from
    out = prefix_sums(df.rows, ["term"], 4 * F.col("df"), "offset", folder)
    df.drop()
    return out


def counts(index: Index) -> DataFrame:
    """file_count, chunk_count, term_count."""
    f = index.files.agg(F.count("*").alias("file_count"))
    return f.crossJoin(index.chunks.agg(F.count("*").alias("chunk_count"))).crossJoin(index.terms.agg(F.count("*").alias("term_count")))  # one row each


TABLES = ("files", "chunks", "blocks", "terms")
#: Versions of an index that are kept, and seconds after which a reader's lease ends.
VERSIONS, LEASE_SECONDS = 2, 3600


def write_index(index: Index, root: str, config_hash: int = 0, repo_head: str = "", keep: int = VERSIONS) -> dict:
    """Write the tables to a new version folder, then let the meta record name it; returns the record.

    The record is written aside and renamed, so a reader finds the old one or the new one. Of the versions before, `keep` less
    one stay, and those that a reader holds a lease on.
    """
    spark = index.files.sparkSession
    root = root.rstrip("/")
    version = f"{root}/{uuid.uuid4().hex}"
    index.files.write.parquet(f"{version}/files")
    index.chunks.write.parquet(f"{version}/chunks")
    lists = listed(index.postings if index.tokens is None else index.tokens)
    merged(lists.rows).write.parquet(f"{version}/blocks")  # in the order of terms, so row groups prune by term
    for s in (lists, *index.scratch):
        s.drop()
    ordered = terms(spark.read.parquet(f"{version}/blocks"))
    ordered.rows.select("term", "df", "offset").write.parquet(f"{version}/terms")
    ordered.drop()
    n = counts(load_version(spark, version)).head()
    meta = {"index_version": 1, "indexed_at_unix": int(time.time()), "file_count": n["file_count"], "chunk_count": n["chunk_count"], "term_count": n["term_count"], "config_hash": config_hash, "schema_version": SCHEMA_VERSION, "repo_head": repo_head, "version": version}
    before = load_meta(spark, root) if store.exists(spark, f"{root}/meta") else None
    meta["history"] = [version, *(before or {}).get("history", [before["version"]] if before else [])]
    held = store.leases(spark, root, LEASE_SECONDS)
    gone = [v for v in meta["history"][max(1, keep) :] if v.rsplit("/", 1)[-1] not in held]
    meta["history"] = [v for v in meta["history"] if v not in gone]
    store.replace_text(spark, f"{root}/meta", json.dumps(meta, indent=2))
    for v in gone:
        delete(spark, v)
    return meta


def load_meta(spark: SparkSession, root: str) -> dict:
    return json.loads(store.read_text(spark, f"{root.rstrip('/')}/meta"))


def load_version(spark: SparkSession, version: str) -> Index:
    files, chunks, blocks, ordered = (spark.read.parquet(f"{version}/{name}") for name in TABLES)
    return Index(files, chunks, unpacked(blocks), ordered, blocks)


def load_index(spark: SparkSession, root: str) -> Index:
    return load_version(spark, load_meta(spark, root)["version"])
