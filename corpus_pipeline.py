"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.line_align import remove_aligned
from tessera.llm.mixing import curriculum
from tessera.llm.packing import pack_documents
from tessera.llm.quality import score, train
from tessera.llm.shingle_join import ngram_members

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go.

    Null and empty texts are scored like others, null ids and repeated rows each; without labels every score is 0.5 and all
    documents stay. An empty table gives none. Columns other than those of documents go, here and in the next stages.
    """
    docs = docs.select(*COLUMNS)
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, trees).filter("quality_score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go; so does a document of which nothing is left.

    Null and blank texts that lost no line stay, and so do null ids, whose rows are never compared; rows with equal ids
    are not compared with each other, equal rows get equal results. An empty table gives none.
    """
    out = remove_aligned(docs.select(*COLUMNS))
    kept = out.filter((F.col("lines_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id and text hash; of equal rows one.

    Null ids, null texts and texts without words link with nothing and stay. An empty table gives none.
    """
    docs = docs.select(*COLUMNS)
    members = table(ngram_members(docs), "near-members")
    gone = members.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("x").alias("_x")).distinct()
    same = (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_x"))
    kept = docs.join(gone, same, "left_anti")
    equal = members.filter("doc_id is not null").groupBy("doc_id", "x").agg(F.count("*").alias("n")).filter("n > 1")
    if not equal.head(1):
        return kept
    equal = equal.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"))
    once = kept.join(equal, (kept["doc_id"] == F.col("_id")) & (F.xxhash64(kept["text"]) == F.col("_x")), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(equal, (kept["doc_id"] == F.col("_id")) & (F.xxhash64(kept["text"]) == F.col("_x")), "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source weights decide how often a document comes, its source's schedule where.

    A null source is a source of its own, last. Null texts and texts without words are never taken. Equal rows are taken
    each; rows that tie in id and size are told apart by their texts. An empty table gives none.
    """
    return curriculum(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens.

    A null or empty text is its end token, a long text several pieces; repeated rows are packed each. An empty table gives none.
    """
    return pack_documents(docs, context=2048, end_id=1)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Training, alignment and column generation are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
