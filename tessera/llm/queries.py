"""Registered queries of the training-data operators: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import round_trip
from tessera.llm.chunking import edited_neighbours
from tessera.llm.histogram import length_histogram
from tessera.llm.line_align import remove_aligned
from tessera.llm.merkle import document_manifest, fold, proof_digest
from tessera.llm.mixing import mix
from tessera.llm.packing import pack_documents
from tessera.llm.pivots import near_vectors
from tessera.llm.quality import classify
from tessera.llm.sharding import shard
from tessera.llm.shingle_join import ngram_groups
from tessera.llm.suffix import remove_repeats
from tessera.llm.token_alignment import align_documents


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir), n_shards=40)


def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), context=2048, end_id=1)


def op4_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(_documents(spark, sf_dir))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(_documents(spark, sf_dir), n=5, percent=75)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_documents(spark, sf_dir), length=400)
    kept_bytes = F.col("n_bytes") - F.col("n_removed")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept_bytes.alias("kept_bytes"), "kept_chars")


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_documents(spark, sf_dir))


def op10_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_aligned(_documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lines_total", "lines_removed", "aligned_with", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(_documents(spark, sf_dir))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_documents(_documents(spark, sf_dir))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document (by its id's checksum) claims a character more than it has."""
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = document_manifest(_documents(spark, sf_dir), changed={"n_chars": F.when(told, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    out = out.withColumn("folded_root", fold(F.col("changed_leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_permutation": op1_pivot_permutation,
        "op2_balanced_shards": op2_balanced_shards,
        "op3_cutting_stock_packing": op3_cutting_stock_packing,
        "op4_content_chunks": op4_content_chunks,
        "op5_quality_trees": op5_quality_trees,
        "op6_curriculum_mix": op6_curriculum_mix,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_token_histogram": op9_token_histogram,
        "op10_line_alignment": op10_line_alignment,
        "op11_speculative_bpe": op11_speculative_bpe,
        "op12_token_alignment": op12_token_alignment,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


#: Sizes, targets and the hashed streams of op6. Every source's stream is ordered by md5(doc_id).
_OP6 = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::DOUBLE AS ssize, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM rows_ GROUP BY source),
weighed AS (SELECT source, ssize, i, [3.0, 1.0, 2.0][(i % 3) + 1]::DOUBLE AS w, [-0.5, 0.0, 0.5][(i % 3) + 1]::DOUBLE AS slope FROM per),
-- the capped sources are those with the least 2 * size / weight; round n caps the first n of them
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2 * ssize / w, i) AS n,
         1.5 * sum(ssize) OVER () - coalesce(sum(2 * ssize) OVER (ORDER BY 2 * ssize / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER (ORDER BY 2 * ssize / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM weighed),
cut AS (SELECT min(n) AS n FROM ranked WHERE left_ * w / weight <= 2 * ssize),
level AS (SELECT r.n, r.left_, r.weight FROM ranked r JOIN cut c ON r.n = c.n),
plan AS (
  SELECT r.source, r.ssize::BIGINT AS source_size, r.slope,
         CASE WHEN l.n IS NULL OR r.n < l.n THEN 2 * r.ssize ELSE l.left_ * r.w / l.weight END AS target
  FROM ranked r LEFT JOIN level l ON true),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.slope, floor(p.target + 0.5)::BIGINT AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
  FROM rows_ d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
passes AS (
  SELECT *, greatest(0, least(size, quota - at_)) AS t1, greatest(0, least(size, quota - at_ - source_size)) AS t2 FROM placed),
due AS (SELECT *, CASE WHEN t1 > 0 THEN at_ / target WHEN t2 > 0 THEN (at_ + source_size) / target END AS u FROM passes)
SELECT doc_id, size::BIGINT AS size, source_size, target, (t1 + t2)::BIGINT AS taken,
       round(CASE WHEN slope = 0 THEN u ELSE (sqrt(greatest(0.0, (1 - slope) * (1 - slope) + 4 * slope * u)) - (1 - slope)) / (2 * slope) + 0.0 END, 9) AS position
FROM due
"""


#: All pairs of equal label by cosine in double precision, then the least vec_id within reach.
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
         AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok
  FROM embeddings),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.ok AND b.ok AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, reach.r FROM reach JOIN pairs p ON p.b = reach.vec_id),
comp AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id),
deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN comp c USING (vec_id) LEFT JOIN deg d ON d.a = v.vec_id
"""


#: Shingle sets, overlaps by a join on shingles, then the least doc_id within reach.
_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.a, reach.r FROM reach JOIN pairs p ON p.b = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.g) AS n_shingles, comp.c AS component_id FROM s JOIN comp USING (doc_id)
"""


#: Every 400-byte window hashed; runs of covered bytes as gaps and islands of the repeated windows' starts.
_OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(b) - 399)) AS s, b FROM d),
k AS (SELECT r, s, md5(b[s + 1:s + 400]) AS h FROM w),
twice AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
m AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM k WHERE h IN (SELECT h FROM twice)),
g AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM m),
runs AS (SELECT r, min(s) AS a, max(s) + 400 AS e FROM g GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT d.r, coalesce(max(runs.e), 0), octet_length(d.b) FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r, d.b),
kept AS (SELECT gaps.r, string_agg(hex(d.b[f + 1:t]), '' ORDER BY f) AS x FROM gaps JOIN d ON d.r = gaps.r WHERE t > f GROUP BY gaps.r),
sums AS (SELECT r, sum(e - a) AS removed, count(*) AS n FROM runs GROUP BY r)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(x, ''))) AS kept_sha256, (octet_length(d.b) - coalesce(removed, 0))::BIGINT AS kept_bytes,
       len(list_filter(regexp_extract_all(coalesce(x, ''), '..'), lambda p: p[1] NOT IN ('8', '9', 'A', 'B')))::BIGINT AS kept_chars
FROM d LEFT JOIN sums ON sums.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


#: Levels of each language's tree, then of the tree over their roots; siblings of a node are those that share its place's half.
_OP13 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text FROM documents),
f AS (
  SELECT *, coalesce('1' || lang, '0') AS g,
         list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
           lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)],
           lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS x
  FROM d),
l AS (
  SELECT r, doc_id, g, sha256(x[1] || x[2] || x[3] || x[4] || x[5]) AS leaf,
         CASE WHEN xor(c, 4294967295) % 7 = 0 THEN sha256(x[1] || x[2] || x[3] || x[6] || x[5]) ELSE sha256(x[1] || x[2] || x[3] || x[4] || x[5]) END AS told
  FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM l),
nodes(g, k, p, n, h) AS (
  SELECT g, 0, p, n, leaf FROM placed
  UNION ALL SELECT g, k + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY g, k, p // 2, n),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(k, p, n, h) AS (
  SELECT 0, p, n, subroot FROM subs
  UNION ALL SELECT k + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY k, p // 2, n),
low(r, g, k, p, n, h, s) AS (
  SELECT r, g, 0, p, n, told, '' FROM placed
  UNION ALL SELECT a.r, a.g, a.k + 1, a.p // 2, (a.n + 1) // 2, sha256(CASE WHEN a.p % 2 = 1 THEN coalesce(b.h, '') || a.h ELSE a.h || coalesce(b.h, '') END), a.s || coalesce(b.h, '')
  FROM low a LEFT JOIN nodes b ON b.g = a.g AND b.k = a.k AND b.p = xor(a.p, 1) WHERE a.n > 1),
high(r, k, p, n, h, s) AS (
  SELECT low.r, 0, subs.p, subs.n, low.h, low.s FROM low JOIN subs USING (g) WHERE low.n = 1
  UNION ALL SELECT a.r, a.k + 1, a.p // 2, (a.n + 1) // 2, sha256(CASE WHEN a.p % 2 = 1 THEN coalesce(b.h, '') || a.h ELSE a.h || coalesce(b.h, '') END), a.s || coalesce(b.h, '')
  FROM high a LEFT JOIN tops b ON b.k = a.k AND b.p = xor(a.p, 1) WHERE a.n > 1)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(high.s) AS proof_sha256, high.h AS folded_root, high.h = root.h AS verified
FROM l JOIN subs USING (g) JOIN high ON high.r = l.r AND high.n = 1 CROSS JOIN (SELECT h FROM tops WHERE n = 1) root
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_permutation": _OP1, "op7_ngram_jaccard": _OP7, "op6_curriculum_mix": _OP6, "op8_suffix_dedup": _OP8, "op13_merkle_manifest": _OP13}
