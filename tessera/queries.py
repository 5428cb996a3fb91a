"""Registered queries of the index engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures
from tessera.config import ALLOW_SHORT, INCLUDE_EXT, INDEX_DIR, STOP_WORDS, STRIP_EXTS, STRIP_SUFFIXES, ChunkConfig, EngineConfig, typescript_tokens
from tessera.functions import text as T
from tessera.operators import blocks as B
from tessera.operators import chunk as C
from tessera.operators import fetch as fetching
from tessera.operators import index as I
from tessera.operators import paths as P
from tessera.operators import search as S
from tessera.operators.hashing import fnv64_bulk
from tessera.operators.ranges import Saved, numbered, saved, shared_folder
from tessera.plans import sync as Y
from tessera.plans.rules import effective_rules
from tessera.sources import scan, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOKENS = typescript_tokens()
NO_STRINGS = replace(TOKENS, string_literals=False)
SMALL = ChunkConfig(max_lines=8, overlap_lines=2, min_lines=3)
QUERY = "the and heatThe2 HTTPServer eaux"


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Tables


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the code corpus as files."""
    code = spark.createDataFrame(list(fixtures.CODE), "path string, content string")
    code = code.select("path", F.lit(0).cast("long").alias("mtime"), F.octet_length("content").cast("long").alias("size"), "content")
    return _files(spark, sf_dir).unionByName(code)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(p,) for p in fixtures.PATHS], "path string")
    return _files(spark, sf_dir).select("path").unionByName(listed)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


_FILES = "SELECT concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id AS VARCHAR) || '.ts') AS path, coalesce(text, '') AS content FROM documents"
_CODE = _FILES + " UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({_quote(p)}, {_quote(c)})" for p, c in fixtures.CODE) + ") c(path, content)"
_PATHS = f"SELECT path FROM ({_FILES}) UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({_quote(p)})" for p in fixtures.PATHS) + ") p(path)"
_NL = r"regexp_replace(content, '\r\n?', chr(10), 'g')"


def _sql_idents(text: str) -> str:
    for cut in (r"(\p{Nd})([^\p{Nd}])", r"([^\p{Nd}])(\p{Nd})", r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        text = rf"regexp_replace({text}, '{cut}', '\1 \2', 'g')"
    return _sql_words(text)


def _sql_words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


_KEEP = rf"len(x) <= 64 AND (len(x) >= 3 OR x IN {_in(ALLOW_SHORT)}) AND x NOT IN {_in(STOP_WORDS)} AND NOT regexp_full_match(x, '\p{{Nd}}+') AND (len(x) < 16 OR NOT regexp_full_match(x, '[0-9a-f]+'))"


def _sql_tokens(words: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({words}, lambda w: lower(w)), lambda x: {_KEEP})))"


_LITERAL = "(?s)" + "|".join(f"{q}(?:[^{q}\\\\]|\\\\.)*(?:{q}|\\\\?\\z)" for q in ("''", '"', "`"))
_BARE = f"regexp_replace(content, '{_LITERAL}', ' ', 'g')"


def _sql_path(path: str) -> str:
    """SQL for the stripped path, as a lateral chain of columns over (path)."""
    base = "list_last(string_split({0}, '/'))"

    def known(p: str, ends) -> str:
        b = base.format(p)
        return "CASE " + " ".join(f"WHEN ends_with(lower({b}), {_quote(e)}) AND len({b}) > {len(e)} THEN {_quote(e)}" for e in ends) + " END"

    one = f"(CASE WHEN ({known(path, STRIP_SUFFIXES)}) IS NULL THEN {path} ELSE left({path}, len({path}) - len({known(path, STRIP_SUFFIXES)})) END)"
    return f"SELECT *, coalesce({known('p1', STRIP_EXTS)}, regexp_extract({base.format('p1')}, '(\\.[^.]*)$', 1)) AS ext, {base.format('p1')} AS b1 FROM (SELECT *, {one} AS p1 FROM src)"


_STRIPPED = f"""stripped AS (
  SELECT * EXCLUDE (p1, ext, b1), CASE WHEN ext <> '' AND len(b1) > len(ext) AND ends_with(p1, ext) THEN left(p1, len(p1) - len(ext)) ELSE p1 END AS clean
  FROM ({_sql_path("path")}))"""
_DOCS = f"""src AS ({_FILES}), {_STRIPPED},
corpus AS (
  SELECT path, content, list_sort(list_distinct(list_concat({_sql_tokens(_sql_idents("content"))}, {_sql_tokens(_sql_idents("clean"))}))) AS tokens
  FROM stripped)"""


#: Indexes that this process wrote, by application and input: the files' names, times of change and sizes.
_WRITTEN: dict[tuple, str] = {}


def _input(spark: SparkSession, sf_dir: str) -> tuple:
    """What identifies the documents' files as they are now."""
    seen = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return (spark.sparkContext.applicationId, *sorted((r[0], str(r[1]), r[2]) for r in seen.collect()))  # a row per file


def _tokens(spark: SparkSession, sf_dir: str) -> Saved:
    """Tokens of the documents and the code corpus, cut into chunks."""
    return saved(I.tokenized(_code(spark, sf_dir), replace(EngineConfig(), token=TOKENS, chunk=SMALL), joined=True, direct=True), "tokens")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A new saved index."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    tokens = _tokens(spark, sf_dir)
    I.write_index(I.assemble(tokens.rows), root)
    tokens.drop()
    return root


def _stored(spark: SparkSession, sf_dir: str) -> I.Index:
    """The saved index of the documents as they are: the first query that needs it writes it (or `index_build`), the others read it."""
    key = _input(spark, sf_dir)
    if key not in _WRITTEN or not store.exists(spark, f"{_WRITTEN[key]}/meta"):
        _WRITTEN[key] = _written(spark, sf_dir)
    return I.load_index(spark, _WRITTEN[key])


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).postings


# Scans and filters

_RULES = effective_rules(EngineConfig(), True, True, ("!build/keep.ts",))


# a zero byte in the first 4096, or a character that they cut
_BINARY = "(contains(content, chr(0)) AND octet_length(encode(string_split(content, chr(0))[1])) < 4096 OR hex(encode(content)[4097:4097]) BETWEEN '80' AND 'BF')"


@_register("scan_corpus", f"SELECT path, octet_length(encode(content)) AS size, md5({_NL}) AS digest FROM ({_CODE}) WHERE octet_length(encode(content)) <= 1048576 AND NOT {_BINARY}")
def scan_corpus(spark, sf_dir):
    kept = scan.apply_filters(_code(spark, sf_dir), EngineConfig(), _RULES)
    return kept.select("path", "size", F.md5(T.normalize_newlines(F.col("content")).cast("binary")).alias("digest"))


@_register("scan_meta", f"SELECT path, 0::BIGINT AS mtime, octet_length(encode(content)) AS size FROM ({_CODE})")
def scan_meta(spark, sf_dir):
    return scan.apply_filters(_code(spark, sf_dir).select("path", "mtime", "size"), EngineConfig(), _RULES)


@_register("filter_ext", f"SELECT path FROM ({_PATHS}) WHERE " + " OR ".join(f"ends_with(lower(path), '{e}')" for e in INCLUDE_EXT))
def filter_ext(spark, sf_dir):
    return _paths(spark, sf_dir).filter(P.has_extension(F.col("path")))


@_register("filter_binary_ext", f"SELECT path, regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN {_in(P.BINARY_EXT)} OR regexp_matches(lower(path), '\\.tar\\.(gz|bz2|xz)$') AS is_binary FROM ({_PATHS})")
def filter_binary_ext(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", P.known_binary(F.col("path")).alias("is_binary"))


@_register("filter_size", f"SELECT path, octet_length(encode(content)) AS size FROM ({_CODE}) WHERE octet_length(encode(content)) <= 2000")
def filter_size(spark, sf_dir):
    return _code(spark, sf_dir).filter(P.within_size(F.col("size"), 2000)).select("path", "size")


@_register("filter_binary_sniff", f"SELECT path, {_BINARY} AS is_binary FROM ({_CODE})")
def filter_binary_sniff(spark, sf_dir):
    return _code(spark, sf_dir).select("path", P.looks_binary(F.col("content")).alias("is_binary"))


#: Each pattern of the fixtures as a condition of its own in SQL, independent of the translation that the filters use.
_GLOB_SQL = {
    "**/*.ts": "ends_with({p}, '.ts')",
    "src/*": "regexp_full_match({p}, 'src/[^/]*')",
    "*": "NOT contains({p}, '/')",
    "**": "true",
    "a/**/deep.ts": "starts_with({p}, 'a/') AND ends_with({p}, '/deep.ts')",
    "src/[a-c]*.ts": "regexp_full_match({p}, 'src/[a-c][^/]*[.]ts')",
    "src/[^i]*.ts": "regexp_full_match({p}, 'src/[^i/][^/]*[.]ts')",
    "src/b\\.test.ts": "{p} = 'src/b.test.ts'",
    "lib/?.js*": "regexp_full_match({p}, 'lib/[^/][.]js[^/]*')",
    "[": "false",
    "**/*.svg": "ends_with({p}, '.svg')",
    ".git/": "list_contains(string_split({p}, '/'), '.git')",
    ".tessera/": "list_contains(string_split({p}, '/'), '.tessera')",
    "package-lock.json": "{p} = 'package-lock.json'",
    "node_modules/": "list_contains(string_split({p}, '/'), 'node_modules')",
    "dist/": "list_contains(string_split({p}, '/'), 'dist')",
    "build/": "list_contains(string_split({p}, '/'), 'build')",
    "build/keep.ts": "{p} = 'build/keep.ts'",
    "npm-debug.log*": "starts_with({p}, 'npm-debug.log') AND NOT contains({p}, '/')",
    "**/*.map": "ends_with({p}, '.map')",
    "x.map": "{p} = 'x.map'",
    "src/[a-c]?.ts": "regexp_full_match({p}, 'src/[a-c][^/][.]ts')",
}


def _sql_glob(path: str, pattern: str) -> str:
    return f"({_GLOB_SQL[pattern].format(p=path)})"


def _sql_ignored(path: str) -> str:
    """The verdict of the last matching pattern."""
    rules = [f"WHEN {_sql_glob(path, raw.removeprefix('!'))} THEN {'false' if raw.startswith('!') else 'true'}" for raw in reversed(fixtures.IGNORE)]
    return "CASE " + " ".join(rules) + " ELSE false END"


@_register("filter_ignore", f"""
WITH p AS (SELECT path, string_split(path, '/') AS parts FROM ({_PATHS})),
up AS (SELECT path, array_to_string(parts[1:n], '/') AS prefix FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS n))
SELECT path, bool_or({_sql_ignored("prefix")}) AS ignored FROM up GROUP BY path""")
def filter_ignore(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", P.ignored_with_parents(F.col("path"), fixtures.IGNORE).alias("ignored"))


@_register("glob_match", " UNION ALL ".join(f"SELECT path, {_quote(g)} AS pattern FROM ({_PATHS}) WHERE {_sql_glob('path', g)}" for g in fixtures.GLOBS))
def glob_match(spark, sf_dir):
    found = F.array_compact(F.array(*[F.when(P.glob_match(F.col("path"), g), F.lit(g)) for g in fixtures.GLOBS]))
    return _paths(spark, sf_dir).select("path", F.explode(found).alias("pattern"))


_SQL_INDEXABLE = f"path <> '{INDEX_DIR}' AND NOT starts_with(path, '{INDEX_DIR}/') AND NOT ends_with(path, '.d.ts') AND (" + " OR ".join(f"ends_with(path, '{e}')" for e in INCLUDE_EXT) + ")"


@_register("filter_indexable", f"SELECT path FROM ({_PATHS}) WHERE {_SQL_INDEXABLE}")
def filter_indexable(spark, sf_dir):
    return _paths(spark, sf_dir).filter(P.indexable(F.col("path")))


@_register("filter_ignored_dir", f"SELECT path FROM ({_PATHS}) WHERE path IN ('dist', 'node_modules') OR starts_with(path, 'dist/') OR starts_with(path, 'node_modules/') OR contains(path, '/dist/') OR contains(path, '/node_modules/')")
def filter_ignored_dir(spark, sf_dir):
    return _paths(spark, sf_dir).filter(P.in_ignored_dir(F.col("path"), ["dist", "node_modules"]))


@_register("filter_plugin_match", f"SELECT path FROM ({_PATHS}) WHERE regexp_matches(lower(path), '\\.tsx?$') AND NOT ends_with(lower(path), '.d.ts')")
def filter_plugin_match(spark, sf_dir):
    return _paths(spark, sf_dir).filter(P.plugin_match(F.col("path")))


@_register("path_safety", f"SELECT path, path NOT IN ('', '.') AND NOT starts_with(path, '/') AND NOT list_contains(regexp_split_to_array(path, '[/\\\\]'), '..') AS safe FROM ({_PATHS})")
def path_safety(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", P.safe_path(F.col("path")).alias("safe"))


@_register("to_slash", f"SELECT path, replace(path, chr(92), '/') AS slashed FROM ({_PATHS})")
def to_slash(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", T.to_slash(F.col("path")).alias("slashed"))


# Text

def _by_path(expr: Callable[[], F.Column], name: str, separator: str = " ") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _code(spark, sf_dir).select("path", F.array_join(expr(), separator).alias(name))

    return run


@_register("normalize_newlines", f"SELECT path, {_NL} AS content FROM ({_CODE})")
def normalize_newlines(spark, sf_dir):
    return _code(spark, sf_dir).select("path", T.normalize_newlines(F.col("content")).alias("content"))


@_register("split_lines", f"SELECT path, unnest(string_split({_NL}, chr(10))) AS text, unnest(range(1, len(string_split({_NL}, chr(10))) + 1))::INT AS line FROM ({_CODE})")
def split_lines(spark, sf_dir):
    return C.lines_of(_code(spark, sf_dir)).select("path", "text", "line")


_register("tokens_raw", f"SELECT path, array_to_string({_sql_words('content')}, ' ') AS tokens FROM ({_CODE})")(_by_path(lambda: T.raw_words(F.col("content")), "tokens"))
_register("tokens_identifiers", f"SELECT path, array_to_string({_sql_idents('content')}, ' ') AS tokens FROM ({_CODE})")(_by_path(lambda: T.identifiers(F.col("content")), "tokens"))
_register("tokens_filtered", f"SELECT path, array_to_string({_sql_tokens(_sql_words('content'))}, ' ') AS tokens FROM ({_CODE})")(_by_path(lambda: T.normalize_tokens(T.raw_words(F.col("content")), TOKENS), "tokens"))
_register("tokens_text", f"SELECT path, array_to_string({_sql_tokens(_sql_idents('content'))}, ' ') AS tokens FROM ({_CODE})")(_by_path(lambda: T.text_tokens(F.col("content"), TOKENS), "tokens"))
_register("tokens_no_strings", f"SELECT path, array_to_string({_sql_tokens(_sql_idents(_BARE))}, ' ') AS tokens FROM ({_CODE})")(_by_path(lambda: T.text_tokens(F.col("content"), NO_STRINGS), "tokens"))


@_register("tokens_path", f"WITH src AS (SELECT path AS raw, replace(path, chr(92), chr(47)) AS path FROM ({_PATHS})), {_STRIPPED} SELECT raw AS path, array_to_string({_sql_tokens(_sql_idents('clean'))}, ' ') AS tokens FROM stripped")
def tokens_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", F.array_join(T.path_tokens(F.col("path"), TOKENS), " ").alias("tokens"))


@_register("tokens_with_path", f"WITH {_DOCS} SELECT path, array_to_string(tokens, ' ') AS tokens FROM corpus")
def tokens_with_path(spark, sf_dir):
    return _files(spark, sf_dir).select("path", F.array_join(T.tokens_with_path(F.col("path"), F.col("content"), TOKENS), " ").alias("tokens"))


@_register("cache_key_sha1", f"SELECT path, sha1(path) AS cache_key FROM ({_CODE})")
def cache_key_sha1(spark, sf_dir):
    return _code(spark, sf_dir).select("path", F.sha1(F.col("path").cast("binary")).alias("cache_key"))


@_register("fnv64", f"""
WITH RECURSIVE f AS (SELECT path, encode(path) AS b FROM ({_CODE})),
h AS (
  SELECT path, 0 AS i, 14695981039346656037::HUGEINT AS v FROM f
  UNION ALL
  SELECT h.path, h.i + 1, (xor(h.v, ('0x' || hex(f.b[h.i + 1:h.i + 1]))::INT::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT
  FROM h JOIN f USING (path) WHERE h.i < octet_length(f.b))
SELECT path, (CASE WHEN v > 9223372036854775807 THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT AS hash64
FROM h JOIN f USING (path) WHERE h.i = octet_length(f.b)""")
def fnv64(spark, sf_dir):
    return _code(spark, sf_dir).select("path", T.fnv64(F.col("path")).alias("hash64"))


# Chunks

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_TRIMMED = _TRIM.format("text")
_KIND = (
    f"CASE WHEN starts_with(lower({_TRIMMED}), 'import ') THEN 'import' WHEN "
    + " OR ".join(f"starts_with(lower({_TRIMMED}), '{b}')" for b in C.CONST_LET)
    + " THEN 'constlet' WHEN "
    + " OR ".join(f"starts_with(lower({_TRIMMED}), '{b}')" for b in C.BOUNDARIES)
    + " THEN 'other' END"
)
_DONE = r"""(?s)"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|`[^`]*(?:`|\z)|//.*|/\*.*?\*/"""


def _sql_balance(name: str, up: str, down: str) -> str:
    only = f"regexp_replace(code, '[^\\{up}\\{down}]', '', 'g')"
    return f"""len({only}) - 2 * len(replace({only}, '{up}', '')) AS n_{name},
         coalesce(list_min(list_transform(range(0, len({only}) + 1), lambda i: i - 2 * len(replace({only}[1:i], '{up}', '')))), 0) AS l_{name}"""


_STATE = rf"""lines AS (SELECT path, unnest(string_split({_NL}, chr(10))) AS text, unnest(range(1, len(string_split({_NL}, chr(10))) + 1)) AS line FROM ({_CODE})),
a1 AS (SELECT *, regexp_replace(text, '{_DONE}', ' ', 'g') AS c0, instr(text, '*/') AS p,
       regexp_replace(substring(text, instr(text, '*/') + 2), '{_DONE}', ' ', 'g') AS c1 FROM lines),
a2 AS (SELECT *, contains(c0, '/*') AS o0, CASE WHEN p = 0 THEN true ELSE contains(c1, '/*') END AS o1 FROM a1),
a3 AS (SELECT *, CASE WHEN o0 = o1 THEN o0 END AS k, sum(CASE WHEN o0 AND NOT o1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS x FROM a2),
a4 AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER w, false) AS v, coalesce(last_value(CASE WHEN k IS NOT NULL THEN x END IGNORE NULLS) OVER w, 0) AS xs
       FROM a3 WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a5 AS (SELECT *, coalesce(lag(v <> ((x - xs) % 2 = 1)) OVER (PARTITION BY path ORDER BY line), false) AS in_comment FROM a4),
a6 AS (SELECT path, line, text, in_comment, regexp_replace(CASE WHEN in_comment THEN CASE WHEN p = 0 THEN '' ELSE c1 END ELSE c0 END, '(?s)/\*.*\z', '') AS code FROM a5),
a7 AS (SELECT *, {_sql_balance("b", "{", "}")}, {_sql_balance("p", "(", ")")} FROM a6),
a8 AS (SELECT *, coalesce(sum(n_b) OVER w, 0) AS s_b, coalesce(sum(n_p) OVER w, 0) AS s_p FROM a7
       WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT path, line, text, in_comment, (s_b - least(0, coalesce(min(s_b + l_b) OVER w, 0)))::INT AS brace_depth, (s_p - least(0, coalesce(min(s_p + l_p) OVER w, 0)))::INT AS paren_depth
       FROM a8 WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_BLOCKS = _STATE + f""",
b1 AS (SELECT path, line, CASE WHEN brace_depth = 0 AND paren_depth = 0 AND NOT in_comment THEN CASE WHEN starts_with({_TRIMMED}, 'export {{') THEN 'export' ELSE {_KIND} END END AS kind FROM state),
b2 AS (SELECT *, max(line) OVER (PARTITION BY path) AS n, min(CASE WHEN kind IS NOT NULL THEN line END) OVER (PARTITION BY path) AS first FROM b1),
b3 AS (SELECT path, line, n, first, CASE WHEN kind = 'export' THEN CASE WHEN line = first THEN 'other' END ELSE kind END AS event FROM b2),
b4 AS (SELECT * FROM b3 WHERE event IS NOT NULL OR (first IS NULL AND line = 1)),
b5 AS (SELECT *, event IS NULL OR event = 'other' OR lag(event) OVER (PARTITION BY path ORDER BY line) IS DISTINCT FROM event AS b FROM b4),
blocks AS (SELECT path, line::INT AS "start", coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, n)::INT AS "end" FROM b5 WHERE b)"""
_MERGED = _BLOCKS + f""",
m1 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY "start") AS i FROM blocks),
m2 AS (
  SELECT path, i, "start" AS s, "end" AS e FROM m1 WHERE i = 1
  UNION ALL
  SELECT m1.path, m1.i, CASE WHEN m2.e - m2.s + 1 < {SMALL.min_lines} THEN m2.s ELSE m1."start" END, m1."end" FROM m2 JOIN m1 ON m1.path = m2.path AND m1.i = m2.i + 1),
merged AS (SELECT path, s AS "start", max(e) AS "end" FROM m2 GROUP BY path, s)"""
_WINDOWS = _MERGED + f""",
w1 AS (SELECT path, "start", "end", unnest(range(0, 1 + greatest(0, ceil(("end" - "start" + 1 - {SMALL.max_lines}) / {SMALL.max_lines - SMALL.overlap_lines}.0))::INT)) AS k FROM merged),
windows AS (SELECT path, ("start" + k * {SMALL.max_lines - SMALL.overlap_lines})::INT AS "start", least("end", "start" + k * {SMALL.max_lines - SMALL.overlap_lines} + {SMALL.max_lines - 1})::INT AS "end" FROM w1),
chunked AS (SELECT w.*, row_number() OVER (PARTITION BY w.path ORDER BY w."start") - 1 AS ordinal, string_split({_NL}, chr(10)) AS lines FROM windows w JOIN ({_CODE}) f ON f.path = w.path)"""
_SNIPPET = rf"array_to_string(list_filter(list_transform(lines[\"start\":\"end\"], lambda t: {_TRIM.format('t')}), lambda t: t <> '')[1:3], chr(10))".replace('\\"', '"')


# the longest prefix with at most 120 bytes
_CUT = "left(s, list_max(list_filter(range(0, 121), lambda n: octet_length(encode(left(s, n))) <= 120)))"


@_register("classify_lines", f"WITH lines AS (SELECT path, unnest(string_split({_NL}, chr(10))) AS text, unnest(range(1, len(string_split({_NL}, chr(10))) + 1))::INT AS line FROM ({_CODE})) SELECT path, line, {_KIND} AS kind FROM lines")
def classify_lines(spark, sf_dir):
    return C.lines_of(_code(spark, sf_dir)).select("path", "line", C.line_kind(F.col("text")).alias("kind"))


@_register("brace_depth", f"WITH {_STATE} SELECT path, line::INT AS line, brace_depth, paren_depth, in_comment FROM state")
def brace_depth(spark, sf_dir):
    return C.line_state(C.lines_of(_code(spark, sf_dir))).drop("text")


@_register("chunk_blocks", f'WITH {_BLOCKS} SELECT path, "start", "end" FROM blocks')
def chunk_blocks(spark, sf_dir):
    return C.blocks(C.lines_of(_code(spark, sf_dir))).select("path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def _merged(spark, sf_dir) -> DataFrame:
    per = C.blocks(C.lines_of(_code(spark, sf_dir))).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"))
    return per.select("path", F.explode(C.merge_short(F.col("b"), SMALL.min_lines)).alias("b")).select("path", "b.start", "b.end")


@_register("chunk_min_merge", f'WITH RECURSIVE {_MERGED} SELECT path, "start", "end" FROM merged')
def chunk_min_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@_register("chunk_windows", f'WITH RECURSIVE {_WINDOWS} SELECT path, "start", "end" FROM windows')
def chunk_windows(spark, sf_dir):
    return _merged(spark, sf_dir).select("path", F.explode(C.windows(F.col("start"), F.col("end"), SMALL)).alias("w")).select("path", F.col("w.start").cast("int").alias("start"), F.col("w.end").cast("int").alias("end"))


def _chunked(spark, sf_dir) -> DataFrame:
    return C.chunk_files(_code(spark, sf_dir), SMALL)


@_register("chunk_file", f'WITH RECURSIVE {_WINDOWS} SELECT path, ordinal::INT AS ordinal, "start" AS start_line, "end" AS end_line FROM chunked')
def chunk_file(spark, sf_dir):
    return _chunked(spark, sf_dir).select("path", F.col("ordinal").cast("int").alias("ordinal"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@_register("chunk_text", f'WITH RECURSIVE {_WINDOWS} SELECT path, ordinal::INT AS ordinal, array_to_string(lines["start":"end"], chr(10)) AS text FROM chunked')
def chunk_text(spark, sf_dir):
    return _chunked(spark, sf_dir).select("path", F.col("ordinal").cast("int").alias("ordinal"), F.array_join("lines", "\n").alias("text"))


@_register("snippet", f'WITH RECURSIVE {_WINDOWS} SELECT path, ordinal::INT AS ordinal, {_CUT} AS snippet FROM (SELECT path, ordinal, {_SNIPPET} AS s FROM chunked)')
def snippet(spark, sf_dir):
    return C.chunk_files(_code(spark, sf_dir), SMALL, 120).select("path", F.col("ordinal").cast("int").alias("ordinal"), "snippet")


@_register("chunk_tokens", f"""WITH RECURSIVE {_WINDOWS}, per AS (SELECT path, ordinal, array_to_string(lines["start":"end"], chr(10)) AS content FROM chunked)
SELECT path, ordinal::INT AS ordinal, array_to_string({_sql_tokens(_sql_idents("content"))}, ' ') AS tokens FROM per""")
def chunk_tokens(spark, sf_dir):
    return _chunked(spark, sf_dir).select("path", F.col("ordinal").cast("int").alias("ordinal"), F.array_join(T.text_tokens(F.array_join("lines", "\n"), TOKENS), " ").alias("tokens"))


_PARTS = "(?s)" + "|".join(f"{q}(?:[^{q}\\\\]|\\\\.)*(?:{q}|\\\\?\\z)" for q in ("''", '"', "`")) + "|[^''\"`]+"
_BLANKED = f"array_to_string(list_transform(regexp_extract_all({_NL}, '{_PARTS}'), lambda p: CASE WHEN p[1] IN ('''', '\"', '`') THEN ' ' || regexp_replace(p, '[^' || chr(10) || ']', '', 'g') ELSE p END), '')"


@_register("file_tokens", f"""WITH RECURSIVE {_WINDOWS}, src AS (SELECT path, content FROM ({_CODE})), {_STRIPPED},
bare AS (SELECT path, clean, string_split({_BLANKED}, chr(10)) AS code FROM stripped),
per AS (SELECT c.path, c.ordinal, b.clean, array_to_string(b.code[c."start":c."end"], chr(10)) AS content FROM chunked c JOIN bare b ON b.path = c.path)
SELECT path, ordinal::INT AS ordinal, array_to_string(list_sort(list_distinct(list_concat({_sql_tokens(_sql_idents("content"))}, {_sql_tokens(_sql_idents("clean"))}))), ' ') AS tokens FROM per""")
def file_tokens(spark, sf_dir):
    """Chunks' tokens as the index gets them: literals are recognised from the file's start, the path's tokens are added."""
    files = _code(spark, sf_dir).withColumn("hash64", F.lit(None).cast("long"))  # its hashes are not asked for
    rows = I.tokenized(files, replace(EngineConfig(), token=NO_STRINGS, chunk=SMALL), joined=True, direct=True)
    return rows.select("path", F.posexplode("chunks").alias("ordinal", "c")).select("path", "ordinal", "c.tokens")


def _sql_fnv(text: str) -> str:
    """FNV-1a of a text's bytes as a fold, as an unsigned number."""
    steps = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::INT::HUGEINT)"
    return f"list_reduce([14695981039346656037::HUGEINT] || {steps}, lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)"


_SIGNED = "(CASE WHEN {0} > 9223372036854775807 THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END)::BIGINT"


@_register("content_hashes", f"WITH h AS (SELECT path, {_sql_fnv(_NL)} AS n, {_sql_fnv('content')} AS r FROM ({_CODE})) SELECT path, {_SIGNED.format('n')} AS normalised, {_SIGNED.format('r')} AS raw FROM h")
def content_hashes(spark, sf_dir):
    """FNV-1a of the contents, with normalised newlines and of the bytes as they are."""
    plain = fnv64_bulk(_code(spark, sf_dir).select("path", "content")).withColumnRenamed("hash64", "normalised")
    return fnv64_bulk(plain, normalize=False).select("path", "normalised", F.col("hash64").alias("raw"))


# Index

_CORPUS = f"""{_WINDOWS}, src AS ({_CODE}), {_STRIPPED},
cut AS (SELECT path, "start" AS start_line, "end" AS end_line, lines, array_to_string(lines["start":"end"], chr(10)) AS content, row_number() OVER (ORDER BY path, ordinal) AS chunk_id, dense_rank() OVER (ORDER BY path) AS file_id FROM chunked),
corpus AS (
  SELECT cut.*, list_sort(list_distinct(list_concat({_sql_tokens(_sql_idents("cut.content"))}, {_sql_tokens(_sql_idents("clean"))}))) AS tokens
  FROM cut JOIN stripped ON stripped.path = cut.path),
postings AS (SELECT unnest(tokens) AS term, chunk_id FROM corpus)"""


@_register("file_ids", f"SELECT path, row_number() OVER (ORDER BY path) AS file_id FROM ({_CODE})")
def file_ids(spark, sf_dir):
    return numbered(_code(spark, sf_dir).select("path"), ["path"], "file_id").rows


@_register("chunk_ids", f'WITH RECURSIVE {_WINDOWS} SELECT path, ordinal::INT AS ordinal, row_number() OVER (ORDER BY path, ordinal) AS chunk_id FROM chunked')
def chunk_ids(spark, sf_dir):
    return numbered(_chunked(spark, sf_dir).select("path", F.col("ordinal").cast("int").alias("ordinal")), ["path", "ordinal"], "chunk_id").rows


_COUNTS = f"WITH RECURSIVE {_CORPUS} SELECT (SELECT count(DISTINCT path) FROM corpus) AS file_count, (SELECT count(*) FROM corpus) AS chunk_count, (SELECT count(DISTINCT term) FROM postings) AS term_count"


@_register("index_build", _COUNTS)
def index_build(spark, sf_dir):
    """Cut, tokenise and write the index anew; the index queries that follow read it."""
    _WRITTEN[_input(spark, sf_dir)] = _written(spark, sf_dir)
    return I.counts(_stored(spark, sf_dir))


@_register("postings", f"WITH RECURSIVE {_CORPUS} SELECT term, chunk_id FROM postings")
def postings(spark, sf_dir):
    return _postings(spark, sf_dir)


@_register("postings_packed", f"""WITH RECURSIVE {_CORPUS}
SELECT term, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id, sum(chunk_id)::BIGINT AS total, true AS ascends FROM postings GROUP BY term""")
def postings_packed(spark, sf_dir):
    """The lists of all terms from their blocks: size, ends, sum of the ids, and whether every block ascends from first to last."""
    blocks = B.packed(_postings(spark, sf_dir))
    total = F.col("n") * F.col("first_id") + F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    steps = F.aggregate("ids", F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("at")), lambda a, x: F.struct((a["ok"] & (x > a["at"])).alias("ok"), x.alias("at")))
    sound = steps["ok"] & (F.col("n") == F.size("ids")) & (F.col("n") <= B.BLOCK) & (F.element_at("ids", 1) == 0) & (F.col("first_id") + steps["at"] == F.col("last_id"))
    per = blocks.select("term", "n", "first_id", "last_id", total.alias("total"), sound.alias("ok")).groupBy("term")
    return per.agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("total").alias("total"), F.bool_and("ok").alias("ascends"))


_DF = "SELECT term, count(DISTINCT chunk_id) AS df FROM postings GROUP BY term"


@_register("term_df", f"WITH RECURSIVE {_CORPUS} {_DF}")
def term_df(spark, sf_dir):
    return B.document_frequency(_stored(spark, sf_dir).blocks)


@_register("terms_dictionary", f"""WITH RECURSIVE {_CORPUS}, d AS ({_DF})
SELECT term, df, ((sum(df) OVER (ORDER BY encode(term) ROWS UNBOUNDED PRECEDING) - df) * 4)::BIGINT AS "offset" FROM d""")
def terms_dictionary(spark, sf_dir):
    return I.terms(_stored(spark, sf_dir).blocks).rows.select("term", "df", "offset")


@_register("idf", f"WITH RECURSIVE {_CORPUS}, d AS ({_DF}) SELECT term, round(ln(1 + (SELECT count(*) FROM corpus) / df), 9) AS idf FROM d")
def idf(spark, sf_dir):
    index = _stored(spark, sf_dir)
    return B.document_frequency(index.blocks).select("term", F.round(S.idf(index.chunks.count(), F.col("df")), 9).alias("idf"))


@_register("index_counts", _COUNTS)
def index_counts(spark, sf_dir):
    return I.counts(_stored(spark, sf_dir))


@_register("load_index_roundtrip", f"WITH RECURSIVE {_CORPUS} SELECT term, chunk_id FROM postings")
def load_index_roundtrip(spark, sf_dir):
    return I.load_index(spark, _written(spark, sf_dir)).postings


_SIZE = "octet_length(encode(content))::BIGINT"


@_register("load_files", f"SELECT row_number() OVER (ORDER BY path) AS file_id, path, 0::BIGINT AS mtime, {_SIZE} AS size FROM ({_CODE})")
def load_files(spark, sf_dir):
    return _stored(spark, sf_dir).files.select("file_id", "path", "mtime", "size")


@_register("load_chunks", f"""WITH RECURSIVE {_CORPUS}, c AS (SELECT *, array_to_string(list_filter(list_transform(lines[start_line:end_line], lambda t: {_TRIM.format('t')}), lambda t: t <> '')[1:3], chr(10)) AS s FROM corpus)
SELECT chunk_id, file_id, path, start_line, end_line, {_CUT.replace("120", "800").replace("121", "801")} AS snippet FROM c""")
def load_chunks(spark, sf_dir):
    line = lambda c: F.col(c).cast("int").alias(c)
    return _stored(spark, sf_dir).chunks.select("chunk_id", "file_id", "path", line("start_line"), line("end_line"), "snippet")


@_register("load_terms", _SQL["terms_dictionary"])
def load_terms(spark, sf_dir):
    return _stored(spark, sf_dir).terms.select("term", "df", "offset")


@_register("cache_validate", f"""WITH RECURSIVE {_WINDOWS} SELECT path, count(*) AS n_chunks, true AS valid FROM chunked GROUP BY path
UNION ALL SELECT * FROM (VALUES ('bad/start', 1::BIGINT, false), ('bad/end', 1::BIGINT, false), ('bad/count', 1::BIGINT, false)) v(path, n_chunks, valid)""")
def cache_validate(spark, sf_dir):
    rows = _chunked(spark, sf_dir).groupBy("path").agg(
        F.collect_list(F.struct(F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))).alias("chunks"),
        F.collect_list(T.text_tokens(F.array_join("lines", "\n"), TOKENS)).alias("tokens"),
    )
    bad = spark.createDataFrame([("bad/start", [(0, 1)], [["a"]]), ("bad/end", [(3, 2)], [["a"]]), ("bad/count", [(1, 2)], [])], "path string, chunks array<struct<start_line: bigint, end_line: bigint>>, tokens array<array<string>>")
    return Y.valid_cache(rows.unionByName(bad)).select("path", F.size("chunks").cast("long").alias("n_chunks"), "valid")


# Search and fetch

_Q = _sql_tokens(_sql_idents(_quote(QUERY)))
_SCORES = f"""{_CORPUS}, q AS (SELECT unnest({_Q}) AS term),
hits AS (SELECT DISTINCT p.term, p.chunk_id FROM postings p JOIN q USING (term)),
d AS (SELECT term, ln(1 + (SELECT count(*) FROM corpus) / count(*)) AS idf FROM hits GROUP BY term),
scored AS (SELECT chunk_id, sum(idf ORDER BY term) AS score, string_agg(term, ' ' ORDER BY term) AS why FROM hits JOIN d USING (term) GROUP BY chunk_id)"""


@_register("query_terms", f"SELECT item_id, unnest({_sql_tokens(_sql_idents('text'))}) AS term FROM benchmark")
def query_terms(spark, sf_dir):
    """The terms of each benchmark passage as a query."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(T.text_tokens(F.col("text"), TOKENS)).alias("term"))


@_register("search_scores", f"WITH RECURSIVE {_SCORES} SELECT chunk_id, round(score, 9) AS score, why FROM scored")
def search_scores(spark, sf_dir):
    index = _stored(spark, sf_dir)
    scored = S.scores(index.postings, index.chunks.count(), S.query_terms(spark, QUERY, TOKENS))
    return scored.select("chunk_id", F.round("score", 9).alias("score"), F.array_join("why", " ").alias("why"))


_SQL_TOP = f"""{_SCORES}, placed AS (SELECT s.chunk_id, c.path, c.start_line, c.end_line, c.lines, round(score, 9) AS score, why FROM scored s JOIN corpus c USING (chunk_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) AS r FROM placed),
best AS (SELECT * FROM capped WHERE r <= 2 ORDER BY score DESC, chunk_id LIMIT 20)"""


@_register("search_topk", f"WITH RECURSIVE {_SQL_TOP} SELECT chunk_id, path, start_line, end_line, score, why FROM best")
def search_topk(spark, sf_dir):
    """The best 20 chunks, at most two of a file."""
    found = S.search(_stored(spark, sf_dir), QUERY, TOKENS)
    line = lambda c: F.col(c).cast("int").alias(c)
    return found.select("chunk_id", "path", line("start_line"), line("end_line"), F.round("score", 9).alias("score"), F.array_join("why", " ").alias("why"))


@_register("results_json", f"""WITH RECURSIVE {_SQL_TOP},
shown AS (SELECT *, array_to_string(list_filter(list_transform(lines[start_line:end_line], lambda t: {_TRIM.format('t')}), lambda t: t <> '')[1:3], chr(10)) AS s FROM best)
SELECT to_json({{chunk_id: chunk_id, path: path, start_line: start_line, end_line: end_line, score: floor(score * 1000)::BIGINT, snippet: {_CUT.replace("120", "800").replace("121", "801")}, why: string_split(why, ' ')}})::VARCHAR AS result FROM shown""")
def results_json(spark, sf_dir):
    """Search results as JSON records, scores in thousandths."""
    found = S.search(_stored(spark, sf_dir), QUERY, TOKENS).withColumn("score", F.floor(F.round("score", 9) * 1000))
    return found.select(F.to_json(F.struct("*")).alias("result"))


_FETCH = (3, 1, 2, 5, 40)


@_register("fetch_lines", f"""WITH RECURSIVE {_CORPUS}, t AS (SELECT chunk_id, path, start_line AS s, end_line AS e, regexp_replace(array_to_string(lines, chr(10)), '\\n+\\z', '') AS txt FROM corpus WHERE chunk_id IN {_FETCH}),
l AS (SELECT *, string_split(txt, chr(10)) AS ls FROM t),
r AS (SELECT *, least(greatest(s, 1), len(ls)) AS f FROM l),
g AS (SELECT *, least(greatest(e, f), len(ls), f + 3) AS u FROM r)
SELECT chunk_id, path, CASE WHEN txt = '' THEN 0 ELSE f END::INT AS returned_from, CASE WHEN txt = '' THEN 0 ELSE u END::INT AS returned_to,
       CASE WHEN txt = '' THEN '' ELSE array_to_string(list_transform(range(f, u + 1), lambda i: i || '| ' || ls[i]), chr(10)) END AS lines FROM g""")
def fetch_lines(spark, sf_dir):
    out = fetching.fetch(_stored(spark, sf_dir).chunks, _code(spark, sf_dir).select("path", "content"), _FETCH, 4)
    return out.select("chunk_id", "path", "returned_from", "returned_to", F.array_join("lines", "\n").alias("lines"))


# Maintenance

_OLD = "doc_id % 7 <> 0"
_NEW_TEXT = "CASE WHEN doc_id % 5 = 0 THEN content || '!' ELSE content END"


def _manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: some files are new, some removed, some changed."""
    files = _files(spark, sf_dir).select("path", "content", F.regexp_extract("path", "([0-9]+)\\.ts$", 1).cast("long").alias("k"))
    old = files.filter("k % 7 <> 0").select("path", F.xxhash64("content").alias("hash64"))
    new = files.filter("k % 11 <> 0").select("path", F.xxhash64(F.expr("CASE WHEN k % 5 = 0 THEN content || '!' ELSE content END")).alias("hash64"))
    return old, new


_SQL_MANIFEST = f"""f AS (SELECT path, regexp_extract(path, '([0-9]+)\\.ts$', 1)::BIGINT AS k FROM ({_FILES})),
diff AS (SELECT path, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' WHEN k % 5 = 0 THEN 'modified' ELSE 'same' END AS change FROM f WHERE NOT (k % 7 = 0 AND k % 11 = 0))"""


@_register("manifest_diff", f"WITH {_SQL_MANIFEST} SELECT path, change FROM diff")
def manifest_diff(spark, sf_dir):
    return Y.manifest_diff(*_manifests(spark, sf_dir))


@_register("sync_split", f"WITH {_SQL_MANIFEST} SELECT path, CASE WHEN change = 'same' THEN 'reuse' ELSE 'rebuild' END AS action FROM diff WHERE change <> 'removed'")
def sync_split(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    changed = Y.manifest_diff(old, new).filter("change <> 'same'")
    return Y.sync_split(new.select("path"), changed, old)


@_register("changed_paths", f"SELECT DISTINCT path FROM ({_PATHS}) WHERE {_SQL_INDEXABLE}")
def changed_paths(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return Y.changed_paths(rows, rows.filter(F.length("path") % 2 == 0))


@_register("dirty_index_only", f"SELECT 'mixed' AS state, false AS dirty_index_only UNION ALL SELECT 'own', true UNION ALL SELECT 'none', false")
def dirty_index_only(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    own = rows.filter(F.startswith("path", F.lit(INDEX_DIR)))
    named = [Y.only_index_dir(r).select(F.lit(n).alias("state"), "dirty_index_only") for n, r in (("mixed", rows), ("own", own), ("none", rows.limit(0)))]
    return named[0].union(named[1]).union(named[2])


@_register("change_summary", f"""WITH p AS (SELECT DISTINCT path FROM ({_PATHS}) WHERE {_SQL_INDEXABLE})
SELECT count(*) AS changed_path_count, (SELECT string_agg(path, ' ' ORDER BY path) FROM (SELECT path FROM p ORDER BY path LIMIT 200)) AS changed_paths FROM p""")
def change_summary(spark, sf_dir):
    """The number of changed paths, and the first 200."""
    out = Y.change_summary(Y.changed_paths(_paths(spark, sf_dir), _paths(spark, sf_dir).limit(0)))
    return out.select("changed_path_count", F.array_join("changed_paths", " ").alias("changed_paths"))


_SQL_REASON = "CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'worktree' WHEN 2 THEN 'head' ELSE 'head+worktree' END"


def _reasons(spark, sf_dir) -> DataFrame:
    """A state for each document: the bits of its id say what changed."""
    n = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", Y.change_reason(n % 2 == 1, F.shiftright(n, 1) % 2 == 1).alias("reason"))


@_register("change_reasons", f"SELECT doc_id, {_SQL_REASON} AS reason FROM documents")
def change_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir)


_FLAGS = ("missing_index", "is_repo", "known", "schema_changed", "config_changed", "dirty", "dirty_index_only", "heads_differ")
_SQL_PLAN = "s AS (SELECT doc_id, " + ", ".join(f"(doc_id // {1 << i}) % 2 = 1 AS {f}" for i, f in enumerate(_FLAGS)) + """, (doc_id // 256) % 2 AS changed_path_count FROM documents),
w AS (SELECT *, CASE WHEN missing_index THEN 'missing_index' WHEN NOT is_repo THEN 'not_git_repo' WHEN NOT known THEN 'unknown' WHEN schema_changed THEN 'schema_changed'
  WHEN config_changed THEN 'config_changed' WHEN dirty_index_only AND NOT heads_differ THEN 'own' WHEN dirty AND heads_differ THEN 'git_head_and_worktree_changed'
  WHEN heads_differ THEN 'git_head_changed' WHEN dirty AND changed_path_count > 0 THEN 'git_worktree_changed' WHEN dirty THEN 'git_changed_non_indexable' ELSE 'up_to_date' END AS y FROM s),
plans AS (SELECT doc_id, CASE WHEN y IN ('own', 'up_to_date') THEN 'noop' ELSE 'full' END AS mode, CASE WHEN y = 'own' THEN 'git_changed_non_indexable' ELSE y END AS why FROM w)"""


@_register("sync_plan", f"WITH {_SQL_PLAN} SELECT doc_id, mode, why FROM plans")
def sync_plan(spark, sf_dir):
    """The decision for a state of each document: the bits of its id are the flags."""
    n = F.col("doc_id")
    state = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *[(F.shiftright(n, i) % 2 == 1).alias(f) for i, f in enumerate(_FLAGS)], (F.shiftright(n, 8) % 2).alias("changed_path_count"))
    return Y.sync_decision(state).select("doc_id", "mode", "why")


@_register("valid_enums", f"""WITH {_SQL_PLAN},
told AS (SELECT doc_id, mode || x AS mode, why || x AS why, {_SQL_REASON} || x AS change FROM plans, LATERAL (SELECT CASE doc_id % 5 WHEN 0 THEN '?' WHEN 1 THEN ' ' ELSE '' END AS x))
SELECT doc_id, mode IN ('full', 'noop', 'incremental') AS mode,
       why IN ('', 'unknown', 'up_to_date', 'missing_index', 'not_git_repo', 'schema_changed', 'config_changed') OR (starts_with(why, 'git_') AND right(why, 1) BETWEEN 'a' AND 'z') AS why,
       change IN ('', 'unknown', 'none', 'worktree', 'head', 'head+worktree') AS change FROM told""")
def valid_enums(spark, sf_dir):
    """Which of the decisions and reasons are known words; two documents of five have a damaged one."""
    x = F.when(F.col("doc_id") % 5 == 0, "?").when(F.col("doc_id") % 5 == 1, " ").otherwise("")
    rows = sync_plan(spark, sf_dir).join(_reasons(spark, sf_dir), "doc_id")
    return rows.select("doc_id", Y.valid_mode(F.concat("mode", x)).alias("mode"), Y.valid_why(F.concat("why", x)).alias("why"), Y.valid_change(F.concat("reason", x)).alias("change"))


@_register("detect_profiles", f"SELECT bool_or(path = 'package.json') AS has_package_json, true AS is_typescript FROM ({_CODE})")
def detect_profiles(spark, sf_dir):
    return scan.project_facts(_code(spark, sf_dir).select("path"))
