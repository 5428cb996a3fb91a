"""Block postings, pruned search, ranges, versions of an index, the store of tokens, the walk of a tree, incremental sync, streams."""

import json
import os
import re
from dataclasses import replace
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkConfig, EngineConfig, TokenConfig
from tessera.engine import Engine
from tessera.functions.text import text_tokens
from tessera.operators import blocks as B
from tessera.operators import chunk as C
from tessera.operators import index as I
from tessera.operators import literals as L
from tessera.operators import ranges as R
from tessera.operators import search as S
from tessera.operators import words
from tessera.sources import scan, store
from tessera.sources import tokens as K
from tessera.sources.walk import walk
from tessera.streaming.serve import index_stream, publish

TOKENS = TokenConfig(min_len=2)


@pytest.mark.parametrize("literals", [True, False])
def test_files_of_one_block_are_not_shuffled(spark, monkeypatch, literals):
    """Only files that a declaration or a literal may cut send lines to be shuffled, and the rows are those of all files' lines."""
    plain = [f"Some words of fileNumber{k},\n  importance or Classes ( {{ /* \n\nlast{k}" + "\nmore" * (k % 23) for k in range(40)] + ["", "\n", "\r\r\n", "x" * 3000, "an import in a line\nno_import x"]
    cut = ["import a", "one\n\u00a0\t\u3000IMPORT b\nconst c = 1\ntwo", "x\rclass A {\r}\rlet b", "export {a}\nb\nc", "\n\n\x0b Function f", "a {\ntype T\n}\ntype U", "/* \nlet x\n*/\nlet y"]
    quoted = ["it's\nimportant words", "a `\nconst b\n` c\nd", 'say "no\nmore']
    texts = [*plain, *cut, *quoted, None, "first of a path", "let second = 1", "first of a path"]
    paths = [*(f"p{i}.ts" for i in range(len(texts) - 3)), "same.ts", "same.ts", "same.ts"]
    files = spark.createDataFrame([(p, 0, 1, x) for p, x in zip(paths, texts, strict=True)], "path string, mtime long, size long, content string").repartition(3)
    config = replace(EngineConfig(), token=replace(TOKENS, string_literals=literals), chunk=ChunkConfig(max_lines=8, overlap_lines=2, min_lines=3))
    every = sorted(I.tokenized(files, config, joined=True).collect())
    seen = []
    shuffled = I.chunked_lines
    monkeypatch.setattr(I, "chunked_lines", lambda lines, *a, **k: seen.append({r[0] for r in lines.select("path").collect()}) or shuffled(lines, *a, **k))
    assert sorted(I.tokenized(files, config, joined=True, direct=True).collect()) == every and len(every) == len(set(paths)) - 1
    late = len(plain) + len(cut)
    wanted = {f"p{i}.ts" for i in range(len(plain), late)} | {"same.ts"} | {f"p{late + i}.ts" for i in range(len(quoted)) if not literals or i == 1}
    assert seen == [wanted]
    assert I.tokenized(files.limit(0), config, direct=True).count() == 0


def test_blocks_split_a_term_in_every_chunk(spark, monkeypatch):
    """One term in all chunks: no block holds more than its size, the lists come back whole, repeats fall away."""
    monkeypatch.setattr(B, "BLOCK", 50)
    rows = [("every", i) for i in range(5000)] + [("every", 7), ("far", 1), ("far", 1 << 40), ("one", 3)] + [(f"t{i % 40:02}", i * 3) for i in range(900)]
    postings = spark.createDataFrame(rows, "term string, chunk_id long").repartition(7)
    blocks = B.packed(postings).collect()
    assert max(r["n"] for r in blocks) == 50 and all(r["n"] == len(r["ids"]) for r in blocks)
    assert sum(r["term"] == "every" for r in blocks) >= 100 and sum(r["term"] == "far" for r in blocks) == 2
    for r in blocks:
        assert r["ids"][0] == 0 and r["first_id"] + r["ids"][-1] == r["last_id"] and r["ids"] == sorted(set(r["ids"]))
    back = B.unpacked(spark.createDataFrame(blocks, B.SCHEMA))
    assert sorted(tuple(r) for r in back.collect()) == sorted(set(rows))
    df = {r["term"]: r["df"] for r in B.document_frequency(spark.createDataFrame(blocks, B.SCHEMA)).collect()}
    assert df["every"] == 5000 and df["far"] == 2 and df["one"] == 1
    assert B.packed(postings.limit(0)).count() == 0


def test_lists_are_dealt_instead_of_postings(spark, monkeypatch):
    """What is sorted and shuffled are lists: a row for each term, stretch and task, whatever the number of postings."""
    monkeypatch.setattr(B, "STRETCH", 1000)
    rows = spark.range(40_000).select(F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("term"), F.floor(F.col("id") / 10).alias("chunk_id")).repartition(4)
    lists = B.listed(rows.unionByName(rows.limit(500)))
    assert lists.rows.count() <= 10 * 4 * 8 and lists.rows.agg(F.max(F.size("ids"))).head()[0] <= 1000
    whole = B.listed(rows.groupBy("chunk_id").agg(F.collect_list("term").alias("tokens")))
    for found in (lists, whole):
        back = B.merged(found.rows)
        assert back.count() < 100 and back.agg(F.sum("n")).head()[0] == 40_000
        assert sorted(map(tuple, B.unpacked(back).collect())) == sorted(map(tuple, rows.collect()))
        found.drop()


def test_tokens_in_batches(spark):
    """The finder over Arrow batches gives what the column functions give; other scripts go to those."""
    texts = ["heatThe2 HTTPServer eaux", "abcdef" * 3, "deadbeefdeadbeefdead ab", "", " \n", "caf\u00e9Gr\u00f6\u00dfe \u00c9t\u00e9 \u0178A\u00ffb \u00aa\u00ba\u00b2\u00bd x\u0130y", "\u039f\u03a3 \u03a3\u03a3", "a\u0301b \u2014 \u201cquoted\u201d 10\u20ac", "\u1e9e\u00df \u212ak", "ID id Id go js_api", "x" * 64 + " " + "y" * 65, "\u5b57abc\u0660def", "getURLFor3Ds", "THE The the"]
    for config in (TOKENS, EngineConfig().token, TokenConfig(min_len=1, drop_hex_len=0, stop_words=())):
        find = words.token_finder(config)
        wanted = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(text_tokens(F.col("x"), config, F.array(F.lit("own"))).alias("t")).collect()]
        found = [find(t, ["own"]) for t in texts]
        assert [f for f in found if f is not None] == [w for w, f in zip(wanted, found, strict=True) if f is not None]
        assert sum(f is None for f in found) == 5
        files = spark.createDataFrame([(f"{i}.ts", 0, 0, 0, t) for i, t in enumerate(texts)], "path string, mtime long, size long, hash64 long, content string")
        rows = {r["path"]: [c["tokens"] for c in r["chunks"]] for r in I.tokenized(files, replace(EngineConfig(), token=config)).collect()}
        assert rows == {f"{i}.ts": [[x for x in w if x != "own"]] for i, w in enumerate(wanted)}


def test_joined_tokens(spark, tmp_path, monkeypatch):
    """Tokens joined by a space give the index that arrays give, also where lines are cut in many runs; a line is cut once for all chunks."""
    words_of = lambda i: f"alpha{'abcdefgh'[i % 8] * 3} getThing{'xyz'[i % 3] * 4} \u00c9t\u00e9" + (" \u03a3\u03b1\u03b2\u03b3" if i % 37 == 0 else "")
    texts = ["\n".join(words_of(i * k) for i in range(40)) for k in range(1, 5)] + ["", "1 2 3"]
    files = spark.createDataFrame([(f"{i}/1.ts", 0, 0, 0, t) for i, t in enumerate(texts)], "path string, mtime long, size long, hash64 long, content string")
    config = replace(EngineConfig(), token=TOKENS, chunk=ChunkConfig(max_lines=8, overlap_lines=2, min_lines=3))
    cut = []
    run = words._cut
    monkeypatch.setattr(words, "_cut", lambda lines: cut.append(len(lines)) or run(lines))
    lines = [words_of(i) for i in range(40)]
    first = np.arange(0, 34, 6)
    tokens, known = words.tokens_of(lines, first, first + 8, pa.array([["own"]] * len(first), pa.list_(pa.string())), TOKENS)
    assert cut == [40] and known.tolist() == [False, True, True, True, True, False]
    assert tokens[1].as_py().split() == sorted({"own", *words.token_finder(TOKENS)("\n".join(lines[6:14]), [])})
    monkeypatch.undo()
    apart = {r["path"]: [c["tokens"] for c in r["chunks"]] for r in I.tokenized(files, config).collect()}
    monkeypatch.setattr(words, "SLICE", 150)
    joined = I.tokenized(files, config, joined=True)
    assert {r["path"]: [c["tokens"].split() for c in r["chunks"]] for r in joined.collect()} == apart
    assert apart["4/1.ts"] == [[]] and len(apart["0/1.ts"]) == 7
    rows = R.saved(joined, "joined").rows
    I.write_index(I.assemble(rows), str(tmp_path / "i"))
    index = I.assemble(rows)
    wanted = sorted(map(tuple, index.postings.collect()))
    assert sorted(map(tuple, I.load_index(spark, str(tmp_path / "i")).postings.collect())) == wanted
    assert len(wanted) == sum(len(t) for c in apart.values() for t in c)


def test_kinds_of_lines(spark):
    """Kinds are those of the lines trimmed and lower-cased."""
    lines = ["import x", "\u00a0IMPORT x", "import ", "import\u00a0 ", "import  \u3000", "  const a", "let", "let ", "Export Const q", "export {a}", "\tclass A", "classA", "", " ", "\u0130mport x", "tYpe t", "x import "]
    found = spark.createDataFrame([(x,) for x in lines], "x string").select(C.line_kind(F.col("x")).alias("k")).collect()
    low = [x.strip("\t\n\x0b\x0c\r\x85 \xa0\u3000").lower() for x in lines]
    assert [r["k"] for r in found] == ["import" if x.startswith("import ") else "constlet" if x.startswith(C.CONST_LET) else "other" if x.startswith(C.BOUNDARIES) else None for x in low]


def test_prefix_sums_of_terms_with_one_beginning(spark, monkeypatch):
    """Ranges are bounded by rows, whatever the values begin with."""
    monkeypatch.setattr(R, "RANGE_ROWS", 300)
    rows = spark.range(10_000).select(F.concat(F.lit("prefix"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("term"), (F.col("id") % 5 + 1).alias("df"))
    out = R.prefix_sums(rows, ["term"], F.col("df"), "offset")
    at = 0
    for r in sorted(out.rows.collect(), key=lambda r: r["term"]):
        assert r["offset"] == at
        at += r["df"]
    per = spark.read.parquet(out.path).groupBy("_range").count().agg(F.max("count")).head()[0]
    assert per < 2000
    out.drop()
    assert not os.path.exists(out.path)
    twice = R.numbered(spark.range(1000).select(F.concat(F.lit("p"), (F.col("id") % 337).cast("string")).alias("path"), F.col("id").alias("ordinal")), ["path", "ordinal"], "n").rows
    assert [r["n"] for r in sorted(twice.collect(), key=lambda r: (r["path"], r["ordinal"]))] == list(range(1, 1001))


def index_of(spark, root, postings, paths):
    """A saved index of (term, chunk) pairs; paths: of each chunk."""
    chunks = spark.createDataFrame([(i, i, p, 1, 1, "") for i, p in paths], "chunk_id long, file_id long, path string, start_line int, end_line int, snippet string")
    files = chunks.select("file_id", "path", F.lit(0).alias("mtime"), F.lit(0).alias("size"), F.lit(0).alias("hash64"))
    I.write_index(I.Index(files, chunks, spark.createDataFrame(postings, "term string, chunk_id long"), None), root)
    return I.load_index(spark, root)


def test_pruned_search(spark, tmp_path, monkeypatch):
    """The same results as without pruning, from fewer blocks than the query's terms have; ties at the k-th place and the cap included."""
    monkeypatch.setattr(B, "BLOCK", 20)
    random, postings = Random(3), set()
    for i in range(3000):
        postings.add(("common", i))
        if i % 2:
            postings.add(("often", i))
        if random.random() < 0.02 or 1000 <= i < 1030:
            postings.add(("rare", i))
        if i in (5, 77, 1001, 1002, 2400):
            postings.add(("single", i))
    index = index_of(spark, str(tmp_path / "i"), sorted(postings), [(i, f"f{i // 3}.ts") for i in range(3000)])
    assert index.blocks.count() > 200
    read_less = 0
    for words in (["common", "often", "rare", "single"], ["common", "rare"], ["often", "common"], ["rare"], ["single", "common"], ["none"], ["none", "rare", "common"]):
        for k, per in ((20, 2), (5, 1), (3, 2)):
            query = " ".join(words)
            slow = S.top(S.scores(index.postings, 3000, words).join(index.chunks, "chunk_id"), k, per).select("chunk_id", "path", "score", "why").collect()
            fast = S.search(index, query, TOKENS, k, per).select("chunk_id", "path", "score", "why").collect()
            assert [tuple(r) for r in fast] == [tuple(r) for r in slow]
            plan = S.prune(index, words, 3000, k, per)
            if plan.other:
                whole = index.blocks.filter(F.col("term").isin(plan.other)).count()
                read_less += plan.needed.count() < whole
    assert read_less >= 4


def test_cap_limits_before_the_shuffle(spark):
    rows = spark.createDataFrame([(i, "a.ts", float(i)) for i in range(50)], "chunk_id long, path string, score double")
    ranked = S.top(rows)
    assert ranked.count() == 2
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()


def test_versions(spark, tmp_path):
    """The record is never missing, old versions go, one that a reader holds stays until it is released."""
    root = str(tmp_path / "i")
    first = index_of(spark, root, [("a", 1)], [(1, "a.ts")])
    held = I.load_meta(spark, root)["version"]
    lease = store.lease(spark, root, held)
    versions = [held]
    for n in range(2, 5):
        index_of(spark, root, [("a", i) for i in range(n)], [(i, "a.ts") for i in range(n)])
        versions.append(I.load_meta(spark, root)["version"])
    there = {v for v in os.listdir(root) if os.path.isdir(f"{root}/{v}") and v != "leases"}
    assert there == {v.rsplit("/", 1)[-1] for v in (held, *versions[-2:])}
    assert first.postings.count() == 1
    store.release(spark, lease)
    index_of(spark, root, [("a", 1)], [(1, "a.ts")])
    assert not os.path.exists(held) and len(I.load_meta(spark, root)["history"]) == I.VERSIONS
    store.lease(spark, root, versions[-1])
    assert store.leases(spark, root, 3600) == {versions[-1].rsplit("/", 1)[-1]} and store.leases(spark, root, -10) == set() == store.leases(spark, root, 3600)


def entries(spark, *rows):
    return spark.createDataFrame([(p, m, 1, m, [(1, 1, "", t)]) for p, m, t in rows], "path string, mtime long, size long, hash64 long, chunks array<struct<start_line: bigint, end_line: bigint, snippet: string, tokens: array<string>>>")


def test_token_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_SEGMENTS", 3)
    root, wanted, random = str(tmp_path / "s"), {}, Random(1)
    assert K.TokenStore(spark, root, 8).tokens().count() == 0
    for n in range(9):
        changed = {f"f{random.randrange(40)}.ts": (n, [f"w{n}"]) for _ in range(40 if n == 0 else 2)}
        gone = random.sample(sorted(set(wanted) - set(changed)), 1) if n % 3 == 2 else []
        kept = K.TokenStore(spark, root, 8)
        written = kept.apply(entries(spark, *((p, m, t) for p, (m, t) in changed.items())), spark.createDataFrame([(p,) for p in gone], "path string"), name=f"batch-{n}")
        assert written == len(changed) + len(gone)
        assert kept.apply(entries(spark, ("other.ts", 1, ["x"])), name=f"batch-{n}") == 0  # it is there already
        wanted |= changed
        for p in gone:
            del wanted[p]
        again = K.TokenStore(spark, root)
        assert {r["path"]: (r["mtime"], r["chunks"][0]["tokens"]) for r in again.tokens().collect()} == wanted
        assert {r["path"] for r in again.manifest().collect()} == set(wanted)
        held = [b for s in again.record["segments"] for b in s["buckets"]]
        assert max(held.count(b) for b in held) <= 3
        on_disk = {d for d in os.listdir(root) if os.path.isdir(f"{root}/{d}")}
        assert on_disk == {s["id"] for s in again.record["segments"]}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ("src/a.ts", "src/_b.ts", ".hid/c.ts", "src/deep/er/d.ts", "node_modules/pkg/lib/e.ts", "src/node_modules/f.ts", "dist/g.ts", "_under/h.ts"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"export const {name[-4]}Value = '{name}';\n")
    os.symlink(root / "src", root / "linked")
    os.symlink(root / "src/a.ts", root / "src/link.ts")
    return str(root)


def test_walk_prunes_and_is_the_same_through_hadoop(spark, tree):
    every = walk(spark, tree)
    assert len(every.files) == 8 and "node_modules/pkg/lib" in every.entered
    pruned = walk(spark, tree, ("node_modules/", "dist/", "!dist/g.ts"))
    assert [f[0] for f in pruned.files] == [".hid/c.ts", "_under/h.ts", "src/_b.ts", "src/a.ts", "src/deep/er/d.ts"]
    assert set(pruned.entered) == {"", ".hid", "_under", "src", "src/deep", "src/deep/er"}
    through = walk(spark, f"file://{tree}", ("node_modules/", "dist/"), hadoop=True)
    assert through.files == pruned.files and sorted(through.entered) == sorted(pruned.entered)
    rows = {r["path"]: bytes(r["content"]).decode() for r in scan.scan_tree(spark, f"file://{tree}", ignore=("node_modules/", "dist/"), hadoop=True).collect()}
    assert rows == {p: open(f"{tree}/{p}").read() for p, _, _ in pruned.files}


def test_walk_lists_many_folders_in_tasks(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"d{i:02}/x").mkdir(parents=True)
        (tmp_path / f"d{i:02}/x/f.ts").write_text("1")
    assert [f[0] for f in walk(spark, str(tmp_path)).files] == [f"d{i:02}/x/f.ts" for i in range(90)]


def test_tree_facts(spark, tree, tmp_path):
    assert scan.tree_facts(spark, tree) == (False, True)
    other = tmp_path / "plain"
    (other / "dist").mkdir(parents=True)
    (other / "dist/x.ts").write_text("")
    (other / "package.json").write_text("{}")
    assert scan.tree_facts(spark, str(other)) == (True, False)
    for root in (tree, str(other)):
        facts = scan.project_facts(scan.scan_tree(spark, root, with_content=False)).head()
        assert scan.tree_facts(spark, root) == (facts["has_package_json"], facts["is_typescript"])


def rows_of(index):
    return [sorted(tuple(r) for r in t.collect()) for t in (index.files.drop("mtime"), index.chunks, index.postings, index.terms)]


def test_incremental_sync(spark, tmp_path):
    """One file of many is changed: only its entry is written, unchanged files are not read, the index is as a full build's."""
    root = tmp_path / "tree"
    for i in range(200):
        (root / f"d{i % 7}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 7}/f{i}.ts").write_text(f"export const value{chr(97 + i % 26)}x = {i};\n")
    (root / "binary.ts").write_bytes(b"\xff\xfea\0b")
    engine = Engine(spark, str(root))
    engine.init()
    assert engine.sync()["entries_written"] == 201
    assert engine.sync()["entries_written"] == 0  # no repository: planned as full, but nothing changed
    # a file with the size and time of its entry is not opened: its new content must not show
    quiet = root / "d1/f1.ts"
    info = os.stat(quiet)
    quiet.write_text(quiet.read_text().replace("value", "other"))
    os.utime(quiet, ns=(info.st_atime_ns, info.st_mtime_ns))
    (root / "d2/f2.ts").write_text("export const altered = 1;\n")
    os.utime(root / "d3/f3.ts", (1, 1))  # touched: read, its hash is known, its tokens stay
    (root / "d4/f4.ts").unlink()
    done = engine.sync()
    assert done["entries_written"] == 3 and done["file_count"] == 199
    index, _ = engine.index()
    assert {r["path"] for r in index.files.filter("mtime = 1").collect()} == {"d3/f3.ts"}
    assert index.terms.filter("term = 'altered'").count() == 1 and index.terms.filter("term = 'other'").count() == 0
    quiet.write_text(quiet.read_text().replace("other", "value"))
    os.utime(quiet, ns=(info.st_atime_ns, info.st_mtime_ns))
    incremental = rows_of(index)
    assert engine.sync(full=True)["entries_written"] == 200
    assert rows_of(engine.index()[0]) == incremental
    engine.close()


def test_served_engine_keeps_its_tables(spark, tmp_path):
    (tmp_path / "a.ts").write_text("export const alpha = 1;\n")
    engine = Engine(spark, str(tmp_path), served=True)
    engine.init()
    engine.sync()
    first = engine.index()[0]
    assert first.blocks.is_cached and engine.search("alpha")[0]["path"] == "a.ts"
    (tmp_path / "b.ts").write_text("export const beta = 1;\n")
    engine.sync()
    assert engine.search("beta")[0]["path"] == "b.ts"
    assert not first.blocks.is_cached and engine.index()[0].blocks.is_cached
    assert len(os.listdir(tmp_path / ".tessera/leases")) >= 1
    engine.close()
    assert [f for f in os.listdir(tmp_path / ".tessera/leases") if not f.startswith(".")] == []


def test_stream(spark, tmp_path):
    """Batches add segments as large as themselves; a path that comes again is replaced; what is published is the whole."""
    source, schema, home = tmp_path / "in", "path string, mtime long, size long, content string", str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, schema)
    rows(*[(f"f{i}.ts", 1, 5, f"alpha_{chr(97 + i)}x") for i in range(20)]).write.parquet(str(source))
    files = spark.readStream.schema(schema).parquet(str(source))
    for n in range(4):
        if n:
            rows(("f0.ts", n + 1, 5, f"turn_{chr(97 + n)}x"), (f"new{n}.ts", 1, 5, "fresh")).coalesce(1).write.mode("append").parquet(str(source))
        index_stream(files, EngineConfig(), home, str(tmp_path / "state")).awaitTermination()
    record = json.loads(open(f"{home}/segments").read())
    assert [s["rows"] for s in record["segments"]] == [20, 2, 2, 2]
    publish(spark, home, str(tmp_path / "index"))
    index = I.load_index(spark, str(tmp_path / "index"))
    found = {r["term"] for r in index.terms.collect()}
    assert index.files.count() == 23 and {"fresh", "turn"} <= found and "ax" not in found


def test_literals_line_by_line(spark, monkeypatch):
    """Lines without literals equal the whole file's text without them, whatever spans lines; blocks of lines are crossed."""
    monkeypatch.setattr(L, "BLOCK", 3)
    random, files = Random(8), []
    for i in range(60):
        bits = ["'", '"', "`", "\\", "\n", "word", " ", "x\n", "\\\n"]
        files.append((f"{i}.ts", "".join(random.choices(bits, (2, 2, 2, 2, 6, 8, 4, 4, 1), k=random.randint(0, 120)))))
    df = spark.createDataFrame([*files, ("none.ts", "")], "path string, content string")
    found = {}
    for r in L.without_literals(C.lines_of(df)).collect():
        found.setdefault(r["path"], {})[r["line"]] = r["code"]
    literal = re.compile("(?s)" + "|".join(f"{q}(?:[^{q}\\\\]|\\\\.)*(?:{q}|\\\\?\\Z)" for q in "'\"`"))
    for path, content in files:
        wanted = literal.sub(lambda m: " " + re.sub("[^\n]", "", m.group()), content).split("\n")
        assert [found[path][k + 1] for k in range(len(wanted))] == wanted, content
    assert found["none.ts"] == {1: ""}
