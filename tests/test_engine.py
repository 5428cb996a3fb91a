"""Tokens, chunks, ranking and fetching on hand-made inputs, and the engine over a git working tree."""

import io
import json
import math
import subprocess
from dataclasses import replace
from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.config import ChunkConfig, TokenConfig
from tessera.engine import Engine
from tessera.functions import text as T
from tessera.operators import chunk as C
from tessera.operators import fetch as fetching
from tessera.operators import hashing
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.operators.hashing import fnv64_bulk, fnv64_many
from tessera.plans.rules import fnv64_bytes
from tessera.streaming.serve import MAX_REQUEST, serve

TOKENS = TokenConfig(min_len=2, max_len=64, drop_hex_len=16, allow_short=("id", "ui"), stop_words=("const",), strip_suffixes=(".d.ts.map", ".d.tsx", ".d.ts"), strip_exts=(".ts", ".tsx"))


def tokens(spark, text, config=TOKENS):
    return spark.createDataFrame([(text,)], "t string").select(T.text_tokens(F.col("t"), config)).head()[0]


def _parts(random):
    """Lower-case words that no rule drops."""
    return ["".join(random.choice("ghjklmnopqrstuvwxyz") for _ in range(random.randint(3, 9))) for _ in range(random.randint(1, 4))]


def test_identifiers_of_every_style(spark):
    """Identifiers made from known parts, in all styles and with digits between, give back just their parts."""
    random, rows = Random(5), []
    for _ in range(300):
        parts, kept = [], set()
        for _ in range(random.randint(1, 5)):
            words = _parts(random)
            style = random.randrange(6)
            joined = (
                "_".join(words), "-".join(words), ".".join(words), "/".join(words),
                "".join(w if i == 0 else w.title() for i, w in enumerate(words)),
                "".join(w.title() + str(random.randint(0, 99)) for w in words),
            )[style]
            parts.append(joined)
            kept |= set(words)
        rows.append((random.choice([" ", "; ", "(", " = "]).join(parts), sorted(kept)))
    df = spark.createDataFrame(rows, "t string, kept array<string>")
    wrong = df.filter(T.text_tokens(F.col("t"), TOKENS) != F.col("kept"))
    assert wrong.collect() == []


def test_acronym_before_a_word(spark):
    """The last capital of a run belongs to the word that follows it; a run at the end stays whole."""
    random = Random(6)
    for _ in range(3):
        head, word, tail = (random.choice(_parts(random)) for _ in range(3))
        assert set(tokens(spark, head.upper() + word.title() + tail.upper())) == {head, word, tail}


def test_path_words_join_the_text(spark):
    rows = spark.createDataFrame([("tide/gauge_map.ts", "moon phase")], "p string, t string")
    assert rows.select(T.tokens_with_path(F.col("p"), F.col("t"), TOKENS)).head()[0] == ["gauge", "map", "moon", "phase", "tide"]


def test_lower_case_by_character(spark):
    assert tokens(spark, "ΛΟΓΟΣ İstanbul ΣΑΣ") == ["istanbul", "λογοσ", "σασ"]


@pytest.mark.parametrize(
    ("text", "change", "kept"),
    [
        ("fern zzzzzzzzz", {"max_len": 8}, ["fern"]),  # too long
        ("ox ui elm", {"min_len": 3, "allow_short": ("ui",)}, ["elm", "ui"]),  # too short, unless allowed
        ("oak 2048 7", {}, ["oak"]),  # numbers
        ("deadbeefdeadbeef feedfacefeedfac", {}, ["feedfacefeedfac"]),  # 16 letters that read as hexadecimal, and 15
        ("CONST Const ash", {}, ["ash"]),  # a stop word in any case
        ("say('pine tree') + birch", {"string_literals": False}, ["birch", "say"]),  # a literal
        (r"'a\'pine' birch", {"string_literals": False}, ["birch"]),  # a quote that is escaped
        ("`pine\nfir` birch", {"string_literals": False}, ["birch"]),  # a literal over lines
        ('birch "pine', {"string_literals": False}, ["birch"]),  # a literal that does not end
        ("größeÜber naïve", {}, ["größe", "naïve", "über"]),  # letters of any script
        ("yew Yew YEW", {}, ["yew"]),  # a set
        ("", {}, []),
    ],
)
def test_token_rules(spark, text, change, kept):
    assert tokens(spark, text, replace(TOKENS, **change)) == kept


@pytest.mark.parametrize(
    ("content", "config", "ranges"),
    [
        ("import './p';\nimport './q';\nclass Tide {\n}", (9, 2, 1), [(1, 2), (3, 4)]),  # imports are one block
        ("const low = 1;\nlet high = 2;\ntype Level = 3;", (9, 2, 1), [(1, 2), (3, 3)]),  # so are constants and variables
        ("class Tide {\n  const low = 1;\n}\nlet high;", (9, 2, 1), [(1, 3), (4, 4)]),  # a declaration inside braces is none
        ("/* open\nclass Tide {\n*/ x\nlet high;", (9, 2, 1), [(4, 4)]),  # nor one inside a comment
        ("rise();\nfall();\n", (9, 2, 1), [(1, 3)]),  # a file without declarations is one block
        ("enum Moon {\r\n}\r\ntype Phase = 1;\r\n", (9, 2, 1), [(1, 2), (3, 4)]),  # carriage returns
        ("class A {}\nclass B {}\nclass C {}", (9, 2, 2), [(1, 2), (3, 3)]),  # short blocks take the next one in
        ("", (9, 2, 1), [(1, 1)]),
    ],
)
def test_chunks(spark, content, config, ranges):
    files = spark.createDataFrame([("a.ts", content)], "path string, content string")
    assert [(r["start"], r["end"]) for r in C.chunk_ranges(files, ChunkConfig(*config)).head()["chunks"]] == ranges


def test_windows_of_any_size(spark):
    """Windows of a block against a loop: each begins overlap lines before the last one's end, the last ends with the block."""
    for most, overlap in ((4, 1), (7, 3), (5, 0), (3, 3)):
        rows = spark.range(1, 40).select(F.col("id").cast("int").alias("n")).select("n", C.windows(F.lit(1), F.col("n"), ChunkConfig(most, overlap, 1)).alias("w")).collect()
        for r in rows:
            stride, at, wanted = (most - overlap) or most, 1, []
            while True:
                wanted.append((at, min(r["n"], at + most - 1)))
                if wanted[-1][1] == r["n"]:
                    break
                at += stride
            assert [tuple(w) for w in r["w"]] == wanted


def test_hash(spark):
    rows = spark.createDataFrame([("a\r\nb",), ("",), (None,)], "content string")
    found = [r["hash64"] % (1 << 64) for r in fnv64_bulk(rows).collect()]
    assert found == [fnv64_bytes(b"a\nb"), fnv64_bytes(b""), fnv64_bytes(b"")]
    raw = [r["hash64"] % (1 << 64) for r in fnv64_bulk(rows, normalize=False).collect()]
    assert raw == [fnv64_bytes(b"a\r\nb"), fnv64_bytes(b""), fnv64_bytes(b"")]
    values = [bytes(range(256)) * 9, b"", b"x", b"\xff" * 4097, b""]
    assert fnv64_many(values).tolist() == [fnv64_bytes(v) for v in values] and len(fnv64_many([])) == 0
    by_expression = rows.select(T.fnv64(T.normalize_newlines(F.col("content"))).alias("h")).collect()
    assert by_expression[0]["h"] % (1 << 64) == found[0]


def test_hash_of_many(monkeypatch):
    """Many values are hashed together; what only a few long ones have follows in steps."""
    random = Random(1)
    values = [random.randbytes(random.choice([0, 1, 80, random.randrange(400)])) for _ in range(200)] + [random.randbytes(n) for n in (9000, 4001)]
    steps, advance = [], hashing._advance
    monkeypatch.setattr(hashing, "STEP", 2000)
    monkeypatch.setattr(hashing, "_advance", lambda state, raw, sizes: steps.append(len(raw)) or advance(state, raw, sizes))
    for some in (values, values[-5:]):
        assert fnv64_many(some).tolist() == [fnv64_bytes(v) for v in some]
    assert max(steps) <= 2000 and sum(steps) < 40_000


def index_of(spark, chunks, postings):
    return I.Index(None, spark.createDataFrame([(i, f, p, 1, 1, "") for i, f, p in chunks], "chunk_id long, file_id long, path string, start_line int, end_line int, snippet string"), spark.createDataFrame(postings, "term string, chunk_id long"), None)


# The small indexes of the next two tests and the line ranges of test_fetch are vectors on which engines of this kind must agree.


def test_ranking(spark):
    index = index_of(spark, [(1, 1, "a.ts"), (2, 2, "b.ts"), (3, 3, "c.ts")], [("alpha", 1), ("alpha", 2), ("beta", 2), ("beta", 3)])
    found = S.search(index, "alpha beta", TOKENS).collect()
    assert [r["chunk_id"] for r in found] == [2, 1, 3]
    assert found[0]["score"] == pytest.approx(2 * math.log(1 + 3 / 2))
    assert found[0]["why"] == ["alpha", "beta"]
    assert S.search(index, "  ", TOKENS) is None


def test_cap_per_file(spark):
    index = index_of(spark, [(1, 1, "same.ts"), (2, 1, "same.ts"), (3, 1, "same.ts"), (4, 2, "other.ts")], [("alpha", i) for i in (1, 2, 3, 4)])
    assert [r["chunk_id"] for r in S.search(index, "alpha", TOKENS).collect()] == [1, 2, 4]


def test_option_clamps(spark):
    """Limits that are not positive or too large become the fixed ones: 20 results, 2 of a file; 5 ids, 120 lines."""
    rows = spark.createDataFrame([(i, f"{i // 3}.ts", float(i)) for i in range(90)], "chunk_id long, path string, score double")
    assert [S.top(rows, k).count() for k in (0, -3, 7, 20, 500)] == [20, 20, 7, 20, 20]
    assert [S.top(rows.filter("path = '1.ts'"), 9, per).count() for per in (0, -1, 1, 3)] == [2, 2, 1, 3]
    text = "\n".join(map(str, range(1, 301)))
    got = lambda most: spark.createDataFrame([(text,)], "t string").select(fetching.fetched(F.col("t"), F.lit(1), F.lit(300), most).alias("f")).head()["f"]["returned_to"]
    assert [got(n) for n in (0, -5, 30, 120, 5000)] == [120, 120, 30, 120, 120]
    chunks = spark.createDataFrame([(i, "a.ts", i, i) for i in range(1, 9)], "chunk_id long, path string, start_line int, end_line int")
    content = spark.createDataFrame([("a.ts", text)], "path string, content string")
    assert [r["chunk_id"] for r in fetching.fetch(chunks, content, [7, 3, 1, 2, 8, 4, 5]).collect()] == [7, 3, 1, 2, 8]


@pytest.mark.parametrize(("content", "start", "end", "most", "got"), [("\n".join(f"line {i}" for i in range(1, 151)), 1, 150, 10, (1, 10)), ("", 1, 9, 0, (0, 0)), ("a\nb\nc\n", 0, 10, 0, (1, 3)), ("a\r\nb\r\nc\r\n", 0, 10, 0, (1, 3))])
def test_fetch(spark, content, start, end, most, got):
    row = spark.createDataFrame([(content,)], "t string").select(fetching.fetched(F.col("t"), F.lit(start), F.lit(end), most).alias("f")).head()["f"]
    assert (row["returned_from"], row["returned_to"]) == got
    assert len(row["lines"]) == (got[1] - got[0] + 1 if got[0] else 0)
    assert not row["lines"] or row["lines"][0].startswith("1| ")


def test_engine(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "a.ts").write_text("import x from 'x';\n\nexport function alphaBeta() {\n  return 1;\n}\n")
    (root / "b.ts").write_text("export const gamma = 2;\n")
    (root / "logo.png").write_bytes(b"\x89PNG\0")
    (root / ".gitignore").write_text(".tessera/\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    engine = Engine(spark, str(root))
    assert engine.status()["sync_plan"]["why"] == "missing_index"
    engine.init()
    done = engine.sync()
    assert done["file_count"] == 2
    state = engine.status()
    assert state["sync_plan"]["mode"] == "noop" and state["git_worktree_clean"] and state["head_matches"] and state["git_changed_reason"] == "none"
    found = engine.search("alpha beta")
    assert found[0]["path"] == "a.ts"
    lines = engine.fetch([found[0]["chunk_id"]])[0]["lines"]
    assert lines[0] == "1| import x from 'x';"
    loaded = engine.index()[0]
    assert engine.index()[0] is loaded  # the same tables until another version is current
    (root / "b.ts").write_text("export const delta = 3;\n")
    state = engine.status()
    assert state["sync_plan"]["mode"] == "full" and state["git_changed_reason"] == "worktree" and state["git_changed_paths"] == ["b.ts"]
    assert engine.sync()["cache_purged"] is False
    assert engine.index()[0] is not loaded
    assert engine.search("gamma") == [] and engine.search("delta")[0]["path"] == "b.ts"
    sink = io.BytesIO()
    requests = [b"nonsense\n", b'{"op": "other"}\n', b"x" * (MAX_REQUEST + 9) + b"\n", b'{"op": "search", "q": "delta"}\n', json.dumps({"op": "fetch", "ids": [found[0]["chunk_id"]]}).encode()]
    serve(engine, io.BytesIO(b"".join(requests)), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r["ok"] for r in replies] == [False, False, False, True, True]
    assert replies[3]["data"][0]["path"] == "b.ts"
