"""File trees, ignore files, rules and their overrides, the cache record and the command line."""

import json
import os
import subprocess

import pytest

from tessera import cli, queries
from tessera.config import EXCLUDE_DIRS, SCHEMA_VERSION, STOP_WORDS, STRIP_EXTS, EngineConfig, TokenConfig
from tessera.engine import Engine
from tessera.plans import rules as R
from tessera.plans.rules import fnv64_bytes
from tessera.sources import cache, scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ("src/a.ts", "src/_app.tsx", "src/.eslintrc.js", ".hid/x.ts", "src/[id]/{page}.ts", "_under/score.ts", "src/b b.ts"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"const x = '{name}';\n")
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "e.ts").write_text("let e;")
    os.symlink(outside, root / "linked")
    os.symlink(outside / "e.ts", root / "src/link.ts")
    return root


def test_scan_tree(spark, tree):
    there = {}
    for folder, _, names in os.walk(tree):
        for n in names:
            full = os.path.join(folder, n)
            if not os.path.islink(full):
                there[os.path.relpath(full, tree)] = (int(os.lstat(full).st_mtime), os.path.getsize(full), open(full, "rb").read())
    assert len(there) == 7
    for root in (str(tree), f"file://{tree}", f"{tree}/"):
        assert {r["path"]: (r["mtime"], r["size"], bytes(r["content"])) for r in scan.scan_tree(spark, root).collect()} == there
    listing = scan.scan_tree(spark, str(tree), with_content=False)
    assert [r["path"] for r in listing.collect()] == sorted(there) and listing.columns == ["path", "mtime", "size"]
    with pytest.raises(OSError):
        scan.scan_tree(spark, str(tree / "none"))
    gone = scan.scan_tree(spark, str(tree))
    (tree / "src/a.ts").unlink()
    with pytest.raises(Exception, match="No such file"):
        gone.collect()


def test_ignore_files(tree):
    text = "# comment\n\n  dist/ \n!keep.ts\n**/*.map\n"
    assert scan.ignore_lines(text) == ["dist/", "!keep.ts", "**/*.map"]
    assert scan.ignore_dirs(text) == ["dist", "!keep.ts", "**/*.map"]
    assert scan.read_local(str(tree / "none")) is None
    with pytest.raises(IsADirectoryError):
        scan.read_local(str(tree))


def test_profiles_and_overrides():
    assert R.profile_rules(False, False) == ([], list(R.GLOBAL_IGNORE))
    both, ignore = R.profile_rules(True, True)
    assert both == ["node", "ts_js"] and ignore == [*R.GLOBAL_IGNORE, *R.LOCK_IGNORE, *R.NODE_IGNORE, *R.TYPESCRIPT_IGNORE]
    assert R.combine("ab", None) == ("a", "b") == R.combine("ab", ["c"], "unheard of")
    assert R.combine("ab", ["c"]) == ("a", "b", "c") == R.combine("ab", ["c"], "append")
    assert R.combine("ab", ["c"], "replace") == ("c",)
    token = R.apply_override(TokenConfig(), {"stop_words": ["foo"], "allow_short": ["xy"], "allow_short_mode": "replace", "min_len": 4, "max_len": 0, "drop_hex_len": -1, "string_literals": False})
    assert token.stop_words == (*STOP_WORDS, "foo") and token.allow_short == ("xy",)
    assert (token.min_len, token.max_len, token.drop_hex_len, token.string_literals) == (4, 64, 16, False)
    plain, ts = (R.effective_rules(EngineConfig(), False, is_ts) for is_ts in (False, True))
    assert plain.token.strip_exts == () and ts.token.strip_exts == STRIP_EXTS and plain.rules_hash != ts.rules_hash
    a, b = (R.effective_rules(EngineConfig(), True, True, lines) for lines in (("x", "y"), ("y", "x")))
    assert a.scan_ignore[-2:] == ("x", "y") and a.rules_hash != b.rules_hash
    assert R.effective_rules(EngineConfig(), True, True, ("x", "y")) == a
    assert R.config_hash(b"abc", 1) == fnv64_bytes(b"abc" + (1).to_bytes(8, "little")) != R.config_hash(b"abc", 2)


def test_config():
    config = EngineConfig.from_json(EngineConfig().to_json())
    assert config == EngineConfig()
    least = EngineConfig.from_json('{"project_type": "ts"}')
    assert least.max_file_bytes == 1024 * 1024 and least.include_ext == () and least.chunk.max_lines == 0
    with pytest.raises(ValueError):
        EngineConfig.from_json('{"project_type": "go"}')


def test_cache_record(tmp_path):
    home = str(tmp_path / "home")
    assert cache.ensure_meta(home, 7, "ts") is False
    assert cache.load_meta(home) == {"cache_version": "v2", "schema_version": SCHEMA_VERSION, "config_hash": 7, "project_type": "ts"}
    os.mkdir(f"{home}/store")
    assert cache.ensure_meta(home, 7, "ts") is False and os.path.isdir(f"{home}/store")
    assert cache.ensure_meta(home, 8, "ts") is True and not os.path.exists(f"{home}/store")
    cache.save_meta(home, {**cache.load_meta(home), "schema_version": SCHEMA_VERSION - 1})
    assert cache.ensure_meta(home, 8, "ts") is True and cache.load_meta(home)["schema_version"] == SCHEMA_VERSION
    with open(cache.meta_path(home), "w") as f:
        f.write("{")
    with pytest.raises(ValueError):
        cache.ensure_meta(home, 8, "ts")


def test_rules_of_a_tree(spark, tree):
    """.scanignore, tokenize.json and hidden names reach the index; an empty HEAD matches nothing."""
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    git("init", "-q")
    (tree / ".scanignore").write_text("# mine\n_under/\n")
    engine = Engine(spark, str(tree))
    engine.init()
    with pytest.raises(FileExistsError):
        engine.init()
    engine.init(force=True)
    assert scan.ignore_dirs((tree / ".tessera/ignore").read_text()) == list(EXCLUDE_DIRS)
    (tree / ".tessera/tokenize.json").write_text(json.dumps({"stop_words": ["page"]}))
    engine.sync()
    index, _ = engine.index()
    assert {r["path"] for r in index.files.collect()} == {"src/a.ts", "src/_app.tsx", "src/.eslintrc.js", ".hid/x.ts", "src/[id]/{page}.ts", "src/b b.ts"}
    assert index.postings.filter("term = 'page'").count() == 0 < index.postings.filter("term = 'app'").count()
    state = engine.status()
    assert state["git_current_head"] == "" and not state["head_matches"]
    assert state["sync_plan"]["why"] == "git_head_and_worktree_changed" and state["git_changed_reason"] == "worktree"
    (tree / ".tessera/tokenize.json").write_text("{}")
    assert engine.status()["sync_plan"]["why"] == "config_changed"
    assert engine.sync()["cache_purged"] is True


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("init --force", {"command": "init", "force": True}),
        ("status --json", {"command": "status", "json": True}),
        ("sync --full", {"command": "sync", "full": True}),
        ("index sync", {"command": "index", "index_command": "sync", "full": False}),
        ("index status --json", {"index_command": "status", "json": True}),
        ("search words --top-k 3", {"q": "words", "top_k": 3}),
        ("search --q words", {"q_flag": "words", "top_k": 20}),
        ("fetch --ids 1,2,3 --max-lines 7", {"ids": [1, 2, 3], "max_lines": 7}),
        ("serve --stdio", {"command": "serve", "stdio": True}),
    ],
)
def test_command_line(line, wanted):
    assert wanted.items() <= vars(cli.parser().parse_args(line.split())).items()


@pytest.mark.parametrize("line", ["", "other", "index", "index other", "search a b", "search a --top-k -1", "fetch", "fetch --ids x", "fetch --ids 1 --max-lines -2", "init extra"])
def test_wrong_command_lines(line):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(line.split())


def test_command_line_runs(spark, tree, capsys):
    run = lambda line: cli.run(cli.parser().parse_args(["--root", str(tree), *line.split()]), spark)
    assert run("init") == 0 and run("index sync") == 0
    assert json.loads(capsys.readouterr().out)["file_count"] == 7
    assert run("search app") == 0
    found = json.loads(capsys.readouterr().out)
    assert [r["path"] for r in found] == ["src/_app.tsx"]
    assert run(f"fetch --ids {found[0]['chunk_id']}") == 0 and "_app.tsx" in capsys.readouterr().out
    assert run("status --json") == 0 and json.loads(capsys.readouterr().out)["indexed"] is True
    assert run("status") == 0 and "indexed: True" in capsys.readouterr().out
    assert run("search") == 2


def test_content_hashes(spark, sf_dir):
    rows = {r["path"]: r for r in queries.queries()["content_hashes"](spark, sf_dir).collect()}
    for r in queries._code(spark, sf_dir).limit(40).collect():
        raw = r["content"].encode()
        assert rows[r["path"]]["raw"] % (1 << 64) == fnv64_bytes(raw)
        assert rows[r["path"]]["normalised"] % (1 << 64) == fnv64_bytes(raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n"))
