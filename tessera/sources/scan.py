"""Sources: a tree of files, a table of documents, ignore files, a git working tree."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import INCLUDE_EXT, INDEX_DIR, EngineConfig
from tessera.operators.paths import has_extension, ignored_with_parents, known_binary, looks_binary, within_size
from tessera.plans.rules import UNSEEN_DIRS, EffectiveRules
from tessera.sources.walk import LISTING, levels, walk, with_contents

def scan_tree(spark: SparkSession, root: str, with_content: bool = True, ignore: Sequence[str] = (), hadoop: bool = False) -> DataFrame:
    """path, mtime, size (and content as binary) of the files of a tree, hidden names too; ignored folders are not entered.

    The tree is walked here and its files are read in the tasks; what cannot be listed or read is an error. Symlinked files
    and folders are left out. A tree in another store than the local one (or any, with hadoop) is listed through Hadoop.
    """
    listing = spark.createDataFrame(walk(spark, root, ignore, hadoop).files, LISTING)
    return with_contents(listing, root) if with_content else listing


def scan_table(docs: DataFrame) -> DataFrame:
    """Documents as files: path source/lang/doc_id.ts, the text as content."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")))
    text = F.coalesce("text", F.lit(""))
    return docs.select(path.alias("path"), F.lit(0).cast("long").alias("mtime"), F.octet_length(text).cast("long").alias("size"), text.alias("content"))


def apply_filters(files: DataFrame, config: EngineConfig, rules: EffectiveRules, sniff: bool = True) -> DataFrame:
    """Files that are indexed: not ignored, a source extension, no known binary, small enough; content last."""
    path = F.col("path")
    kept = files.filter(has_extension(path, config.include_ext) & ~known_binary(path) & within_size(F.col("size"), rules.max_file_bytes))
    kept = kept.filter(~ignored_with_parents(path, rules.scan_ignore))
    return kept.filter(~looks_binary(F.col("content"))) if sniff and "content" in files.columns else kept


def project_facts(paths: DataFrame) -> DataFrame:
    """has_package_json, is_typescript of a listing."""
    top = F.col("path").isin("tsconfig.json")
    hidden = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda p: p.isin(*UNSEEN_DIRS))
    source = has_extension(F.col("path")) & ~hidden
    return paths.agg(F.coalesce(F.bool_or(F.col("path") == "package.json"), F.lit(False)).alias("has_package_json"), F.coalesce(F.bool_or(top | source), F.lit(False)).alias("is_typescript"))


def tree_facts(spark: SparkSession, root: str, hadoop: bool = False) -> tuple[bool, bool]:
    """(has package.json, is TypeScript) of a tree, as `project_facts`; the walk ends at the first source file."""
    package = False
    for folders, found in levels(spark, root, [f"{d}/" for d in UNSEEN_DIRS], hadoop):
        names = [path for path, is_folder, _, _ in found if not is_folder]
        if folders == [""]:
            package = "package.json" in names
            if "tsconfig.json" in names:
                return package, True
        if any(n.lower().endswith(INCLUDE_EXT) for n in names):
            return package, True
    return package, False


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: trimmed, without blank lines and # comments."""
    return [s for s in (line.strip() for line in text.splitlines()) if s and not s.startswith("#")]


def ignore_dirs(text: str) -> list[str]:
    """Folders of an ignore file, for `in_ignored_dir`."""
    return [d for d in (s.removesuffix("/") for s in ignore_lines(text)) if d]


def read_local(path: str) -> bytes | None:
    """A driver-side file; None if there is none, other errors surface."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


# A git working tree. Paths are separated by zero bytes, so none comes quoted.


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def git_top(root: str) -> str:
    return _git(root, "rev-parse", "--show-toplevel").strip()


def is_repo(root: str) -> bool:
    done = subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True)
    return done.returncode == 0 and done.stdout.strip() == "true"


def git_head(root: str) -> str:
    done = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip()


def git_dirty(root: str) -> list[str]:
    """Changed and untracked paths of the working tree; both names of a rename."""
    fields = _git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0")
    out, i = [], 0
    while i < len(fields) and fields[i]:
        out.append(fields[i][3:])
        if fields[i][0] in "RC":
            i += 1
            out.append(fields[i])
        i += 1
    return out


def git_diff(root: str, a: str, b: str) -> list[str]:
    return [p for p in _git(root, "diff", "--name-only", "-z", a, b).split("\0") if p]


def paths_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def inside(root: str, path: str) -> bool:
    """Whether a relative path, links resolved, stays below root (local trees)."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    return full == base or full.startswith(base + os.sep)


def index_root(root: str) -> str:
    return os.path.join(root, INDEX_DIR)
