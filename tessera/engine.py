"""The engine over one source tree: init, status, sync, search, fetch."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.config import EXCLUDE_DIRS, SCHEMA_VERSION, EngineConfig
from tessera.operators import fetch as fetching
from tessera.operators import search as searching
from tessera.operators.hashing import fnv64_bulk
from tessera.operators.index import Index, assemble, load_meta, load_version, tokenized, write_index
from tessera.operators.paths import looks_binary
from tessera.operators.ranges import saved
from tessera.plans.rules import EffectiveRules, config_hash, effective_rules
from tessera.plans.sync import STATE, change_reason, change_summary, changed_paths, only_index_dir, purges, sync_decision
from tessera.sources import cache, scan, store
from tessera.sources.tokens import TokenStore


class Engine:
    """Commands over the tree at root; the index is in its index folder."""

    def __init__(self, spark: SparkSession, root: str, served: bool = False):
        self.spark, self.root, self.served = spark, os.path.abspath(root), served
        self.home = scan.index_root(self.root)
        self._index: tuple[str, Index, int] | None = None
        self._lease: str | None = None

    def init(self, force: bool = False) -> None:
        if os.path.isdir(self.home):
            if not force:
                raise FileExistsError(f"{self.home} exists; use --force")
            shutil.rmtree(self.home)
        os.makedirs(self.home)
        with open(os.path.join(self.home, "config.json"), "w") as f:
            f.write(EngineConfig().to_json())
        with open(os.path.join(self.home, "ignore"), "w") as f:
            f.writelines(f"{d}/\n" for d in EXCLUDE_DIRS)

    def config(self) -> tuple[EngineConfig, bytes]:
        raw = scan.read_local(os.path.join(self.home, "config.json"))
        if raw is None:
            raw = EngineConfig().to_json().encode()
        return EngineConfig.from_json(raw), raw

    def rules(self, config: EngineConfig) -> EffectiveRules:
        package, typescript = scan.tree_facts(self.spark, self.root)
        user = scan.read_local(os.path.join(self.root, ".scanignore")) or b""
        override = json.loads(scan.read_local(os.path.join(self.home, "tokenize.json")) or b"{}")
        return effective_rules(config, package, typescript, scan.ignore_lines(user.decode()), override)

    def _meta(self) -> dict | None:
        return load_meta(self.spark, self.home) if os.path.exists(os.path.join(self.home, "meta")) else None

    def status(self) -> dict:
        """The state of the index and of the working tree, and what a sync would do."""
        config, raw = self.config()
        rules = self.rules(config)
        meta = self._meta()
        repo = scan.is_repo(self.root)
        head = scan.git_head(self.root) if repo else ""
        dirty = scan.git_dirty(self.root) if repo else []
        base = meta["repo_head"] if meta else ""
        moved = bool(base and head) and head != base
        matches = bool(base and head) and head == base
        known, between = True, []
        if moved:
            try:
                between = scan.git_diff(self.root, base, head)
            except subprocess.CalledProcessError:
                known = False
        frame = lambda paths: scan.paths_frame(self.spark, paths)
        changed = change_summary(changed_paths(frame(dirty), frame(between))).head()
        reason = F.when(~F.lit(known), "unknown").otherwise(change_reason(F.lit(bool(dirty)), F.lit(moved)))
        only_own = only_index_dir(frame(dirty)).head()["dirty_index_only"]
        state = {
            "missing_index": meta is None,
            "is_repo": repo,
            "known": known,
            "schema_changed": bool(meta) and meta["schema_version"] != SCHEMA_VERSION,
            "config_changed": bool(meta) and meta["config_hash"] != config_hash(raw, rules.rules_hash),
            "dirty": bool(dirty),
            "dirty_index_only": only_own,
            "heads_differ": bool(meta) and repo and not matches,
            "changed_path_count": changed["changed_path_count"],
        }
        plan = sync_decision(self.spark.createDataFrame([state], STATE).withColumn("reason", reason)).head()
        out = {
            "indexed": meta is not None,
            "dirty": plan["mode"] != "noop",
            "changed_files": changed["changed_path_count"],
            "profiles": list(rules.profiles),
            "schema_version": SCHEMA_VERSION,
            "git_repo": repo,
            "git_base_head": base,
            "git_current_head": head,
            "head_matches": matches,
            "git_worktree_clean": not dirty,
            "git_dirty_path_count": len(dirty),
            "git_dirty_index_only": only_own,
            "git_changed_reason": plan["reason"] if repo else "",
            "git_changed_paths": changed["changed_paths"],
            "git_changed_path_count": changed["changed_path_count"],
            "sync_plan": {"mode": plan["mode"], "why": plan["why"], "base_head": base, "current_head": head, "worktree_clean": not dirty, "changed_paths": changed["changed_paths"], "changed_path_count": changed["changed_path_count"]},
        }
        if meta:
            out |= {k: meta[k] for k in ("indexed_at_unix", "file_count", "chunk_count", "term_count")}
        return out

    def sync(self, full: bool = False) -> dict:
        """Bring the index up to date.

        A file with the path, time and size of its entry, and not among git's changed paths, is not read. Of the others,
        which are read and hashed once, those with the hash of their entry keep their tokens. Only what changed is
        written to the store of tokens; the index is a new version made from the store.
        """
        status = self.status()
        plan = status["sync_plan"]
        if plan["mode"] == "noop" and not full:
            return plan
        config, raw = self.config()
        rules = self.rules(config)
        listing = scan.apply_filters(scan.scan_tree(self.spark, self.root, False, rules.scan_ignore), config, rules)
        purged = cache.ensure_meta(self.home, config_hash(raw, rules.rules_hash), config.project_type)
        if full or purged or purges(plan["why"]):
            cache.purge(self.home)
        entries = TokenStore(self.spark, cache.store_path(self.home))
        known = entries.manifest().select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("hash64").alias("_h"))
        unchanged = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
        doubtful = scan.paths_frame(self.spark, self._changed_paths(status))
        same = listing.join(known, "path").filter(unchanged).join(doubtful, "path", "left_anti").select("path")
        read = fnv64_bulk(scan.with_contents(listing.join(same, "path", "left_anti"), self.root))
        read = saved(read.join(known.select("path", "_h"), "path", "left"), "read")
        text = read.rows.filter(~looks_binary(F.col("content")))
        other = read.rows.filter(looks_binary(F.col("content"))).select("path", "mtime", "size", "hash64", F.lit(None).cast("string").alias("chunks"))
        hit = text.filter(F.col("hash64") == F.col("_h")).select("path", "mtime", "size", "hash64")
        kept = hit.join(entries.entries().select("path", "chunks"), "path")
        fresh = tokenized(text.filter(~F.col("hash64").eqNullSafe(F.col("_h"))).select("path", "mtime", "size", "hash64", F.col("content").cast("string").alias("content")), replace(config, token=rules.token))
        changed = kept.unionByName(fresh).unionByName(other.withColumn("chunks", F.lit(None).cast(kept.schema["chunks"].dataType)))
        written = entries.apply(changed, known.select("path").join(listing, "path", "left_anti"))
        read.drop()
        head = scan.git_head(self.root) if scan.is_repo(self.root) else ""
        meta = write_index(assemble(entries.tokens()), self.home, config_hash(raw, rules.rules_hash), head)
        return plan | {"cache_purged": purged, "entries_written": written} | {k: meta[k] for k in ("file_count", "chunk_count", "term_count")}

    def _changed_paths(self, status: dict) -> list[str]:
        """Paths that git calls changed in the working tree or since the index's commit."""
        if not status["git_repo"]:
            return []
        base, head = status["git_base_head"], status["git_current_head"]
        try:
            return [*scan.git_dirty(self.root), *(scan.git_diff(self.root, base, head) if base and head and base != head else [])]
        except subprocess.CalledProcessError:
            return scan.git_dirty(self.root)  # an unknown commit: time and size decide

    def index(self) -> tuple[Index, int]:
        """The current index with its number of chunks: the same tables until another version is current.

        The version is leased, so no sync deletes it; a served engine also keeps its tables in memory, or on disk beyond it.
        """
        meta = self._meta()
        if meta is None:
            raise FileNotFoundError("index not found; run sync")
        if self._index is None or self._index[0] != meta["version"]:
            lease = store.lease(self.spark, self.home, meta["version"])
            while not store.exists(self.spark, meta["version"]):  # it went before the lease was there
                store.release(self.spark, lease)
                meta = self._meta()
                lease = store.lease(self.spark, self.home, meta["version"])
            self.close()
            self._lease = lease
            self._index = (meta["version"], load_version(self.spark, meta["version"]), meta["chunk_count"])
            if self.served:
                for table in (self._index[1].chunks, self._index[1].blocks, self._index[1].terms):
                    table.persist(StorageLevel.MEMORY_AND_DISK)
        return self._index[1:]

    def close(self) -> None:
        """Let go of the loaded version."""
        if self._index is not None and self.served:
            for table in (self._index[1].chunks, self._index[1].blocks, self._index[1].terms):
                table.unpersist()
        if self._lease is not None:
            store.release(self.spark, self._lease)
        self._index = self._lease = None

    def search(self, q: str, top_k: int = 0, query_rules: str = "config") -> list[dict] | None:
        """Ranked results; the query is cut by the configuration's token rules, or by the effective ones."""
        index, n = self.index()
        config, _ = self.config()
        token = config.token if query_rules == "config" else self.rules(config).token
        found = searching.search(index, q, token, top_k, n_chunks=n)
        return None if found is None else [r.asDict() for r in found.collect()]  # at most 20 rows

    def fetch(self, ids: list[int], max_lines: int = 0) -> list[dict]:
        """Numbered lines of up to five chunks, read from the tree as it is now."""
        index, _ = self.index()
        wanted = [r["path"] for r in index.chunks.filter(F.col("chunk_id").isin([int(i) for i in ids[: fetching.MAX_IDS]])).select("path").distinct().collect()]
        for p in wanted:
            if not scan.inside(self.root, p):
                raise ValueError(f"path rejected: {p}")
        rows = [(p, (scan.read_local(os.path.join(self.root, p)) or b"").decode("utf-8", "replace")) for p in wanted if os.path.exists(os.path.join(self.root, p))]
        content = self.spark.createDataFrame(rows, "path string, content string")
        return [r.asDict() for r in fetching.fetch(index.chunks, content, ids, max_lines).collect()]
