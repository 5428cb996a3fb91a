"""What to rebuild: manifest differences, the sync decision, and the split into reused and rebuilt files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import INDEX_DIR
from tessera.operators.paths import indexable

# Modes and reasons of a sync, reasons of a change.
MODES = ("full", "noop", "incremental")
WHYS = ("up_to_date", "missing_index", "not_git_repo", "schema_changed", "config_changed", "git_head_changed", "git_worktree_changed", "git_head_and_worktree_changed", "git_changed_non_indexable", "unknown")
CHANGES = ("none", "worktree", "head", "head+worktree", "unknown")
#: Changed paths listed in a status.
LISTED = 200


def valid_mode(mode: Column) -> Column:
    return F.coalesce(mode.isin(*MODES), F.lit(False))


def valid_why(why: Column) -> Column:
    """A known reason, or none."""
    return F.coalesce(why.isin("", *WHYS), F.lit(False))


def valid_change(reason: Column) -> Column:
    return F.coalesce(reason.isin("", *CHANGES), F.lit(False))


#: The state that a sync is decided on.
STATE = "missing_index boolean, is_repo boolean, known boolean, schema_changed boolean, config_changed boolean, dirty boolean, dirty_index_only boolean, heads_differ boolean, changed_path_count long"


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, modified, same) of two manifests with path and hash64."""
    o = old.select("path", F.col("hash64").alias("_old"), F.lit(True).alias("_o"))
    n = new.select("path", F.col("hash64").alias("_new"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("modified")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def changed_paths(worktree: DataFrame, head: DataFrame) -> DataFrame:
    """The distinct indexable paths of the working tree's and the head's changes."""
    return worktree.select("path").union(head.select("path")).distinct().filter(indexable(F.col("path")))


def change_summary(changed: DataFrame) -> DataFrame:
    """changed_path_count and the first paths in byte order."""
    first = changed.orderBy("path").limit(LISTED).agg(F.coalesce(F.array_sort(F.collect_list("path")), F.array().cast("array<string>")).alias("changed_paths"))  # at most LISTED
    return changed.agg(F.count("*").alias("changed_path_count")).crossJoin(first)  # one row each


def only_index_dir(dirty: DataFrame) -> DataFrame:
    """dirty_index_only: there are dirty paths, all of them inside the index folder."""
    own = (F.col("path") == INDEX_DIR) | F.startswith("path", F.lit(f"{INDEX_DIR}/"))
    return dirty.agg((F.count("*") > 0) & F.coalesce(F.bool_and(own), F.lit(False))).toDF("dirty_index_only")


def change_reason(worktree_dirty: Column, heads_differ: Column) -> Column:
    return F.when(worktree_dirty & heads_differ, "head+worktree").when(worktree_dirty, "worktree").when(heads_differ, "head").otherwise("none")


def sync_decision(state: DataFrame) -> DataFrame:
    """state with mode and why; the first rule that holds decides.

    state: missing_index, is_repo, known, schema_changed, config_changed, dirty, dirty_index_only, heads_differ
    (booleans) and changed_path_count.
    """
    c = F.col
    why = (
        F.when(c("missing_index"), "missing_index")
        .when(~c("is_repo"), "not_git_repo")
        .when(~c("known"), "unknown")
        .when(c("schema_changed"), "schema_changed")
        .when(c("config_changed"), "config_changed")
        .when(c("dirty_index_only") & ~c("heads_differ"), "git_changed_non_indexable")
        .when(c("dirty") & c("heads_differ"), "git_head_and_worktree_changed")
        .when(c("heads_differ"), "git_head_changed")
        .when(c("dirty") & (c("changed_path_count") > 0), "git_worktree_changed")
        .when(c("dirty"), "git_changed_non_indexable")
        .otherwise("up_to_date")
    )
    earlier = c("missing_index") | ~c("is_repo") | ~c("known") | c("schema_changed") | c("config_changed")
    noop = ~earlier & ((c("dirty_index_only") & ~c("heads_differ")) | (~c("dirty") & ~c("heads_differ")))
    return state.withColumns({"mode": F.when(noop, "noop").otherwise("full"), "why": why})


def purges(why: str) -> bool:
    return why in ("missing_index", "schema_changed", "config_changed")


def sync_split(listing: DataFrame, changed: DataFrame, cached: DataFrame) -> DataFrame:
    """listing with action: reuse what is cached and unchanged, rebuild the rest; unlisted cache entries fall away."""
    c = changed.select("path").distinct().withColumn("_changed", F.lit(True))
    k = cached.select("path").distinct().withColumn("_cached", F.lit(True))
    reuse = F.col("_changed").isNull() & F.col("_cached").isNotNull()
    return listing.join(c, "path", "left").join(k, "path", "left").withColumn("action", F.when(reuse, "reuse").otherwise("rebuild")).drop("_changed", "_cached")


def valid_cache(entries: DataFrame) -> DataFrame:
    """Cache entries (path, chunks, tokens: array per chunk) with `valid`: sane ranges and as many token lists as chunks."""
    most = 2**32 - 1
    sane = F.forall("chunks", lambda x: (x["start_line"] >= 1) & (x["end_line"] >= x["start_line"]) & (x["end_line"] <= most))
    return entries.withColumn("valid", sane & (F.size("chunks") == F.size("tokens")))
