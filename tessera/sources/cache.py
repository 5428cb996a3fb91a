"""The record that says what the cached tokens were made with; another version, schema or configuration purges them."""

from __future__ import annotations

import json
import os
import shutil

from tessera.config import CACHE_VERSION, SCHEMA_VERSION
from tessera.sources.scan import read_local


def meta_path(home: str) -> str:
    return os.path.join(home, "cache.json")


def load_meta(home: str) -> dict | None:
    """The record, or None if there is none; a damaged one is an error."""
    raw = read_local(meta_path(home))
    return None if raw is None else json.loads(raw)


def save_meta(home: str, meta: dict) -> None:
    """Written beside and moved into place, so a reader sees the old record or the new one."""
    os.makedirs(home, exist_ok=True)
    fresh = f"{meta_path(home)}.{os.getpid()}"
    with open(fresh, "w") as f:
        json.dump(meta, f)
    os.replace(fresh, meta_path(home))


def store_path(home: str) -> str:
    return os.path.join(home, "store")


def purge(home: str) -> None:
    """Delete the store of cached tokens."""
    if os.path.isdir(store_path(home)):
        shutil.rmtree(store_path(home))


def ensure_meta(home: str, config_hash: int, project_type: str) -> bool:
    """Make the record say what is wanted; True if it said otherwise and the cache was purged."""
    want = {"cache_version": CACHE_VERSION, "schema_version": SCHEMA_VERSION, "config_hash": config_hash, "project_type": project_type}
    known = load_meta(home)
    if known == want:
        return False
    if known is not None:
        purge(home)
    save_meta(home, want)
    return known is not None
