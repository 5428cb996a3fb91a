"""Project profiles and the effective scan and token rules."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from tessera.config import INDEX_DIR, SCHEMA_VERSION, STRIP_EXTS, STRIP_SUFFIXES, EngineConfig, TokenConfig

# Scan-ignore patterns of the profiles.
GLOBAL_IGNORE = ("**/*.svg", ".git/", f"{INDEX_DIR}/")
LOCK_IGNORE = ("package-lock.json",)
NODE_IGNORE = (
    "node_modules/",
    "dist/",
    "build/",
    "coverage/",
    ".cache/",
    "npm-debug.log*",
    "yarn-debug.log*",
    "yarn-error.log*",
    "pnpm-debug.log*",
    ".DS_Store",
    "**/*.map",
)
TYPESCRIPT_IGNORE = ("**/*.map",)
#: Folders that profile detection doesn't look into.
UNSEEN_DIRS = (".git", INDEX_DIR, "node_modules", "dist", "build")


@dataclass(frozen=True)
class EffectiveRules:
    profiles: tuple[str, ...]
    scan_ignore: tuple[str, ...]
    token: TokenConfig
    max_file_bytes: int
    rules_hash: int


def fnv64_bytes(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for b in data:
        state = (state ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return state


def config_hash(config_bytes: bytes, rules_hash: int) -> int:
    """Of the configuration's bytes followed by the rules' hash."""
    return fnv64_bytes(config_bytes + rules_hash.to_bytes(8, "little"))


def profile_rules(has_package_json: bool, is_typescript: bool) -> tuple[list[str], list[str]]:
    """(profiles, ignore patterns), in registry order."""
    ignore = [*GLOBAL_IGNORE, *(LOCK_IGNORE if has_package_json else ())]
    profiles = []
    if has_package_json:
        profiles.append("node")
        ignore += NODE_IGNORE
    if is_typescript:
        profiles.append("ts_js")
        ignore += TYPESCRIPT_IGNORE
    return profiles, ignore


def combine(base: Iterable[str], given: Iterable[str] | None, mode: str = "") -> tuple[str, ...]:
    """An override list replaces or (also by default) extends; an unknown mode is ignored."""
    base = tuple(base)
    if given is None:
        return base
    if mode == "replace":
        return tuple(given)
    return (*base, *given) if mode in ("", "append") else base


def apply_override(token: TokenConfig, override: dict) -> TokenConfig:
    """A tokenize.json override: lists with a mode, numbers only if positive, a flag if present."""
    out = token
    for name in ("stop_words", "allow_short", "strip_suffixes", "strip_exts"):
        out = replace(out, **{name: combine(getattr(out, name), override.get(name), override.get(f"{name}_mode", ""))})
    for name in ("min_len", "max_len", "drop_hex_len"):
        if (override.get(name) or 0) > 0:
            out = replace(out, **{name: override[name]})
    if override.get("string_literals") is not None:
        out = replace(out, string_literals=bool(override["string_literals"]))
    return out


def effective_rules(config: EngineConfig, has_package_json: bool, is_typescript: bool, scan_ignore: Iterable[str] = (), override: dict | None = None) -> EffectiveRules:
    """Configuration, then detected profiles, then the user's own rules; the hash depends on their order."""
    profiles, ignore = profile_rules(has_package_json, is_typescript)
    ignore += list(scan_ignore)
    token = config.token
    if is_typescript:
        token = replace(token, strip_suffixes=(*token.strip_suffixes, *STRIP_SUFFIXES), strip_exts=(*token.strip_exts, *STRIP_EXTS))
    token = apply_override(token, override or {})
    body = json.dumps([SCHEMA_VERSION, profiles, ignore, config.max_file_bytes, asdict(token)])
    return EffectiveRules(tuple(profiles), tuple(ignore), token, config.max_file_bytes, fnv64_bytes(body.encode()))
