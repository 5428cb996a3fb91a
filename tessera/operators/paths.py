"""Filters over paths, sizes and contents of scanned files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import INCLUDE_EXT, INDEX_DIR
from tessera.functions.text import to_slash

# Extensions and suffixes of files that are never read as text.
BINARY_EXT = (
    ".zip", ".gz", ".bz2", ".xz", ".7z", ".rar", ".tar", ".tgz",
    ".png", ".jpg", ".jpeg", ".webp", ".gif", ".ico", ".bmp", ".tiff", ".psd", ".ai",
    ".mp4", ".mov", ".mkv", ".webm", ".avi", ".mp3", ".wav", ".flac", ".ogg",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".wasm", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".bin", ".dat",
)
BINARY_SUFFIX = (".tar.gz", ".tar.bz2", ".tar.xz")


def has_extension(path: Column, exts: Sequence[str] = INCLUDE_EXT) -> Column:
    """Whether the path ends with one of exts, in any case; an empty list takes every path."""
    out = F.lit(not exts)
    for e in exts:
        out |= F.endswith(F.lower(path), F.lit(e.lower()))
    return out


def known_binary(path: Column) -> Column:
    low = F.lower(path)
    out = F.regexp_extract(low, "(\\.[^./]*)$", 1).isin(*BINARY_EXT)
    for s in BINARY_SUFFIX:
        out |= F.endswith(low, F.lit(s))
    return out


def within_size(size: Column, limit: int) -> Column:
    return size <= (limit or 1024 * 1024)


def looks_binary(content: Column, sample: int = 4096) -> Column:
    """Whether the first bytes hold a zero byte or are not valid UTF-8; a character cut by the sample's end counts as invalid."""
    head = F.substring(content.cast("binary"), 1, sample).cast("string")
    return ~F.is_valid_utf8(head) | (F.instr(head, "\0") > 0)


def glob_to_regex(pattern: str) -> str | None:
    """A regular expression for '/' + path; None if the pattern is malformed and matches nothing.

    Segments match whole segments: ** any number of them, * and ? inside one, [...] a class, backslash escapes.
    """
    out = ""
    for segment in pattern.split("/"):
        if segment == "**":
            out += "(?:/[^/]*)*"
            continue
        out += "/"
        i = 0
        while i < len(segment):
            c = segment[i]
            i += 1
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "\\":
                if i == len(segment):
                    return None
                out += re.escape(segment[i])
                i += 1
            elif c == "[":
                negated = segment[i : i + 1] == "^"
                i += negated
                members, closed = "", False
                while i < len(segment):
                    if segment[i] == "]" and members:
                        i, closed = i + 1, True
                        break
                    bounds = []
                    while True:
                        if i < len(segment) and segment[i] == "\\":
                            i += 1
                        elif i < len(segment) and segment[i] in "-]":
                            return None
                        if i >= len(segment):
                            return None
                        bounds.append(segment[i])
                        i += 1
                        if len(bounds) == 2 or segment[i : i + 1] != "-":
                            break
                        i += 1
                    if bounds[0] <= bounds[-1]:
                        members += "-".join("\\" + b if not b.isalnum() and ord(b) < 128 else b for b in bounds)
                    elif not members:
                        members = "&&[^\\s\\S]"  # an empty range matches nothing
                if not closed:
                    return None
                out += f"(?:(?!/)[{'^' * negated}{members}])"
            else:
                out += re.escape(c)
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    regex = glob_to_regex(pattern)
    return F.lit(False) if regex is None else F.concat(F.lit("/"), path).rlike(regex.replace("$", "\\z") if regex.endswith("$") else regex)


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """The last pattern that matches decides: '!' takes back, 'name/' stands for everything in or called name."""
    out = F.lit(False)
    for raw in patterns:
        negated = raw.startswith("!")
        pattern = raw[1:] if negated else raw
        if pattern.endswith("/"):
            pattern = f"**/{pattern.rstrip('/')}/**"
        out = F.when(glob_match(path, pattern), F.lit(not negated)).otherwise(out)
    return out


def ignored_with_parents(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the path or a directory above it is ignored: what is below an ignored directory can't come back."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(prefixes, lambda p: ignored(p, patterns))


def indexable(path: Column) -> Column:
    """Changed paths that concern the index: not inside the index folder, no declaration file, a source extension."""
    p = to_slash(path)
    own = (p == INDEX_DIR) | F.startswith(p, F.lit(f"{INDEX_DIR}/"))
    source = F.lit(False)
    for e in INCLUDE_EXT:
        source |= F.endswith(p, F.lit(e))
    return ~own & ~F.endswith(p, F.lit(".d.ts")) & source


def in_ignored_dir(path: Column, dirs: Sequence[str]) -> Column:
    """Whether a path is, is below, or contains one of the directories."""
    out = F.lit(False)
    for d in dirs:
        out |= (path == d) | F.startswith(path, F.lit(f"{d}/")) | F.contains(path, F.lit(f"/{d}/"))
    return out


def plugin_match(path: Column) -> Column:
    low = F.lower(path)
    return (F.endswith(low, F.lit(".ts")) | F.endswith(low, F.lit(".tsx"))) & ~F.endswith(low, F.lit(".d.ts"))


def safe_path(path: Column) -> Column:
    """Lexical part of path safety: relative, not empty or '.', without a '..' segment."""
    return (path != "") & (path != ".") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "[/\\\\]"), "..")
