"""Engine configuration: frozen values with the defaults of the index, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

# Defaults that results depend on.
INCLUDE_EXT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
EXCLUDE_DIRS = ("node_modules", "dist", "build", ".next", "coverage", ".git", "out")
ALLOW_SHORT = ("api", "jwt", "url", "ui", "css", "tsx", "jsx", "dom", "id")
STOP_WORDS = (
    "const", "let", "var", "function", "return", "export", "import", "from",
    "class", "interface", "type", "enum", "extends", "implements", "new",
    "this", "super", "public", "private", "protected", "readonly", "async",
    "await", "if", "else", "switch", "case", "for", "while", "do", "break",
    "continue", "try", "catch", "finally", "throw", "true", "false", "null",
    "undefined",
)
STRIP_SUFFIXES = (".d.ts.map", ".d.tsx", ".d.ts")
STRIP_EXTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEX_DIR = ".tessera"
SCHEMA_VERSION = 2
CACHE_VERSION = "v2"


@dataclass(frozen=True)
class TokenConfig:
    min_len: int = 3
    max_len: int = 64
    drop_hex_len: int = 16
    allow_short: tuple[str, ...] = ALLOW_SHORT
    stop_words: tuple[str, ...] = STOP_WORDS
    string_literals: bool = True
    strip_suffixes: tuple[str, ...] = ()
    strip_exts: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChunkConfig:
    max_lines: int = 200
    overlap_lines: int = 20
    min_lines: int = 20


@dataclass(frozen=True)
class EngineConfig:
    project_type: str = "ts"
    include_ext: tuple[str, ...] = INCLUDE_EXT
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    max_file_bytes: int = 1024 * 1024
    max_snippet_bytes: int = 800
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    token: TokenConfig = field(default_factory=TokenConfig)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, raw: bytes | str) -> EngineConfig:
        """Absent fields are empty or zero; only the file size limit falls back to its default."""
        given = json.loads(raw)

        def read(kind, values: dict):
            empty = {int: 0, bool: False, str: "", tuple: ()}
            out = {}
            for f in fields(kind):
                base = getattr(kind(), f.name)
                value = values.get(f.name, empty.get(type(base)))
                out[f.name] = tuple(value) if isinstance(base, tuple) else value
            return kind(**out)

        chunk, token = read(ChunkConfig, given.get("chunk", {})), read(TokenConfig, given.get("token", {}))
        top = {k: v for k, v in given.items() if k not in ("chunk", "token")}
        flat = {f.name: top.get(f.name, () if isinstance(getattr(cls(), f.name), tuple) else 0 if isinstance(getattr(cls(), f.name), int) else "") for f in fields(cls) if f.name not in ("chunk", "token")}
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()}, chunk=chunk, token=token)
        if out.project_type != "ts":
            raise ValueError(f"unsupported project type: {out.project_type!r}")
        return out if out.max_file_bytes else replace(out, max_file_bytes=1024 * 1024)


def typescript_tokens(token: TokenConfig | None = None) -> TokenConfig:
    """Token rules with the path strips of the TypeScript profile."""
    return replace(token or TokenConfig(), strip_suffixes=STRIP_SUFFIXES, strip_exts=STRIP_EXTS)
