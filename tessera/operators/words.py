"""Tokens of chunks in Arrow batches, the same as `text_tokens` gives.

Lines of Latin letters up to U+017F, the other characters below it, general punctuation and currency signs, whose
categories are the same in every Unicode version, are cut here; a chunk that holds any other character is left to
`text_tokens`. No token goes on in the next line, so a line is cut once for all chunks that hold it, and words are
numbers from then on: ranks among the batch's words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.config import TokenConfig
from tessera.functions.text import text_tokens

#: Characters of lines that are handled at once.
SLICE = 500_000
_OTHER = "[^\\x00-įı-ſ\u2000-\u206f\u20a0-\u20bf]"  # a dotted capital I has no plain lower case
#: Kinds of characters: parts of no word, letters by their case, and those that are not handled here.
_NONE, _LOWER, _UPPER, _LETTER, _UNKNOWN = range(5)
_TOP = 0x2100


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of the characters before _TOP, which stands for all from it on."""
    kinds = {"Ll": _LOWER, "Lu": _UPPER, "Lo": _LETTER, "Lm": _LETTER, "Lt": _LETTER}
    known = ["" if re.match(_OTHER, chr(i)) else chr(i) for i in range(_TOP)]
    kind = [kinds.get(category(c), _NONE) if c and ord(c) < 0x180 else _NONE if c else _UNKNOWN for c in known]
    return np.array([*kind, _UNKNOWN], np.uint8), np.array([ord(c.lower()) if c else 0 for c in known] + [0], np.uint32)


def _cut(lines: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words of all lines in lower case, number of words before each line and at the end, whether a line is known)."""
    kinds, lowers = _characters()
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    codes = np.minimum(np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le"), np.uint32), np.uint32(_TOP))
    kind = kinds[codes]
    known = np.ones(len(lines), bool)
    if len(odd := np.flatnonzero(kind == _UNKNOWN)):
        known[np.searchsorted(ends, odd, "right")] = False
        kind[odd] = _NONE
    letter = kind > 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    low = np.where(letter, lowers[codes], np.uint32(32))
    upper, lower = kind == _UPPER, kind == _LOWER
    hump = upper[1:] & lower[:-1]
    hump[:-1] |= upper[:-2] & upper[1:-1] & lower[2:]
    if len(humps := np.flatnonzero(hump) + 1):
        first[humps] = True
        low = np.insert(low, humps, 32)
    return low.tobytes().decode("utf-32-le").split(), np.append(0, np.cumsum(first)[ends - 1]), known


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of each place of the ranges from first to before end."""
    n = end - first
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _kept(words: pa.Array, config: TokenConfig) -> np.ndarray:
    stop, short = (pa.array(sorted({w.lower() for w in x}), pa.string()) for x in (config.stop_words, config.allow_short))
    n = pc.utf8_length(words).to_numpy()
    of = lambda x: pc.is_in(words, value_set=x).to_numpy(zero_copy_only=False)
    keep = (n <= config.max_len) & ((n >= config.min_len) | of(short)) & ~of(stop)
    if config.drop_hex_len > 0:
        keep &= (n < config.drop_hex_len) | ~pc.match_substring_regex(words, "^[0-9a-f]+$").to_numpy(zero_copy_only=False)
    return keep


def tokens_of(lines: list[str], first: np.ndarray, end: np.ndarray, own: pa.ListArray, config: TokenConfig) -> tuple[pa.Array, np.ndarray]:
    """(tokens joined by a space, whether all lines are known) of ranges of lines, each with a list of own tokens."""
    found, before, known = _cut(lines)
    mine = own.flatten()
    coded = pa.concat_arrays([pa.array(found, pa.string()), mine.cast(pa.string())]).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    keep = np.append(_kept(words, config)[code[: len(found)]], np.ones(len(mine), bool))
    ranks = rank[code]
    sizes = pc.list_value_length(own).to_numpy()
    at = len(found) + np.cumsum(sizes) - sizes
    pairs = [_spread(before[first], before[end]), _spread(at, at + sizes)]
    which, place = (np.concatenate(x) for x in zip(*pairs, strict=True))
    some = keep[place]
    key = np.sort(which[some] * max(1, len(words)) + ranks[place[some]])
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    edges = np.searchsorted(key, np.arange(len(first) + 1) * max(1, len(words)))
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.take(pa.array(order[key % max(1, len(words))])))
    bad = np.append(0, np.cumsum(~known))
    return pc.binary_join(lists, " "), bad[end] == bad[first]


def token_finder(config: TokenConfig) -> Callable[[str, list[str]], list[str] | None]:
    """A function of a text and its path's tokens: the tokens of both, distinct and sorted; None if the text is not for it."""

    def find(text: str, own: list[str]) -> list[str] | None:
        tokens, known = tokens_of([text], np.array([0]), np.array([1]), pa.array([own], pa.list_(pa.string())), config)
        return tokens[0].as_py().split() if known[0] else None

    return find


def _pieces(sizes: list[int], starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of ranges of lines whose lines have about `limit` characters; the ranges follow each other or overlap."""
    before = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(before[ends], before[starts[at]] + limit, "right")))
        yield at, to
        at = to


def with_tokens(files: DataFrame, config: TokenConfig, chunks: str, lines: str, own: str) -> DataFrame:
    """files whose array `chunks` of structs (start_line, end_line, ..) gets `tokens`, joined by a space: those of its lines of
    the array `lines` and of the path's tokens `own`, which both go."""
    names = files.columns
    at, at_own, at_chunks = (names.index(c) for c in (lines, own, chunks))
    limit = SLICE

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, per = batch.column(at), batch.column(at_chunks)
            text, n = rows.flatten().to_pylist(), pc.list_value_length(rows).to_numpy()
            count = pc.list_value_length(per).to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            shift = (np.cumsum(n) - n)[row]
            cut = per.flatten()
            start = cut.field("start_line").to_numpy().astype(np.int64) - 1 + shift
            end = cut.field("end_line").to_numpy().astype(np.int64) + shift
            found, left = [pa.array([], pa.string())], [None] * len(row)
            for i, j in _pieces([len(t) for t in text], start, end, limit):
                lo, hi = int(start[i]), int(end[j - 1])
                tokens, known = tokens_of(text[lo:hi], start[i:j] - lo, end[i:j] - lo, batch.column(at_own).take(pa.array(row[i:j])), config)
                found.append(tokens)
                for k in np.flatnonzero(~known) + i:
                    left[k] = "\n".join(text[start[k] : end[k]])
            edges = pa.array(np.append(0, np.cumsum(count)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.concat_arrays(found), pa.array(left, pa.string()))]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, *lists], [*(x for x in names if x != lines), "_found", "_left"])

    kind = files.drop(lines).schema
    for c in ("_found", "_left"):
        kind = kind.add(c, ArrayType(StringType()))
    rows = files.mapInArrow(apply, kind)
    fields = [f.name for f in files.schema[chunks].dataType.elementType.fields]

    def tokens(i: Column) -> Column:
        left = F.get("_left", i)
        return F.when(left.isNull(), F.get("_found", i)).otherwise(F.array_join(text_tokens(left, config, F.col(own)), " "))

    full = F.transform(chunks, lambda c, i: F.struct(*[c[f].alias(f) for f in fields], tokens(i).alias("tokens")))
    return rows.withColumn(chunks, full).drop(own, "_found", "_left")
