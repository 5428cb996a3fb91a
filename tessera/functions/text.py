"""Column functions over source text and paths; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import TokenConfig

_SEPARATORS = "[^\\p{L}\\p{Nd}]+"
#: Unicode white space: the control characters, then the characters of category Z.
_SPACE = "\t\n\x0b\x0c\r\x85 \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LITERALS = "(?s)" + "|".join(f"{q}[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+(?:{q}|\\\\?\\z)" for q in ("'", '"', "`"))
#: Separators, and places inside a word where an identifier is cut: around digits and at camel-case humps.
_INNER = "(?<=\\p{Nd})(?=\\p{L})|(?<=\\p{L})(?=\\p{Nd})|(?<=\\p{Ll})(?=\\p{Lu})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})"
_CUTS = _SEPARATORS + "|" + _INNER
#: What parts tokens of a text, whose digits are no tokens; the humps inside its words, and what a text without any does not have.
_NO_LETTERS = "[^\\p{L}]+"
_HUMPS = "(?<=\\p{Ll})(?=\\p{Lu})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})"
_HUMPED = "\\p{L}\\p{Lu}"


def normalize_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines of normalised text; a final newline gives an empty last line, empty text one empty line."""
    return F.split(text, "\n", -1)


def trim_space(text: Column) -> Column:
    """Both ends without Unicode white space. Few texts have any there, and trimming walks over all of a text."""
    edge = F.contains(F.lit(_SPACE), F.substring(text, 1, 1)) | F.contains(F.lit(_SPACE), F.substring(text, -1, 1))
    return F.when(edge, F.trim(text, F.lit(_SPACE))).otherwise(text)


def begins_with(line: Column, words: Sequence[str]) -> Column:
    """Whether a line may begin with one of the words in any case, white space before it aside; true if it does when trimmed."""
    return line.rlike(f"^[{_SPACE}]*(?i:" + "|".join(map(re.escape, words)) + ")")


def line_begins_with(text: Column, words: Sequence[str]) -> Column:
    """Whether a line of a text may begin with one of the words: true if `begins_with` is for one of its lines."""
    # a pattern that begins with a class of characters skips all others fast
    return F.concat(F.lit("\n"), text).rlike(f"[\r\n][{_SPACE}]*+(?i:" + "|".join(map(re.escape, words)) + ")")


def drop_string_literals(text: Column) -> Column:
    """Quoted literals (also unterminated ones) replaced by a separator; applied to a whole file."""
    return F.regexp_replace(text, _LITERALS, " ")


def raw_words(text: Column) -> Column:
    """Runs of letters and decimal digits."""
    return F.filter(F.split(text, _SEPARATORS), lambda x: x != "")


def identifiers(text: Column) -> Column:
    """Words cut at digits and at camel-case humps."""
    return F.filter(F.split(text, _CUTS), lambda x: x != "")


def keep_token(token: Column, config: TokenConfig, plain: bool = False) -> Column:
    """plain: the token is no stop word, not empty and has no digit."""
    size = F.char_length(token)
    short = token.isin([w.lower() for w in config.allow_short]) if config.allow_short else F.lit(False)
    keep = (size <= config.max_len) & ((size >= config.min_len) | short)
    if config.drop_hex_len > 0:
        keep &= (size < config.drop_hex_len) | ~token.rlike("^[0-9a-f]+\\z")
    if plain:
        return keep
    if config.stop_words:
        keep &= ~token.isin([w.lower() for w in config.stop_words])
    return keep & ~token.rlike("^\\p{Nd}+\\z") & (token != "")


def lower_each(text: Column) -> Column:
    """Lower case character by character: no final sigma, and a dotted capital I becomes a plain i."""
    return F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))


def normalize_tokens(tokens: Column, config: TokenConfig) -> Column:
    """Lower-cased, filtered, distinct and sorted by bytes."""
    lowered = F.array_distinct(F.transform(F.array_distinct(tokens), lower_each))
    return F.sort_array(F.filter(lowered, lambda x: keep_token(x, config)))


def _kept(text: Column, config: TokenConfig) -> Column:
    """The distinct tokens of a text, in any order.

    Identifiers are cut at their humps in the text as a whole. Tokens end at digits and digits are no tokens, so what is
    left are runs of letters. Few texts need `lower_each`.
    """
    source = text if config.string_literals else drop_string_literals(text)
    words = F.array_distinct(F.split(F.when(source.rlike(_HUMPED), F.regexp_replace(source, _HUMPS, " ")).otherwise(source), _NO_LETTERS))
    special = F.contains(source, F.lit("\u03a3")) | F.contains(source, F.lit("\u0130"))
    lowered = F.when(special, F.transform(words, lower_each)).otherwise(F.transform(words, lambda x: F.lower(x)))
    named = F.array_except(lowered, F.lit(["", *(w.lower() for w in config.stop_words)]))
    return F.filter(named, lambda x: keep_token(x, config, plain=True))


def text_tokens(text: Column, config: TokenConfig, own: Column | None = None) -> Column:
    """The tokens of a text (and those of the array `own`), distinct and sorted by bytes."""
    found = _kept(text, config)
    return F.sort_array(found if own is None else F.array_union(found, own))


def to_slash(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _cut_end(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), F.char_length(text) - n)


def stripped_path(path: Column, suffixes: Sequence[str], exts: Sequence[str]) -> Column:
    """The path without the first known suffix of its last segment, then without the first known or else its own extension."""

    def last(p: Column) -> Column:
        return F.element_at(F.split(p, "/"), -1)

    def known(p: Column, ends: Sequence[str]) -> Column:
        found = F.lit(None).cast("string")
        for e in reversed(ends):
            base = last(p)
            found = F.when(F.endswith(F.lower(base), F.lit(e)) & (F.char_length(base) > len(e)), F.lit(e)).otherwise(found)
        return found

    suffix = known(path, suffixes)
    one = F.when(suffix.isNotNull(), _cut_end(path, F.char_length(suffix))).otherwise(path)
    ext = F.coalesce(known(one, exts), F.regexp_extract(last(one), "(\\.[^.]*)$", 1))
    cut = (ext != "") & (F.char_length(last(one)) > F.char_length(ext)) & F.endswith(one, ext)
    return F.when(cut, _cut_end(one, F.char_length(ext))).otherwise(one)


def path_tokens(path: Column, config: TokenConfig) -> Column:
    clean = stripped_path(to_slash(path), config.strip_suffixes, config.strip_exts)
    return normalize_tokens(identifiers(clean), config)


def tokens_with_path(path: Column, text: Column, config: TokenConfig) -> Column:
    return text_tokens(text, config, path_tokens(path, config))


def cut_bytes(text: Column, most: int) -> Column:
    """At most `most` bytes of text, ending with a whole character."""
    if most <= 0:
        return text
    raw = text.cast("binary")
    out = F.lit("")
    for n in (most - 3, most - 2, most - 1, most):
        if n >= 0:
            out = F.coalesce(F.try_validate_utf8(F.substring(raw, 1, n).cast("string")), out)
    return F.when(F.octet_length(text) <= most, text).otherwise(out)


def snippet(lines: Column, start: Column, end: Column, most: int, trimmed: bool = False) -> Column:
    """The first three lines of a chunk that are not blank, trimmed (unless all lines are already), cut to `most` bytes."""
    s = F.greatest(start, F.lit(1))
    n = F.greatest(F.least(end, F.size(lines)) - s + 1, F.lit(0))
    own = F.slice(lines, s, n)
    some = F.filter(own if trimmed else F.transform(own, trim_space), lambda x: x != "")
    return cut_bytes(F.array_join(F.slice(some, 1, 3), "\n"), most)


def fnv64(data: Column) -> Column:
    """FNV-1a of the bytes, as the signed 64-bit pattern; the state is two 32-bit halves, which never overflow."""
    digits = F.hex(data.cast("binary"))
    places = F.sequence(F.lit(0), F.shiftright(F.length(digits), 1) - F.lit(1))
    octets = F.when(F.length(digits) > 0, F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(s: Column, x: Column) -> Column:
        low = s["lo"].bitwiseXOR(x)
        product = low * 435
        high = (s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(0xFFFFFFFF)
        return F.struct(high.alias("hi"), product.bitwiseAND(0xFFFFFFFF).alias("lo"))

    return F.aggregate(octets, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def numbered_lines(lines: Column, first: Column) -> Column:
    return F.transform(lines, lambda x, i: F.concat((i + first).cast("string"), F.lit("| "), x))
