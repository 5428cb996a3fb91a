"""Byte-level BPE by speculation: propose by longest match, verify every adjacent pair, merge only where a pair fails.

A token sequence is the encoding of a word exactly if each token encodes to itself and no merge crosses the border of two
neighbours before the neighbours are finished. Both are facts of the vocabulary, so a batch's distinct words are handled
together: a trie walk finds the longest token at every byte, the chain of longest tokens is the proposal, and all its
adjacent pairs are checked at once. Words with a failing pair (and only they) are merged exactly.

Special tokens in a text are matched first, as the tokenizers library does. Texts are cut into words by the vocabulary's
own pattern: plain Latin texts by an equal pattern here, others by the library's pre-tokenizer.

A null text has no ids, like an empty one; its decoded text is empty. Texts are handled in slices of rows, a very long one alone
and whole; repeated rows are encoded each; an empty table stays empty. Other columns are kept whatever their names (one named
like the column that takes the text's place is replaced).
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tessera.llm.common import slices
from tessera.llm.tokens import default_path

#: Distinct words that a worker keeps between batches, and characters of a word that is kept; more are encoded again.
KEPT_WORDS, KEPT_CHARS = 400_000, 48
#: Bytes of a word up to which the least rank is found by looking at all pairs instead of keeping a heap.
SHORT = 40

#: Characters whose classes are the same in every Unicode version, and the splitting pattern over them.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f]*")
_L, _N = "A-Za-z\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f", "0-9\\u00b2\\u00b3\\u00b9\\u00bc-\\u00be"
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")


def byte_characters() -> dict[str, int]:
    """The vocabulary's printable character of each byte: itself if printable Latin, else the next character from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tables of a byte-level BPE file: bytes of each id, merges by rank, a trie of the tokens that encode to themselves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, added = raw["model"], raw.get("added_tokens", [])
        split = raw.get("pre_tokenizer") or {}
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or raw.get("normalizer") or model.get("ignore_merges") or odd:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters, ids = byte_characters(), model["vocab"]
        size = max([*ids.values(), *(t["id"] for t in added)]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        for t in added:
            self.bytes[t["id"]] = t["content"].encode()
        self.one = [ids[c] for c in sorted(letters, key=letters.get)]
        self.single = np.array(self.one)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        ranks = np.arange(len(pairs))
        self.size, self.length = size, np.array([len(b) for b in self.bytes])
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for column, values in ((self.left, left), (self.right, right), (self.rank, ranks)):
            column[made[::-1]] = values[::-1]  # a token made twice is made by its first merge
        order = np.argsort(left * size + right, kind="stable")
        self.pair_key, self.pair_rank = (left * size + right)[order], ranks[order]
        self.merges = dict(zip(zip(left.tolist(), right.tolist(), strict=True), zip(ranks.tolist(), made.tolist(), strict=True), strict=True))
        merged = np.flatnonzero(self.rank >= 0)
        sound = np.zeros(size, bool)
        sound[self.single] = True
        stands = self.compatible(self.left[merged], self.right[merged], met=True)
        for i, fine in sorted(zip(merged.tolist(), stands.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            sound[i] = fine and sound[self.left[i]] and sound[self.right[i]]
        self._trie([i for i in np.flatnonzero(sound).tolist()])
        self.finder = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _trie(self, tokens: list[int]) -> None:
        """Arrays of the trie over the tokens' bytes: sorted keys node * 256 + byte, their next nodes, the token of each node."""
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i in tokens:
            at = 0
            for b in self.bytes[i]:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            ends[at] = i
        key = np.array([a * 256 + b for a, b in nodes], np.int64)
        order = np.argsort(key)
        self.edge, self.into = key[order], np.fromiter(nodes.values(), np.int64)[order]
        self.token_at = np.full(len(nodes) + 1, -1)
        self.token_at[list(ends)] = list(ends.values())

    def compatible(self, x: np.ndarray, y: np.ndarray, met: bool = False) -> np.ndarray:
        """Whether tokens x and y stay apart when their bytes are encoded together, for each pair.

        Time runs backwards: of the two tokens at the border the one merged later is taken apart, which gives the border
        as it was before that merge. A merge across the border must not come before the merge that ended this state;
        of equal ranks the left one comes first. With met, the pair itself may merge.
        """
        ok = np.ones(len(x), bool)
        at, x, y = np.arange(len(x)), np.array(x, np.int64), np.array(y, np.int64)
        until = np.full(len(x), len(self.pair_key) if not met else -1)  # a crossing merge of a lesser rank fails the pair
        while len(at):
            key = x * self.size + y
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            fails = (self.pair_key[k] == key) & (self.pair_rank[k] < until)
            ok[at[fails]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~fails & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[on], x[on], y[on], rx[on], ry[on]
            later = rx > ry
            until = np.where(later, rx, ry + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return ok

    def longest(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The longest token that begins at each byte and ends before `last` of that byte."""
        best = self.single[raw].copy()
        at, node, depth = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        while len(at):
            key = node * 256 + raw[at + depth]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = self.edge[k] == key
            at, node = at[there], self.into[k[there]]
            token = self.token_at[node]
            best[at[token >= 0]] = token[token >= 0]
            depth += 1
            more = at + depth < last[at]
            at, node = at[more], node[more]
        return best

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of the least rank first, of equal ranks the left one."""
        ids = [self.one[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            none = (len(self.merges), -1)
            found = [self.merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while found and (least := min(found)) is not none:
                i = found.index(least)
                ids[i : i + 2] = [least[1]]
                del found[i]
                if i:
                    found[i - 1] = self.merges.get((ids[i - 1], ids[i]), none)
                if i < len(found):
                    found[i] = self.merges.get((ids[i], ids[i + 1]), none)
            return ids
        ahead, back = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            ahead[i] = k = ahead[j]
            if k >= 0:
                back[k] = i
            for p, q in ((back[i], i), (i, k)):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def words(self, words: Sequence[str]) -> tuple[list[bytes], int]:
        """(the ids of each word as little-endian 32-bit integers, words that needed exact merging)."""
        coded = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        last = np.repeat(ends, [len(w) for w in coded])
        best = self.longest(raw, last)
        step = self.length[best].tolist()
        chain, p, n = [], 0, len(raw)
        while p < n:  # a token never crosses the end of its word, so one chain runs through all words
            chain.append(p)
            p += step[p]
        place = np.array(chain, np.int64)
        tokens, word = best[place], np.searchsorted(ends, place, "right")
        inner = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.unique(word[inner[~self.compatible(tokens[inner], tokens[inner + 1])]])
        first = np.searchsorted(word, np.arange(len(coded) + 1)).tolist()
        flat = tokens.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(first, first[1:], strict=False)]
        for k in wrong.tolist():
            out[k] = np.array(self.merged(coded[k]), "<u4").tobytes()
        return out, len(wrong)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _library_split(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str


def split_words(text: str, path: str) -> list[str]:
    """The words of a text without special tokens, as the tokenizers library cuts it."""
    if _PLAIN.fullmatch(text):
        return _WORDS.findall(text)
    return [text[a:b] for _, (a, b) in _library_split(path)(text)]


class Encoder:
    """Ids of texts; the words that were met stay known, KEPT_WORDS of them at most."""

    def __init__(self, path: str):
        self.path, self.vocabulary, self.known = path, vocabulary(path), {}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        v, parts = self.vocabulary, []
        for text in texts:
            text = text or ""
            if v.finder is None or not v.finder.search(text):
                parts.append([split_words(text, self.path)])
                continue
            own, at = [], 0
            for m in v.finder.finditer(text):
                own += [split_words(text[at : m.start()], self.path), m.group()]
                at = m.end()
            parts.append([*own, split_words(text[at:], self.path)])
        met = set().union(*(p for own in parts for p in own if isinstance(p, list)))
        new = [w for w in met if w not in self.known]
        self.known.update(zip(new, v.words(new)[0] if new else [], strict=True))
        get = self.known.__getitem__
        out = [b"".join(v.special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in own) for own in parts]
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.known[w]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _replaced(df: DataFrame, column: str, name: str, kind: StringType | BinaryType, sizes, make) -> DataFrame:
    """df with `column` replaced by `name`, made from slices of its values by `make`; another column of that name goes."""
    rows = df.drop(name) if name != column else df
    at = rows.columns.index(column)
    schema = StructType([StructField(name, kind) if i == at else f for i, f in enumerate(rows.schema.fields)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.string() if isinstance(kind, StringType) else pa.binary()
        for batch in batches:
            for i, j in slices(sizes(batch.column(at))):
                part = batch.slice(i, j - i)
                columns = list(part.columns)
                columns[at] = pa.array(make(columns[at].to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(apply, schema)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_pylist()


def encode_documents(docs: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """docs with the text replaced by its ids (binary, little-endian unsigned 32-bit integers)."""
    path = tokenizer or default_path()
    return _replaced(docs, text, ids, BinaryType(), _lengths, lambda texts: encoder(path).encode(texts))


def decode_documents(encoded: DataFrame, ids: str = "ids", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """encoded with the ids replaced by the text that they stand for, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    path = tokenizer or default_path()

    def decode(values: Sequence[bytes | None]) -> list[str]:
        table = vocabulary(path).bytes
        return [b"".join(map(table.__getitem__, np.frombuffer(v or b"", "<u4").tolist())).decode("utf-8", "replace") for v in values]

    return _replaced(encoded, ids, text, StringType(), _lengths, decode)


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: each text encoded, and its ids decoded."""
    rows = encode_documents(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("ids")), "ids", "ids", tokenizer)
    return decode_documents(rows.select("doc_id", "ids", F.col("ids").alias("decoded")), "decoded", "decoded", tokenizer)
