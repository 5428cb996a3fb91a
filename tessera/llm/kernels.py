"""numpy kernels over slices of many texts at once: words, lines, hashes, shingles."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix, random_words

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_PLACES = random_words(64, 1)
#: The first bytes of a word of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEPS = random_words(64, 2) | np.uint64(1)


def runs(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of bytes that are no breaks; no run crosses documents."""
    inside = ~breaks[raw]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[firsts] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: the sum of its finalised words of eight bytes, each with a random word of its place,
    finalised with its length."""
    global _PLACES
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    # the eight bytes from each place on
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    with np.errstate(over="ignore"):
        sums = mix((eights[starts] & _FIRST[np.minimum(lengths, 8)]) ^ _PLACES[0])
        long = np.flatnonzero(lengths > 8)
        if len(long):
            more = (lengths[long] - 1) // 8
            if int(more.max()) >= len(_PLACES):
                _PLACES = random_words(2 * int(more.max()), 1)
            heads = np.cumsum(more) - more
            place = np.arange(1, int(more.sum()) + 1) - np.repeat(heads, more)
            at = np.repeat(starts[long], more) + 8 * place
            rest = np.minimum(np.repeat(ends[long], more) - at, 8)
            sums[long] += np.add.reduceat(mix((eights[at] & _FIRST[rest]) ^ _PLACES[place]), heads)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-gram of a document's run hashes; a document with fewer runs has its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs)
    with np.errstate(over="ignore"):
        full = len(hashes) - n + 1
        parts, owners = [], []
        if full > 0:
            total = np.zeros(full, np.uint64)
            for j in range(n):
                total += hashes[j : j + full] * _STEPS[j]
            whole = doc[:full] == doc[n - 1 :]
            parts.append(mix(total[whole] + np.uint64(n)))
            owners.append(doc[:full][whole])
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            head = np.cumsum(count) - count
            for k in range(1, n):
                of = short[count[short] == k]
                total = np.zeros(len(of), np.uint64)
                for j in range(k):
                    total += hashes[head[of] + j] * _STEPS[j]
                parts.append(mix(total + np.uint64(k)))
                owners.append(of)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash) pairs, ordered by document and hash, as (hash, document)."""
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        h, d = hashes[order], doc[order]
    else:
        h, d = hashes.copy(), doc
    start = 0
    for end in np.cumsum(np.bincount(d)).tolist():
        h[start:end].sort()
        start = end
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document as (hash, document), ordered by document and hash; A-Z are lower-cased."""
    low = LOWER[raw]
    starts, ends, doc = runs(low, offsets, SPACE)
    h, d = grams(hash_runs(low, starts, ends), doc, len(offsets) - 1, n)
    return distinct(h, d)
