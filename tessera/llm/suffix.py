"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere.

1. Winnowing: in every string of `length` bytes the 32-byte gram with the least hash (the leftmost on ties) is its
   anchor. Consecutive strings with one anchor form a region; equal strings have equal anchors at equal places, so they
   lie in regions with equal anchor hashes. An anchor that occurs once holds no repeated string. Equal regions that follow
   each other (a periodic text) are one row with their number.
2. Regions that occur in whole more than once are removed in whole; of each kind one stands for the others.
3. An equal string reaches half its remaining bytes to the left or to the right of the anchor, so a region that shares
   neither context with a different region of its anchor has no string of the others. Different regions with the same
   anchor hash and a shared context meet in a shard. A shard's suffix array is made by induced sorting:
   suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by two inducing sweeps and named, the
   string of names is sorted recursively, and two more sweeps induce the array from the sorted LMS suffixes. Its
   permuted common prefixes show the strings that start at two places.
4. Of an anchor with very many different regions (a passage with other words around it in each document) no shard could hold
   all: their strings are counted by digest instead.

Sweeps run in numpy over stretches of the array whose results don't depend on each other. Strings are judged on the input; spans overlap freely and never cross documents.

Ids are integers. Null texts are empty, null ids are ids of their own; equal rows are two documents. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_key, lookup, mix, random_words, slices, table, text_slices

GRAM = 32
#: Bytes of a shard, and regions of an anchor beyond which its strings are counted by digest.
SHARD_BYTES, MANY = 1_000_000, 1000
#: Digests that a bucket of crowded anchors' strings aims at.
STRINGS = 500_000
#: Starts handled at once; a place must fit in 24 bits.
PIECE = 8_000_000
_BYTES = random_words(256, 5)
_LEVELS = random_words(8, 6) | np.uint64(1)


def _by_symbol(c: np.ndarray, kinds: int) -> np.ndarray:
    """The stable order of symbols below kinds; numpy sorts 16-bit integers by radix, in linear time."""
    return np.argsort(c.astype(np.uint16) if kinds <= 1 << 16 else c, kind="stable")


def _sweep(t: np.ndarray, sa: np.ndarray, heads: np.ndarray, wanted: np.ndarray) -> None:
    """Induce along sa: each entry's predecessor, if wanted, goes to the next free place of its bucket.

    A stretch ends before the first place it writes to, so all its entries are final when they are read.
    """
    n, i, width = len(sa), 0, 1024
    while i < n:
        j = min(n, i + width)
        entry = sa[i:j]
        k = np.flatnonzero(entry > 0)
        before = entry[k] - 1
        use = wanted[before]
        k, before = k[use], before[use]
        if not len(k):
            i, width = j, min(2 * width, 1 << 17)
            continue
        c = t[before]
        order = _by_symbol(c, len(heads))
        cs = c[order]
        first = np.flatnonzero(np.concatenate([[True], cs[1:] != cs[:-1]]))
        rank = np.arange(len(cs)) - np.repeat(first, np.diff(np.append(first, len(cs))))
        slot = np.empty(len(cs), np.int64)
        slot[order] = heads[cs] + rank
        end = min(j, int(slot.min()))
        if end < j:
            now = k + i < end
            before, slot, c = before[now], slot[now], c[now]
        sa[slot] = before
        np.add.at(heads, c, 1) if len(c) < 64 else heads.__iadd__(np.bincount(c, minlength=len(heads)))
        width = min(2 * width, 1 << 17) if end == j else max(64, 2 * (end - i))
        i = end


def _induce(t: np.ndarray, stype: np.ndarray, counts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that sorted LMS suffixes induce (or, from LMS in text order, the order of LMS substrings)."""
    n = len(t)
    ends = np.cumsum(counts)
    sa = np.full(n, -1, np.int64)
    c = t[lms]
    order = _by_symbol(c, len(counts))
    cs = c[order]
    per = np.bincount(cs, minlength=len(counts))
    slots = np.arange(len(cs)) - (np.cumsum(per) - per)[cs] + (ends - per)[cs]
    sa[slots] = lms[order]
    heads = ends - counts
    sa[heads[t[n - 1]]] = n - 1  # the end of the text comes first and induces the last suffix
    heads[t[n - 1]] += 1
    _sweep(t, sa, heads, ~stype)
    sa[slots] = -1
    _sweep(t, sa[::-1], n - ends, stype)
    return sa


def suffix_array(t: np.ndarray, kinds: int) -> np.ndarray:
    """Starts of the suffixes of t (integers below kinds) in ascending order; the end of the text is least."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[change[:-1]] < t[change[:-1] + 1], False)
    stype = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    counts = np.bincount(t, minlength=kinds)
    if len(lms) > 1:
        by_substring = _induce(t, stype, counts, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = by_substring[is_lms[by_substring]]
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms) + 1, n + 1)  # the last one reaches beyond the end and equals no other
        a, b = ordered[:-1], ordered[1:]
        same = length[a] == length[b]
        at = np.flatnonzero(same)
        size = length[a[at]]
        if len(at):
            heads = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(heads, size)
            same[at] = np.logical_and.reduceat(t[np.repeat(a[at], size) + step] == t[np.repeat(b[at], size) + step], heads)
        names = np.zeros(n, np.int64)
        names[ordered] = np.concatenate([[0], np.cumsum(~same)])
        reduced = names[lms]
        if int(reduced.max()) + 1 == len(lms):
            lms = ordered
        else:
            lms = lms[suffix_array(reduced, int(reduced.max()) + 1)]
    return _induce(t, stype, counts, lms)


def permuted_prefixes(raw: np.ndarray, t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each start the suffix before it in the array, and the length of their common prefix.

    Where the symbols of t (whose suffix array sa is) before both starts are equal, the length is one less than that of
    the start before, so only the other starts compare bytes, eight at a time.
    """
    n = len(raw)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    at = np.flatnonzero(phi[1:] > 0) + 1
    own[at] = t[at - 1] != t[phi[at] - 1]
    plcp = np.zeros(n, np.int64)
    heads = np.flatnonzero(own & (phi >= 0))
    words = np.ndarray((n,), "<u8", buffer=np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    a, b, live = heads.copy(), phi[heads], heads
    while len(live):
        most = n - np.maximum(a, b)
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        low = differ & (~differ + np.uint64(1))  # its lowest bit set
        equal = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(float)) // 8).astype(np.int64))
        equal = np.minimum(equal, most)
        plcp[live] += equal
        on = (equal == 8) & (most > 8)
        a, b, live = a[on] + 8, b[on] + 8, live[on]
    last = np.maximum.accumulate(np.where(own, np.arange(n), -1))
    plcp = np.where(own, plcp, plcp[last] - (np.arange(n) - last))
    return phi, plcp


def repeated_starts(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region the starts of strings of `length` bytes that start at two places of the regions or more."""
    raw = np.frombuffer(b"\0".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    t = raw.astype(np.int64) + 1
    t[ends[:-1]] = 0
    sa = suffix_array(t, 257)
    phi, plcp = permuted_prefixes(raw, t, sa)
    room = np.concatenate([np.arange(s, -1, -1) for s in sizes])[: len(raw)]
    hit = np.flatnonzero((plcp >= length) & (room >= length) & (phi >= 0))
    hit = hit[room[phi[hit]] >= length]
    found = np.zeros(len(raw), bool)
    found[hit] = True
    found[phi[hit]] = True
    return [np.flatnonzero(found[s:e]) for s, e in zip(starts, ends, strict=True)]


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    h = _BYTES[raw]
    with np.errstate(over="ignore"):
        for level in range(5):
            step = 1 << level
            h = h[:-step] * _LEVELS[level] + h[step:]
        return mix(h)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width keys: block prefix minima joined with block suffix minima."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _regions(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, end, anchor, hash) of the regions of a slice, places within the slice."""
    place = np.uint64((1 << 24) - 1)
    for p in range(0, max(len(raw) - length + 1, 0), PIECE):
        part = raw[p : p + PIECE + length - 1]
        h = _grams(part)
        low = _least((h & ~place) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        anchor = (low & place).astype(np.int64)
        start = np.arange(len(anchor)) + p
        doc = np.searchsorted(offsets, start, side="right") - 1
        valid = start + length <= offsets[doc + 1]
        start, doc, anchor = start[valid], doc[valid], anchor[valid]
        if not len(start):
            continue
        head = np.ones(len(start), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(start)) - 1
        yield doc[first], start[first], start[last] + length, anchor[first] + p, h[anchor[first]]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _window_hashes(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives 32-bit hashes of raw[low:high], from prefix sums of a polynomial."""
    n = len(raw)
    power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power(_BASE)[:n])])
        inverse = power(_INVERSE)

    def of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix((sums[high] - sums[low]) * inverse[low]) >> np.uint64(32)).astype(np.int64)

    return of


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """id, x, start, end, anchor (in the document), h, digest of every region; left, right: hashes of the anchor with its contexts.

    A run of equal regions is one row: its first region, their number k and the end of the last one, upto.
    """
    half = -(-(length - GRAM) // 2)

    def context(of, low: np.ndarray, high: np.ndarray, has: np.ndarray) -> pa.Array:
        found = of(np.where(has, low, 0), np.where(has, high, 0)).astype(np.uint32).view(np.int32)
        return pa.array(found, mask=~has)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column(2)):
                of = _window_hashes(raw)
                for doc, start, end, anchor, h in _regions(raw, offsets, length):
                    base, view = offsets[doc], memoryview(np.ascontiguousarray(raw))
                    digest = np.array([xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
                    first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                    number = np.diff(np.append(first, len(h)))
                    upto = end[first + number - 1]
                    doc, start, end, anchor, h, digest, base = (v[first] for v in (doc, start, end, anchor, h, digest, base))
                    take = pa.array(doc + i)
                    left = context(of, anchor - half, anchor + GRAM, start <= anchor - half)
                    right = context(of, anchor, anchor + GRAM + half, end >= anchor + GRAM + half)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(v - base, pa.int32()) for v in (start, end, anchor)), pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), left, right, pa.array(upto - base, pa.int32()), pa.array(number, pa.int64())],
                        ["id", "x", "start", "end", "anchor", "h", "digest", "left", "right", "upto", "k"],
                    )

    return docs.filter(F.octet_length("_t") >= length).select("id", "x", "_t").mapInArrow(scan, "id long, x long, start int, end int, anchor int, h long, digest long, left int, right int, upto int, k long")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, x (xxhash64 of the text), _t. Both joins of texts shuffle exactly this, so one shuffle serves both."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("x"), F.col(text).alias("_t"))


def _with_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x"))
    return docs.join(rows.withColumnsRenamed({"id": "_id", "x": "_x"}), same, how)


def _sharing_context(meet: DataFrame) -> DataFrame:
    """The rows of meet whose left or right context another one with the same anchor has."""
    sides = F.array_compact(F.array(F.col("left").cast("long"), F.col("right").cast("long") + (1 << 33)))
    keys = meet.select("h", "digest", F.explode(sides).alias("side"))
    twice = keys.groupBy("h", "side").agg(F.count("*").alias("_n")).filter("_n > 1").select("h", "side")
    return meet.join(keys.join(twice, ["h", "side"]).select("h", "digest").distinct(), ["h", "digest"], "left_semi")


def _crowded_spans(held: DataFrame, length: int) -> DataFrame:
    """id, x, start, end: spans of the strings that occur twice among regions (id, x, _t, start, end) of crowded anchors.

    Strings are counted by 128-bit digests. A flock of regions sends each of its digests once to a bucket of the digest
    space, the bucket tells the flocks which of theirs occur twice; neither gets the bytes of an anchor's regions.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flock, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts, start, end = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, j in slices([e - s for s, e in zip(start, end, strict=True)]):
                found = [b"".join(xxhash.xxh3_128_digest(view[k : k + length]) for k in range(s, e - length + 1)) for view, s, e in zip(map(memoryview, texts[i:j]), start[i:j], end[i:j], strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([flock + n] * (j - i), pa.int64()), part.column(0), part.column(1), part.column(3), pa.array(found, pa.binary())], ["f", "id", "x", "start", "w"])
                n += 1

    coded = table(held.select("id", "x", "_t", "start", "end").mapInArrow(code, "f long, id long, x long, start int, w binary"), "crowded-strings")
    total = coded.agg(F.coalesce(F.sum(F.octet_length("w").cast("long")), F.lit(0)).alias("n")).head()["n"] // 16
    buckets = max(16, int(total // STRINGS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (flock,), rows in by_key(batches, 1):
            w, n = np.unique(np.frombuffer(b"".join(rows.column("w").to_pylist()), "S16"), return_counts=True)
            bucket = (w.view("<u8")[::2] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            w, n, bucket = w[order], n[order], bucket[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([flock] * len(spans), pa.int64()), pa.array([w[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([(n[a:b] > 1).tobytes() for a, b in spans], pa.binary())], ["bucket", "f", "w", "twice"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            own = [np.frombuffer(v, "S16") for v in rows.column("w").to_pylist()]
            every = np.concatenate(own)
            _, place, n = np.unique(every, return_inverse=True, return_counts=True)
            twice = np.frombuffer(b"".join(rows.column("twice").to_pylist()), bool)
            again = (n > 1) | (np.bincount(place, twice, len(n)) > 0)
            hit = np.split(again[place], np.cumsum([len(x) for x in own])[:-1])
            yield pa.RecordBatch.from_arrays([rows.column("f").combine_chunks(), pa.array([x[h].tobytes() for x, h in zip(own, hit, strict=True)], pa.binary())], ["f", "w"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            told = rows.column("x").is_null()
            known = np.frombuffer(b"".join(rows.filter(told).column("w").to_pylist()), "S16")
            regions = rows.filter(rows.column("x").is_valid())
            own = [np.frombuffer(v, "S16") for v in regions.column("w").to_pylist()]
            if not own or not len(known):
                continue
            hits = np.split(np.isin(np.concatenate(own), known), np.cumsum([len(x) for x in own])[:-1])
            row, low, high = [], [], []
            for k, (first, hit) in enumerate(zip(regions.column("start").to_pylist(), hits, strict=True)):
                found = np.flatnonzero(hit)
                if len(found):
                    gap = np.flatnonzero(np.diff(found) > 1)
                    row += [k] * (len(gap) + 1)
                    low += (first + found[np.append(0, gap + 1)]).tolist()
                    high += (first + found[np.append(gap, len(found) - 1)] + length).tolist()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([regions.column("id").take(take).combine_chunks(), regions.column("x").take(take).combine_chunks(), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["id", "x", "start", "end"])

    sent = coded.select("f", "w").mapInArrow(send, "bucket int, f long, w binary, twice binary")
    told = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "f long, w binary")
    told = told.select("f", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("int").alias("start"), "w")
    both = coded.unionByName(told).repartition("f").sortWithinPartitions("f")
    return both.mapInArrow(pick, "id long, x long, start int, end int")


def repeated_spans(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, x (xxhash64 of the text), start, end: byte spans that cover all repeated strings; they can overlap."""
    docs = _keyed(docs, text, doc_id)
    regions = table(_anchored(docs, length), "regions")
    row = F.struct(F.col("id").isNull().alias("z"), "id", "x", "start", "end", "anchor", "left", "right")
    kinds = table(regions.groupBy("h", "digest").agg(F.sum("k").alias("n"), F.min(row).alias("r")), "region-kinds")
    anchors = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("different")).filter("total > 1")
    known = table(kinds.join(anchors, "h"), "repeated-anchors")
    whole = lookup(regions, known.filter("n > 1").select("h", "digest", "n"), ["h", "digest"], "n").select("id", "x", "start", F.col("upto").alias("end"))
    meet = known.filter("different > 1").select("h", "digest", "different", "r.*").drop("z")
    meet = table(_sharing_context(meet).drop("digest", "left", "right"), "meeting-regions")
    total = meet.filter(F.col("different") <= MANY).agg(F.sum(F.col("end") - F.col("start")).alias("s")).head()["s"] or 0
    shards = max(1, int(total) // SHARD_BYTES)

    # bytes of the regions that meet others
    of_doc = meet.groupBy("id", "x").agg(F.collect_list(F.struct("h", "different", "start", "end")).alias("_r"))  # a document's own regions
    held = _with_text(docs, of_doc, "inner").select("id", "x", F.col("_t").cast("binary").alias("_t"), F.explode("_r").alias("_r")).select("id", "x", "_t", "_r.*")
    cut = held.filter(F.col("different") <= MANY)
    cut = cut.select(F.pmod("h", F.lit(shards)).alias("shard"), "id", "x", "start", F.expr("substring(_t, start + 1, end - start)").alias("bytes")).dropDuplicates(["id", "x", "start"])
    cut = cut.repartition("shard").sortWithinPartitions("shard")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            if rows.num_rows < 2:
                continue
            start = rows.column("start").to_numpy()
            row, low, high = [], [], []
            for k, found in enumerate(repeated_starts(rows.column("bytes").to_pylist(), length)):
                if len(found):
                    gap = np.flatnonzero(np.diff(found) > 1)
                    row += [k] * (len(gap) + 1)
                    low += (start[k] + found[np.append(0, gap + 1)]).tolist()
                    high += (start[k] + found[np.append(gap, len(found) - 1)] + length).tolist()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("id").take(take).combine_chunks(), rows.column("x").take(take).combine_chunks(), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["id", "x", "start", "end"])

    spans = whole.unionByName(cut.mapInArrow(sort, "id long, x long, start int, end int"))
    if not meet.filter(F.col("different") > MANY).head(1):
        return spans
    return spans.unionByName(_crowded_spans(held.filter(F.col("different") > MANY), length))


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), kept_chars (characters whose first byte remains)."""
    spans = repeated_spans(docs, length, text, doc_id).groupBy("id", "x").agg(F.collect_list(F.struct("start", "end")).alias("_s"))  # a document's own spans
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    joined = _with_text(_keyed(docs, text, doc_id), spans, "left").select(F.col("id").cast(kind).alias("doc_id"), F.coalesce(F.col("_t"), F.lit("")).cast("binary").alias("_t"), F.col("_s.start").alias("_a"), F.col("_s.end").alias("_b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, number, kept, chars = [], [], [], [], []
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                size.append(len(t))
                runs: list[list[int]] = []
                for s, e in sorted(zip(a or [], b or [], strict=True)):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                removed.append(sum(e - s for s, e in runs))
                number.append(len(runs))
                bounds = [0, *(v for run in runs for v in run), len(t)]
                t = b"".join(t[s:e] for s, e in zip(bounds[::2], bounds[1::2], strict=True))
                kept.append(t)
                chars.append(int((np.frombuffer(t, np.uint8) & 0xC0 != 0x80).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (size, removed, number)), pa.array(kept, pa.binary()), pa.array(chars, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_chars"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_chars long")
