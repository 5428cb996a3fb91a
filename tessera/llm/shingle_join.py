"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups its links form.

A document's set holds its distinct n-word shingles (as 64-bit hashes); two sets link when 100 * common >=
percent * union, so a set of size s needs at least T(s) = ceil(percent * s / 100) shingles in common with any partner.

1. Equal sets form a class (by size and a 128-bit digest) with a number of its own; one document stands for it, the one
   with the least doc_id and text hash.
2. Count filter. If two sets have T common shingles, their prefixes of s - T(s) + k least hashes have k of those in
   common. Prefixes with k = s // 8 go, packed, to buckets of the hash space; a class of which fewer than k prefix
   shingles occur in any other class has no partner. Shingles shared inside one task's batch are counted there and
   sent once, so a frequent shingle does not gather its documents in a bucket, and a task adds up the counts of all its
   buckets before they are shuffled.
3. The remaining sets are ordered rarest shingle first (frequencies are counted in the same packed way). Each inverted
   list of their short prefixes gathers around its least class; a group is the classes that meet at one such leader,
   dealt to blocks of bounded size.
4. In a block the T-occurrence search runs on its inverted index: for the leader, then for each member found, until its
   component is complete, then for the next member; members found leave the index. The index is kept by bands of sizes, since
   a partner of about the same size needs a larger overlap T than the smallest partner. A query's lists are divided: the
   longest L = T / (0.0085 log2(longest) + 1) are set aside;
   of the short ones all but the longest T - L - 1 are merged, and those skip to what the others hold; what occurs T - L times
   is probed in the long lists, and what reaches the exact overlap links. Lists of a block are short, so where a binary search
   costs more than to count a list whole, it is counted.
5. The links of all blocks give components. In a group of several blocks only the members outside its largest component are
   searched in its other blocks: all others are connected already.

Blocks give a spanning tree of the links in them, never all pairs of a group. Null texts, empty texts and texts without words have no set and link with
nothing; null ids likewise. Equal rows are members of one class each, and rows that share an id but no text are documents of
their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_key, lookup, mix, stored, table, text_slices
from tessera.llm.components import components
from tessera.llm.kernels import shingles

#: Postings that a task packs at once, and aims at for a bucket; counts that a task holds before it adds them up.
FLUSH, PER_BUCKET, HELD = 1_000_000, 2_000_000, 4_000_000
#: Documents of a block.
BLOCK = 1500
_D1, _D2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def least_overlap(size, percent: int):
    """ceil(percent * size / 100): common shingles that a set of this size needs with any partner."""
    return -(-percent * size // 100)


def _digests(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, digest, digest) of each document's set."""
    size = np.bincount(doc, minlength=n)
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    some = size > 0
    if len(h):
        heads = (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            for o, c in zip(out, (_D1, _D2), strict=True):
                o[some] = np.add.reduceat(mix(h ^ c), heads)
    return size, out[0].view(np.int64), out[1].view(np.int64)


def sets(docs: DataFrame, n: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, x (xxhash64 of the text), size, d1, d2 of every document's shingle set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column(2)):
                size, d1, d2 = _digests(*shingles(raw, offsets, n), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size), pa.array(d1), pa.array(d2)], ["doc_id", "x", "size", "d1", "d2"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("x"), F.col(text).alias("_t"))
    return given.mapInArrow(apply, "doc_id long, x long, size long, d1 long, d2 long")


def _heads(values: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    heads = _heads(keys)
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


def _place(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 bits that tell a shingle from others in its bucket)."""
    return (h & np.uint64(n_buckets - 1)).astype(np.int64), (h >> np.uint64(24)).astype("<u4")


def _pack(h: np.ndarray, doc: np.ndarray, kinds: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Rows (bucket, shingles by class, shingles of each class, classes) of one batch of postings; bucket -1: classes with counts instead.

    kinds has the class of each document doc, in which a shingle comes once.
    """
    kinds, first, doc_kind = np.unique(kinds, return_index=True, return_inverse=True)
    once = first[doc_kind[doc]] == doc  # of documents of one class the first
    h, doc = h[once], doc_kind[doc[once]]
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    many = ~head
    many[:-1] |= ~head[1:]
    if many.any():
        counts = np.bincount(doc[many], minlength=len(kinds))
        yield -1, b"", counts[counts > 0].astype("<u4").tobytes(), kinds[counts > 0].astype("<i8").tobytes()
    bucket, token = _place(h[head], n_buckets)
    place = np.where(many, 0, doc + 1)[head]  # 0: several classes
    order = np.argsort(bucket << 32 | place)
    bucket, token, cls = bucket[order], token[order], np.append(0, kinds)[place[order]]
    cuts = [*_heads(bucket), len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        heads = _heads(cls[a:b])
        counts = np.diff(np.append(heads, b - a))
        yield int(bucket[a]), token[a:b].tobytes(), counts.astype("<u4").tobytes(), cls[a:b][heads].astype("<i8").tobytes()


def _meetings(docs: DataFrame, n: int, percent: int, n_buckets: int, text: str) -> DataFrame:
    """cls, n: prefix shingles of a class that occur in another one (at least)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, docs, kinds, held, known = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = list(zip(*_pack(np.concatenate(hs), np.concatenate(docs), np.concatenate(kinds), n_buckets), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bucket", "toks", "counts", "cls"])

        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column(0)):
                h, doc = shingles(raw, offsets, n)
                size, d1, _ = _digests(h, doc, j - i)
                prefix = size - least_overlap(size, percent) + np.maximum(1, size // 8)
                rank = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
                keep = rank < prefix[doc]
                hs.append(h[keep])
                docs.append(doc[keep] + known)
                kinds.append(d1)
                known += j - i
                held += len(hs[-1])
                if held >= FLUSH:
                    yield flush()
                    hs, docs, kinds, held, known = [], [], [], 0, 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            cls, count = _summed(np.concatenate(kinds), np.concatenate(counts))
            part = cls & (n_buckets - 1)
            order = np.argsort(part, kind="stable")
            cls, count, part = cls[order], count[order], part[order]
            cuts = [*_heads(part), len(part)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), *(pa.array([c[a:b].astype(t).tobytes() for a, b in spans], pa.binary()) for c, t in ((cls, "<i8"), (count, "<u4")))], ["part", "cls", "counts"])

        for (bucket,), rows in by_key(batches, 1):
            parts = list(zip(*(rows.column(c).to_pylist() for c in ("toks", "counts", "cls")), strict=True))
            each = np.concatenate([np.frombuffer(c, "<u4") for _, c, _ in parts]).astype(np.int64)
            cls = np.concatenate([np.frombuffer(k, "<i8") for _, _, k in parts])
            if bucket >= 0:
                tok, cls = np.concatenate([np.frombuffer(t, "<u4") for t, _, _ in parts]), np.repeat(cls, each)
                order = np.argsort(tok)
                tok, cls = tok[order], cls[order]
                heads = _heads(tok)
                low, high = np.minimum.reduceat(cls, heads), np.maximum.reduceat(cls, heads)
                shared = low != high  # 0, which stands for several classes, is another one too
                mine = np.repeat(shared, np.diff(np.append(heads, len(tok)))) & (cls != 0)
                tok, cls = tok[mine], cls[mine]
                order = np.lexsort((cls, tok))
                tok, cls = tok[order], cls[order]
                new = np.ones(len(tok), bool)
                new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
                cls = cls[new]
                each = np.ones(len(cls), np.int64)
            cls, each = _summed(cls, each)
            kinds.append(cls)
            counts.append(each)
            held += len(cls)
            if held >= HELD:
                yield flush()
                kinds, counts, held = [], [], 0
        if held:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            cls, count = (np.concatenate([np.frombuffer(v, t) for v in rows.column(c).to_pylist()]) for c, t in (("cls", "<i8"), ("counts", "<u4")))
            cls, count = _summed(cls, count.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(count)], ["cls", "n"])

    sent = docs.select(F.col(text).alias("_t")).mapInArrow(send, "bucket int, toks binary, counts binary, cls binary")
    spread = F.when(F.col("bucket") < 0, -F.pmod(F.xxhash64("cls"), F.lit(n_buckets)).cast("int") - 1).otherwise(F.col("bucket"))
    sent = sent.withColumn("bucket", spread)
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "part int, cls binary, counts binary")
    return met.repartition("part").sortWithinPartitions("part").mapInArrow(total, "cls long, n long")


def _arrays(docs: DataFrame, reps: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """f, c, size, toks: the sorted shingles of the classes' representatives, in flocks f of about FLUSH shingles.

    Equal rows that stand for one class come once per task; further copies do no harm but work.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("rep"), F.xxhash64(text).alias("x"), F.col(text).alias("_t"))
    some = given.join(reps.select("rep", "x", "c", "d1", "d2"), ["rep", "x"]).select("c", "d1", "d2", "_t")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        flock, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column(3)):
                h, doc = shingles(raw, offsets, n)
                size, d1, d2 = _digests(h, doc, j - i)
                c = batch.column(0)[i:j].to_numpy()
                own = (d1 == batch.column(1)[i:j].to_numpy()) & (d2 == batch.column(2)[i:j].to_numpy())
                own = [k for k in np.flatnonzero(own).tolist() if not (c[k] in seen or seen.add(c[k]))]
                heads = np.cumsum(size) - size
                toks = [h[heads[k] : heads[k] + size[k]].view(np.int64) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), flock)), pa.array(c[own]), pa.array(size[own]), pa.array([np.sort(t) for t in toks], pa.list_(pa.int64()))], ["f", "c", "size", "toks"])
                held += int(size[own].sum())
                if held >= FLUSH:
                    flock, held = flock + 1, 0

    return some.mapInArrow(apply, "f long, c long, size long, toks array<long>")


def _prefixes(arrays: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """c, tok: the shingles that other sets have too of each set's prefix, rarest shingle first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (flock,), rows in by_key(batches, 1):
            h, count = np.unique(np.concatenate(_lists(rows.column("toks"))).view(np.uint64), return_counts=True)
            bucket, token = _place(h, n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, token, count = bucket[order], token[order], count[order].astype("<u4")
            cuts = [*_heads(bucket), len(bucket)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([flock] * len(spans), pa.int64()), *(pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (token, count))], ["bucket", "f", "tok", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in by_key(batches, 1):
            tok = [np.frombuffer(v, "<u4") for v in rows.column("tok").to_pylist()]
            known, df = _summed(np.concatenate(tok), np.concatenate([np.frombuffer(v, "<u4") for v in rows.column("n").to_pylist()]).astype(np.int64))
            known, df = known[df > 1], np.minimum(df[df > 1], 2**32 - 1).astype("<u4")
            # each flock's shingles are looked up: a pass over all of the bucket's for each flock would grow with the square
            at = [np.searchsorted(known, t) for t in tok]
            there = [np.unique(p[known[np.minimum(p, len(known) - 1)] == t]) if len(known) else p[:0] for p, t in zip(at, tok, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("f").combine_chunks(), pa.array([bucket] * len(tok), pa.int32()), *(pa.array([v[at].tobytes() for at in there], pa.binary()) for v in (known, df))], ["f", "bucket", "tok", "df"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 1):
            kept = rows.filter(rows.column("c").is_valid())
            told = rows.filter(rows.column("c").is_null())
            if not kept.num_rows or not told.num_rows:
                continue
            place, df = [], []
            for b, t, d in zip(*(told.column(k).to_pylist() for k in ("bucket", "tok", "df")), strict=True):
                place.append(np.frombuffer(t, "<u4").astype(np.int64) | b << 32)
                df.append(np.frombuffer(d, "<u4"))
            place, df = np.concatenate(place), np.concatenate(df)
            order = np.argsort(place)
            place, df = place[order], df[order]
            lists = _lists(kept.column("toks"))
            size = np.array([len(x) for x in lists])
            tok, doc = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
            bucket, token = _place(tok.view(np.uint64), n_buckets)
            key = token.astype(np.int64) | bucket << 32
            at = np.searchsorted(place, key)
            shared = np.flatnonzero(place[np.minimum(at, len(place) - 1)] == key) if len(place) else np.zeros(0, np.int64)
            doc, tok, df = doc[shared], tok[shared], df[at[shared]]
            order = np.lexsort((tok, df, doc))
            doc, tok = doc[order], tok[order]
            some = np.bincount(doc, minlength=len(lists))
            # the shingles no other set has come before all shared ones
            rest = some - least_overlap(size, percent) + 1
            use = np.arange(len(doc)) - (np.cumsum(some) - some)[doc] < rest[doc]
            yield pa.RecordBatch.from_arrays([pa.array(kept.column("c").to_numpy()[doc[use]], pa.int64()), pa.array(tok[use], pa.int64())], ["c", "tok"])

    sent = arrays.select("f", "toks").mapInArrow(send, "bucket int, f long, tok binary, n binary")
    told = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "f long, bucket int, tok binary, df binary")
    null = lambda kind: F.lit(None).cast(kind)
    both = arrays.select("f", "c", "toks", null("int").alias("bucket"), null("binary").alias("tok"), null("binary").alias("df"))
    both = both.unionByName(told.select("f", null("long").alias("c"), null("array<long>").alias("toks"), "bucket", "tok", "df"))
    return both.repartition("f").sortWithinPartitions("f").mapInArrow(pick, "c long, tok long")


def _occurrences(values: np.ndarray, lists: Sequence[np.ndarray]) -> np.ndarray:
    """In how many of the sorted lists (of numbers from 0) each of the sorted values is: each list skips to them by binary
    search, or all are counted where that is less work (a search costs as much as some 3,000 + 60 * len(values) numbers)."""
    if sum(map(len, lists)) > len(lists) * (3000 + 60 * len(values)):
        hits = np.zeros(len(values), np.int64)
        for x in lists:
            hits += x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
        return hits
    return np.bincount(np.concatenate(lists), minlength=int(values[-1]) + 1)[values] if len(lists) else np.zeros(len(values), np.int64)


def merge_skip(lists: Sequence[Sequence[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, occurrences) of the values, numbers from 0, that occur in at least `least` of the sorted lists.

    Such a value is in one of all but the longest least - 1 lists: those are merged, and the longest ones skip to what they hold.
    """
    lists = sorted((np.asarray(x, np.int64) for x in lists if len(x)), key=len)
    merged = len(lists) - max(least, 1) + 1
    if merged < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(np.concatenate(lists[:merged]))
    values = np.flatnonzero(count)
    hits = count[values] + _occurrences(values, lists[merged:])
    enough = hits >= least
    return values[enough], hits[enough]


def t_occurrence(query: np.ndarray, keys: np.ndarray, heads: np.ndarray, lists: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Documents of an inverted index (sorted keys, heads of their sorted lists) that link with the query set."""
    at = np.searchsorted(keys, query)
    at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == query)]
    # a partner is not smaller than the index's least set: the overlap of two sets is percent / (100 + percent) of both sizes
    smallest = max(int(sizes.min()), least_overlap(len(query), percent))
    need = -(-percent * (len(query) + smallest) // (100 + percent))
    length = heads[at + 1] - heads[at]
    if len(at) < need:
        return np.zeros(0, np.int64)
    order = np.argsort(length, kind="stable")
    at, length = at[order], length[order]
    aside = min(need - 1, int(need / (0.0085 * math.log2(max(2, int(length[-1]))) + 1)), len(at))
    own = [lists[a:b] for a, b in zip(heads[at].tolist(), heads[at + 1].tolist(), strict=True)]
    found, hits = merge_skip(own[: len(own) - aside], need - aside)
    if len(found):
        hits = hits + _occurrences(found, own[len(own) - aside :])
    return found[100 * hits >= percent * (len(query) + sizes[found] - hits)]


def _index(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a in arrays], np.int64)
    tok, doc = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
    order = np.argsort(tok, kind="stable")
    tok, doc = tok[order], doc[order]
    heads = _heads(tok)
    return tok[heads], np.append(heads, len(tok)), doc, sizes


def _bands(arrays: list[np.ndarray], ids: np.ndarray) -> list[tuple[np.ndarray, tuple]]:
    """(their ids, inverted index) of the sets of each band of sizes, which differ by a tenth at most."""
    sizes = np.array([len(arrays[k]) for k in ids], np.int64)
    order = np.argsort(sizes, kind="stable")
    out, start = [], 0
    while start < len(order):
        end = int(np.searchsorted(sizes[order], sizes[order[start]] * 11 // 10, "right"))
        own = np.sort(ids[order[start:end]])
        out.append((own, _index([arrays[k] for k in own])))
        start = end
    return out


def _partners(query: np.ndarray, bands: list[tuple[np.ndarray, tuple]], percent: int) -> list[int]:
    """The ids of the sets in the bands that link with the query set."""
    out: list[int] = []
    for own, index in bands:
        sizes = index[3]
        if 100 * int(sizes.max()) >= percent * len(query) and percent * int(sizes.min()) <= 100 * len(query):
            out += own[t_occurrence(query, *index, percent)].tolist()
    return out


def _bridges(arrays: list[np.ndarray], own: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (k, m) that connect what the links between the sets k outside a block (not own) and the sets m of it connect.

    Sets of equal labels are connected already: no link of theirs is looked for.
    """
    label, there, links = np.unique(label, return_inverse=True)[1], np.flatnonzero(own), []
    bands = _bands(arrays, there)
    for k in np.flatnonzero(~own).tolist():
        if (label[there] == label[k]).all():
            continue
        for m in _partners(arrays[k], bands, percent):
            if label[m] != label[k]:
                links.append((k, m))
                label[label == label[m]] = label[k]
    return links


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    values, offs = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [values[offs[i] : offs[i + 1]] for i in range(len(c))]


def _spanning(arrays: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(links, members): a spanning tree of every component of the sets, and the members not connected with the first set.

    A set found leaves the index (which is made anew when half of it is gone): it needs no other link.
    """
    links: list[tuple[int, int]] = []
    apart: list[int] = []
    found = np.zeros(len(arrays), bool)
    indexed, bands, live = 0, None, len(arrays)
    for seed in range(len(arrays)):
        if found[seed]:
            continue
        found[seed] = True
        live -= 1
        todo = [seed]
        while todo:
            k = todo.pop()
            if seed:
                apart.append(k)
            if not live:
                continue
            if bands is None or 2 * live <= indexed:
                indexed, bands = live, _bands(arrays, np.flatnonzero(~found))
            for m in _partners(arrays[k], bands, percent):
                if not found[m]:
                    found[m] = True
                    live -= 1
                    links.append((k, m))
                    todo.append(m)
    return links, sorted(apart)


def _group_links(members: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links that connect what each group (leader, c, toks) connects."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("_g"))
    dealt = lookup(members, sizes, ["leader"], "n").withColumn("_b", F.when(F.col("c") == F.col("leader"), F.lit(None)).otherwise(F.pmod(F.xxhash64("c"), F.col("_g")).cast("int")))
    # the leader comes to every block of its group
    homes = F.when(F.col("_b").isNull(), F.sequence(F.lit(0), F.col("_g") - 1)).otherwise(F.array("_b"))
    blocks = dealt.withColumn("_b", F.explode(homes)).select("leader", "_b", (F.col("c") != F.col("leader")).alias("_o"), "c", "toks")
    blocks = blocks.repartition("leader", "_b").sortWithinPartitions("leader", "_b", "_o")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 2):
            links, _ = _spanning(_lists(rows.column("toks")), percent)
            c = rows.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c[[k for k, _ in links]] if links else c[:0]), pa.array(c[[m for _, m in links]] if links else c[:0])], ["a", "b"])

    links = table(blocks.mapInArrow(star, "a long, b long"), "star-links")
    if not sizes.filter("_g > 1").head(1):
        return links
    # Blocks of one group: what the links of all blocks connect is known, so only members outside the largest component of their
    # group are searched in its other blocks.
    known = components(links).withColumnRenamed("id", "c")
    placed = stored(dealt.filter("_g > 1 and _b is not null").select("leader", "c", "_b", "_g").join(known, "c", "left").withColumn("label", F.coalesce("component", "c")).drop("component"), "placed")
    parts = placed.rows.groupBy("leader", "label").agg(F.count("*").alias("k")).groupBy("leader").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("n"), F.max("k").alias("k"))
    parts = parts.select("leader", "n", "main", F.ceil((F.col("n") - F.col("k")) / block).cast("int").alias("_q")).filter("_q > 0")
    marked = lookup(placed.rows, parts, ["leader"], "n").join(members, ["leader", "c"])
    asked = marked.filter("label <> main").withColumn("_q", F.pmod(F.xxhash64("c"), F.col("_q")).cast("int"))
    asked = asked.withColumn("_o", F.lit(False)).withColumn("_in", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).filter("_in <> _b")
    into = marked.withColumn("_o", F.lit(True)).withColumn("_in", F.col("_b")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    cells = asked.select("leader", "_in", "_q", "_o", "c", "label", "toks").unionByName(into.select("leader", "_in", "_q", "_o", "c", "label", "toks"))
    cells = cells.repartition("leader", "_in", "_q").sortWithinPartitions("leader", "_in", "_q", "_o")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, 3):
            c, own = rows.column("c").to_numpy(), rows.column("_o").to_numpy(zero_copy_only=False)
            if own.all() or not own.any():
                continue
            found = _bridges(_lists(rows.column("toks")), own, rows.column("label").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(c[[k for k, _ in found]] if found else c[:0]), pa.array(c[[m for _, m in found]] if found else c[:0])], ["a", "b"])

    more = table(cells.mapInArrow(across, "a long, b long"), "block-links")
    placed.drop()
    return links.unionByName(more)


def _buckets(shingles_sent: int) -> int:
    return 1 << min(20, max(4, (shingles_sent // PER_BUCKET).bit_length()))


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 75, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document; see the module for nulls, ties and repeats."""
    return ngram_members(docs, n, percent, text, doc_id, block).select("doc_id", "n_shingles", "component_id")


def ngram_members(docs: DataFrame, n: int = 5, percent: int = 75, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The columns of `ngram_groups`, then x (xxhash64 of the text) and kept.

    kept: the row stands for its group, being the one with the least doc_id and x (equal rows all are), or links with nothing.
    """
    every = table(sets(docs, n, text, doc_id), "sets")
    usable = every.filter("size > 0 and doc_id is not null")
    classes = usable.groupBy("size", "d1", "d2").agg(F.min(F.struct("doc_id", "x")).alias("r"), F.count("*").alias("mult"))
    # two classes can have the same least id when ids repeat: a class is known by its number
    classes = table(classes.select("size", "d1", "d2", "r.x", F.col("r.doc_id").alias("rep"), "mult", F.monotonically_increasing_id().alias("c")), "set-classes")
    sums = classes.agg(F.sum(F.col("size") * F.col("mult")).alias("s")).head()["s"] or 0
    met = _meetings(docs, n, percent, _buckets(int(sums) * 3 // 8), text)
    partner = F.floor((F.lit(percent) * F.col("size") + 99) / 100)  # the least size of a partner
    alive = classes.join(met, classes["d1"] == met["cls"]).filter(F.col("n") >= F.greatest(F.lit(1), F.floor(partner / 8)))
    arrays = stored(_arrays(docs, alive.select("rep", "x", "c", "d1", "d2"), n, text, doc_id), "set-arrays")
    held = arrays.rows.agg(F.sum("size").alias("s")).head()["s"] or 0
    prefix = stored(_prefixes(arrays.rows, percent, _buckets(int(held))), "prefixes")
    leaders = stored(prefix.rows.groupBy("tok").agg(F.min("c").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    meeting = lookup(prefix.rows, leaders.rows, ["tok"], "n").select("leader", "c").distinct()
    members = stored(meeting.join(arrays.rows.select("c", "toks"), "c").select("leader", "c", "toks"), "set-groups")
    for used in (arrays, prefix, leaders):
        used.drop()
    comp = components(_group_links(members.rows, percent, block))
    members.drop()
    comp = comp.join(classes.select(F.col("c").alias("id"), F.struct(F.col("rep"), F.col("x")).alias("r")), "id")
    least = table(comp.groupBy("component").agg(F.min("r").alias("_r"), F.count("*").alias("n")), "set-components")
    named = lookup(comp.select("id", "component"), least, ["component"], "n").select(F.col("id").alias("c"), "_r")
    own = F.struct(F.col("rep"), F.col("x"))
    named = table(classes.join(named, "c", "left").select("size", "d1", "d2", "mult", F.coalesce("_r", own).alias("_r")), "set-names")
    out = lookup(usable, named, ["size", "d1", "d2"], "mult").select("doc_id", "size", "x", F.col("_r.rep").alias("component_id"), F.col("_r.x").alias("_x"))
    alone = every.filter("size = 0 or doc_id is null").select("doc_id", "size", "x", F.col("doc_id").alias("component_id"), F.col("x").alias("_x"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("x").eqNullSafe(F.col("_x"))
    return out.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", "x", kept.alias("kept"))
