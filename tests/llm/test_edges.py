"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import chunking, histogram, line_align, mixing, packing, pivots, quality, sharding, shingle_join, suffix
from tessera.llm.components import components
from tessera.llm.tokens import default_path, encode

EXTRA = ("size", "shard", "slot", "h", "id", "x", "start", "length", "n", "component", "rep", "leader", "position", "quality_score", "lines_total", "y", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(100)) for i in rng.integers(len(WORDS), size=n))


LONG = "\n".join(prose(k, 40) for k in range(1200))
COPY = prose(99, 300)


def nasty():
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\n \t", "en", "a", 7),
        (4, LONG, "en", "b", len(LONG)),
        (5, COPY, "en", "b", len(COPY)),
        (6, COPY, "en", None, len(COPY)),
        (6, COPY, "en", None, len(COPY)),
        (7, COPY + " one more", None, "b", None),
        (None, COPY, "en", "c", 5),
        (None, None, None, None, None),
        (8, "x" * 60_000, "de", "c", 60_000),
        (9, "日本語 のテキスト 😀 <|endoftext|> é\x00 end", "ja", "d", 30),
        (10, "one two", "en", "d", 7),
        (11, "ONE two", "en", "d", 7),
        (6, "another text under a known id", "en", "a", 29),
    ]
    return [(*r, *["q"] * len(EXTRA)) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 0, None), (10, None, 1), (None, 1, 0), (11, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


EVERY = Counter(r[0] for r in nasty())


def test_pivots(spark):
    inf, nan = float("inf"), float("nan")
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, v, 0), (2, w, 0), (3, v, 1), (4, None, 0), (5, [0.0] * 3, 0), (6, [1.0, None, 3.0], 0), (7, [1.0, inf, 3.0], 0), (8, [1.0, nan, 3.0], 0), (9, v, None), (None, v, 0), (10, [], 0), (11, [1e-30, 2e-30, 3e-30], 0), (12, [1.0, 2.0], 0), (2, w, 0), (13, [-1.0, -2.0, -3.0], 0)]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], "vec_id long, embedding array<float>, label int, rep string, n string")
    out = Counter(tuple(r) for r in pivots.near_vectors(df).collect())
    wanted = Counter([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13)), (None, 0, None, None)])
    assert out == wanted
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_pivots_blocks(spark):
    """Crowded lists in many blocks, against all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(300, 16)) * 0.22
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    np.fill_diagonal(hit, False)
    out = {r["vec_id"]: r for r in pivots.near_vectors(df, block=16).collect()}
    found, there = sum(r["n_links"] for r in out.values()), hit.sum()
    assert all(out[i]["n_links"] <= hit[i].sum() for i in range(300))
    assert found >= 0.9 * there > 0


@pytest.mark.parametrize("n_pivots", [64, 256, 2048])
def test_pivots_recall(spark, n_pivots, monkeypatch):
    """Planted pairs just above and below the threshold among several thousand other vectors, against all pairs."""
    monkeypatch.setattr(pivots, "MIN_PIVOTS", n_pivots)
    monkeypatch.setattr(pivots, "MAX_PIVOTS", n_pivots)
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, 64)))
    away = rng.normal(size=(600, 64))
    away = unit(away - (away * x[:600]).sum(1, keepdims=True) * x[:600])
    cos = np.concatenate([rng.uniform(0.9301, 0.94, 400), rng.uniform(0.92, 0.9299, 200)])[:, None]
    every = np.concatenate([x, cos * x[:600] + np.sqrt(1 - cos * cos) * away]).astype(np.float32)
    labels = np.concatenate([np.arange(3000), np.arange(600)]) % 3
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(every, labels, strict=True))], "vec_id long, embedding array<float>, label int").repartition(6)
    u = unit(every.astype(float))
    hit = (u @ u.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(hit, False)
    assert hit.sum() >= 800
    found = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(df).collect()}
    assert all(found[i] <= hit[i].sum() for i in range(len(every)))
    recall = sum(found.values()) / hit.sum()
    print(n_pivots, "pivots: recall", recall)
    assert recall >= 0.9


def test_pivots_repeated_ids(spark):
    """An id that repeats with another vector keeps each row's own links and component."""
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (2, [0.0, 0.0, 1.0], 0), (3, [0.0, 0.01, 1.0], 1), (2, [0.0, 1.0, 0.0], 1), (4, [0.0, 1.0, 0.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = Counter(tuple(r) for r in pivots.near_vectors(df).collect())
    assert out == Counter([(1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (3, 0, 3, True), (2, 1, 2, True), (4, 1, 2, False)])


def test_components(spark):
    n = 60
    links = [(i, i + 1) for i in range(1, n)] + [(100, 101), (101, 100), (102, 101), (7, 7)]
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, n + 1)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs, none):
    out = sharding.shard(docs, n_shards=4).collect()
    assert Counter(r["doc_id"] for r in out) == EVERY
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    assert sharding.shard(none).count() == 0
    # a group of more than half of all rows, and more shards than rows
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    out = sharding.shard(hot, n_shards=7).collect()
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 7
    assert len({r["shard"] for r in out if r["doc_id"] % 3}) == 5  # 200 equal rows in shards of 42 or 43
    assert len(sharding.shard(hot.limit(3), n_shards=7).collect()) == 3


def test_propagation(spark):
    """Rounds never cut more edges than before, and quotas hold back what has no room."""
    rows = [(i, f"group {i % 37}" if i % 3 else f"alone {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = []
    out = sharding.shard(df, n_shards=8, cuts=cuts).collect()
    assert cuts[0] > 1000 and cuts == sorted(cuts, reverse=True) and cuts[-1] == 0
    per = Counter(r["shard"] for r in out)
    assert max(per.values()) - min(per.values()) <= 1
    where = {}
    for r in out:
        if r["doc_id"] % 3:
            where.setdefault(r["doc_id"] % 37, set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    tight, cuts = spark.createDataFrame([(i, f"group {i % 6}") for i in range(300)], "doc_id long, text string"), []
    out = sharding.shard(tight, n_shards=6, cuts=cuts).collect()
    assert len({(r["doc_id"] % 6, r["shard"]) for r in out}) == 6 and cuts == sorted(cuts, reverse=True)


def test_packing(docs, none):
    out = packing.pack_documents(docs, context=256, with_ids=True).collect()
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == EVERY
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)
    filled = Counter()
    for r in out:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 256
    assert packing.pack_documents(none).count() == 0


def test_column_generation():
    sizes, demand = np.array([3, 5, 7, 11]), np.array([40, 30, 20, 10])
    plan = packing.whole_patterns(sizes, demand, 16)
    used = np.zeros(4, int)
    for times, content in plan:
        assert sum(sizes[i] * n for i, n in content.items()) <= 16
        for i, n in content.items():
            used[i] += times * n
    assert used.tolist() == demand.tolist()
    assert sum(t for t, _ in plan) <= -(-int(sizes @ demand) // 16) + 2


def test_chunking(docs, none):
    out = chunking.edited_neighbours(docs)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == EVERY
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {""}
    assert chunking.edited_neighbours(none).count() == 0
    assert out.count() == len(rows) and chunking.edited_neighbours(docs.filter("doc_id = 4")).head()["near_next"] == 1.0


def test_chunks_resist_shifts():
    a = LONG.encode()
    x, y = chunking.chunk_entries([a, a[:5000] + b"an insertion" + a[5000:]])
    assert chunking.likeness(x, y) > 0.98


def test_segments(spark, monkeypatch):
    """Segments give the neighbours that one walk over all documents gives."""
    rows = [(i * 3 % 401 - 50, prose(i, 5 + i % 20)) for i in range(401)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in chunking.edited_neighbours(df).collect()}
    monkeypatch.setattr(chunking, "SEGMENT_ROWS", 20)
    assert {tuple(r) for r in chunking.edited_neighbours(df).collect()} == whole


def test_segments_of_one_id(spark, monkeypatch):
    """Many texts under one id, or under none, are dealt to segments too."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(i, 5 + i % 20)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(tuple(r) for r in chunking.edited_neighbours(df).collect())
    monkeypatch.setattr(chunking, "SEGMENT_ROWS", 20)
    parts = chunking.edited_neighbours(df)
    assert Counter(tuple(r) for r in parts.collect()) == whole
    cuts = np.array([5, 7, 7, 7, 9])
    of = chunking._segments(cuts)
    import pandas as pd

    ids, marks = np.repeat([1, 5, 6, 7, 8, 9, 10], 50), np.sort(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (7, 50)), axis=1).ravel()
    found = of(pd.Series(ids), pd.Series(marks)).to_numpy()
    assert (np.diff(found) >= 0).all() and len(set(found[ids == 7])) == 3


def chunks_by_hand(raw):
    """Boundaries byte by byte: the gear hash of the last 16 bytes, seldom small enough before the normal size, often beyond it."""
    out, start = [], 0
    while start < len(raw):
        cut = min(start + chunking.MOST, len(raw))
        for end in range(start + chunking.LEAST, cut + 1):
            h = 0
            for b in raw[max(0, end - 16) : end]:
                h = (h * 2 + int(chunking.GEAR[b])) % 2**32
            z = h * 0x9E3779B1 % 2**32 >> 16
            # a boundary at the normal size itself counts as beyond it
            if z < (chunking.STRICT if end - 1 < start + chunking.NORMAL else chunking.LOOSE):
                cut = end
                break
        out.append(raw[start:cut])
        start = cut
    return out


def test_fingerprints_by_hand(spark):
    import xxhash

    texts = [LONG[:7000], "a" * 900, "é" * 300, "short", "", "".join(chr(33 + i * i % 90) for i in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    entries = lambda t: sorted({xxhash.xxh3_64_intdigest(c) >> 16 << 16 | len(c) for c in chunks_by_hand(t.encode())})

    def alike(a, b):
        size = lambda e: sum(x & 0xFFFF for x in e)
        return size(set(a) & set(b)) / min(size(a), size(b)) if a and b else float(len(a) == len(b))

    for r in chunking.edited_neighbours(df).collect():
        own, following = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        edited = chunking.edit(own, following)
        assert r["fingerprint"] == "".join(f"{e:016x}" for e in entries(own))
        assert r["edited_fingerprint"] == "".join(f"{e:016x}" for e in entries(edited))
        assert r["near_edited"] == pytest.approx(alike(entries(own), entries(edited)))
        assert r["near_next"] == pytest.approx(alike(entries(own), entries(following)))


def test_quality(docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == EVERY
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)} - {r["score"] for r in rows if r["doc_id"] == 5}) <= 1
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.score(docs, quality.train(docs, labels).__class__(0.0, 1, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))).columns
    assert kept == [*(c for c in docs.columns if c != "quality_score"), "quality_score"]  # a clashing column of the input is replaced


def test_trees_node_by_node():
    """Flattened trees against a walk from node to node, and the first tree's leaves against Newton steps."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    y = (x[:, 1] + x[:, 4] ** 2 > 0.7).astype(float)
    trees = quality.grow(x, y, trees=7, depth=3)
    for row, got in zip(x, trees.score(x), strict=True):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.9
    first = quality.grow(x, y, trees=1, depth=1, rate=1.0)
    f, at = first.feature[0][0], first.threshold[0][0]
    for side, value in zip((x[:, f] <= at, x[:, f] > at), first.value[0], strict=True):
        p = y.mean()
        assert value == pytest.approx((y[side] - p).sum() / (side.sum() * p * (1 - p) + 1.0))


def test_repeated_ids_count_once_in_training(spark):
    rows = [(k % 40, prose(k, 20) if k % 2 else "!!! $$$ " * (k % 7 + 1)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None)], "doc_id long, quality int")
    one, other = (quality.train(d, labels) for d in (df, df.repartition(7)))
    assert np.array_equal(one.feature, other.feature) and np.array_equal(one.value, other.value)
    least = df.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.text")
    assert np.array_equal(quality.train(least, labels).value, one.value)


def test_mixing(docs, none, monkeypatch):
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == EVERY
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, ((r["doc_id"] or 0, r["size"], r["taken"], r["position"] or 0.0) for r in mixing.mix(docs.repartition(5)).collect()))) == sorted((r["doc_id"] or 0, r["size"], r["taken"], r["position"] or 0.0) for r in rows)
    assert mixing.mix(none).count() == 0
    assert mixing.curriculum(docs).columns == docs.columns
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_LISTED", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == few
    monkeypatch.undo()
    tied = docs.sparkSession.createDataFrame([(1, f"{a} two three", "s") for a in "abcdef"] + [(1, "a two three", "s"), (2, "x y", "t"), (None, "p q", "t"), (None, "r s", "t")], "doc_id long, text string, source string")
    passes = [Counter(tuple(r) for r in mixing.curriculum(tied.repartition(n), slopes=(0.5, -0.5)).collect()) for n in (1, 3, 5)]
    assert passes[0] == passes[1] == passes[2] and sum(passes[0].values()) > 0
    assert mixing.share_out([10, 100, 50], [3, 1, 2], 240, 2) == [20.0, pytest.approx(120.0), 100.0]


def shingle_sets(rows, n=5):
    out = []
    for doc_id, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        out.append((doc_id, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()))
    return out


def groups(sets, percent=75):
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("block", [4, 1500])
def test_shingle_join(spark, block):
    """Families of edited copies, in small and large blocks, against all pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for family in range(6):
        base = prose(family, 80).split()
        for copy in range(12):
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = f"w{rng.integers(1000)}"
            rows.append((len(rows) * 7 % 72, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A B"), (104, LONG)]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, size string").repartition(5)
    assert {tuple(r) for r in shingle_join.ngram_groups(df, block=block).collect()} == groups(shingle_sets(rows))


def test_shingle_join_edges(docs, none):
    assert ids(shingle_join.ngram_groups(docs)) == EVERY
    assert shingle_join.ngram_groups(none).count() == 0
    known = [(d, t) for d, t in ((r[0], r[1]) for r in nasty()) if d is not None]
    found = shingle_join.ngram_groups(docs).collect()
    assert {tuple(r) for r in found if r["doc_id"] is not None} == groups(shingle_sets(known))
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}


def test_repeated_ids_keep_their_links(spark):
    """Rows of one id whose texts have sets of equal size: each has a near copy of its own."""
    a, b = prose(1, 120), prose(2, 120)
    rows = [(5, a), (5, b), (4, a + " tail"), (6, b + " tail"), (7, prose(3, 120)), (7, prose(3, 120)), (8, prose(3, 120) + " end"), (8, prose(9, 50))]
    sizes = {len(s) for _, s in shingle_sets(rows[:2])}
    assert len(sizes) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = shingle_join.ngram_members(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == Counter([(5, 116, 4), (5, 116, 5), (4, 117, 4), (6, 117, 5), (7, 116, 7), (7, 116, 7), (8, 117, 7), (8, 46, 8)])
    assert Counter(r["doc_id"] for r in out if r["kept"]) == Counter([4, 5, 7, 7, 8])


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Joins and components give the same where hubs, lists and labels are split to parts."""
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    test_components(spark)
    hub = [(0, i) for i in range(1, 40)] + [(40, i) for i in range(41, 60)] + [(39, 41)]
    assert {r["component"] for r in components(spark.createDataFrame(hub, "a long, b long")).collect()} == {0}
    test_shingle_join(spark, 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaaaabbc")], "k string, i long")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("v")).filter("k <> 'c'")
    assert Counter(map(tuple, common.lookup(rows, values, ["k"], "n").collect())) == Counter([("a", i, 0) for i in range(8)] + [("b", 8, 8), ("b", 9, 8)])
    assert common.lookup(rows, values, ["k"], "n", "left").filter("v is null").count() == 1


def test_merge_skip():
    rng = np.random.default_rng(8)
    for least in (1, 2, 5, 9):
        lists = [np.unique(rng.integers(0, 50, rng.integers(0, 40))).tolist() for _ in range(12)]
        count = Counter(v for x in lists for v in x)
        wanted = sorted((v, n) for v, n in count.items() if n >= least)
        assert list(zip(*shingle_join.merge_skip(lists, least), strict=True)) == wanted


def test_t_occurrence():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)) for _ in range(40)]
    index = shingle_join._index(sets)
    for q in sets:
        wanted = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert sorted(shingle_join.t_occurrence(q, *index, 60).tolist()) == wanted


def brute_repeats(rows, n):
    raws = [(t or "").encode() for _, t in rows]
    starts = Counter(b[i : i + n] for b in raws for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, raws, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if starts[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((d, len(b), sum(gone), bytes(v for v, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("many", [1000, 3])
def test_suffix(spark, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 20_000)
    passage, rng = prose(7, 60), np.random.default_rng(2)
    rows = [(i, prose(1000 + i, 30) + " " + passage[int(rng.integers(40)) : len(passage) - int(rng.integers(40))] + prose(2000 + i, 30)) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "ab" * 700), (53, "é" * 500), (54, passage), (54, passage), (None, passage), (None, None), (55, prose(5, 9)), (56, "z" * 399)]
    df = spark.createDataFrame([(d, t, "q", "q") for d, t in rows], "doc_id long, text string, h string, start string").repartition(4)
    out = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(df).collect())
    assert out == brute_repeats(rows, 400)


def test_periodic_text(spark):
    """A run of equal regions is one row, and the whole text goes."""
    rows = [(1, "ab" * 500_000), (2, "xyz" * 100_000 + prose(1, 20)), (3, prose(2, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix._anchored(suffix._keyed(df, "text", "doc_id"), 400).count() < 1000
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_chars"]) for r in suffix.remove_repeats(df).collect()}
    assert out[1] == (1_000_000, 1, 0) and out[3] == (0, 0, len(rows[2][1]))
    assert 0 <= out[2][0] - 300_000 <= 3 and out[2][1] == 1


def test_suffix_array():
    rng = np.random.default_rng(4)
    for kinds, n in ((2, 300), (3, 1000), (200, 1000), (1, 50)):
        t = rng.integers(0, kinds, n)
        text = bytes(t.astype(np.uint8))
        assert suffix.suffix_array(t, kinds).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_symbols_are_ordered_stably():
    """Also where there are more kinds than 16 bits hold."""
    for kinds in (257, 1 << 16, 1 << 17):
        c = np.random.default_rng(kinds).integers(max(0, kinds - 40), kinds, 500)
        assert suffix._by_symbol(c, kinds).tolist() == sorted(range(500), key=lambda i: (c[i], i))


def test_suffix_edges(docs, none):
    assert ids(suffix.remove_repeats(docs)) == EVERY
    assert suffix.remove_repeats(none).count() == 0


def test_histogram(docs, none):
    hist = histogram.length_histogram(docs)
    lengths = np.array([len(x) for x in encode([r[1] for r in nasty()], default_path())])
    rows = hist.collect()
    assert sum(r["n_docs"] for r in rows) == len(lengths) and sum(r["n_tokens"] for r in rows) == lengths.sum()
    for r in histogram.at_limits(hist, [0, 5, 1000, 10**6]).collect():
        assert r["truncated_tokens"] == np.minimum(lengths, r["context_limit"]).sum()
        assert r["docs_cut"] == (lengths > r["context_limit"]).sum()
    assert histogram.at_limits(hist, []).count() == 0 == histogram.quantiles(hist, []).count()
    found = {r["prob"]: r["length"] for r in histogram.quantiles(hist, [0.5, 1.0]).collect()}
    assert found == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: lengths.max()}
    assert histogram.length_histogram(none).count() == 0


def test_fast_tokens():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_path())
    texts = [r[1] for r in nasty()] + ["  two  spaces\n\n\tand don't we'LL 12345 it's\r\n", "a" * 999, "naïve café ü", " ", "…“quoted”"]
    for t, got in zip(texts, encode(texts, default_path()), strict=True):
        assert got.tolist() == exact.encode(t or "", add_special_tokens=False).ids


def test_lines(spark, docs, none):
    out = line_align.remove_aligned(docs.drop("lines_total"))
    assert ids(out) == EVERY
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[6] in ("", "another text under a known id") and texts[5] == COPY and texts[1] is None
    assert line_align.remove_aligned(none.drop("lines_total")).count() == 0
    shared = "\n".join(f"a shared line of some length, number {k}" for k in range(3))
    df = spark.createDataFrame([(1, f"first\n{shared}\nend"), (2, f"second\n{shared}\nmore"), (3, "third\n\nshort")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_align.remove_aligned(df).collect()} == {1: f"first\n{shared}\nend", 2: "second\nmore", 3: "third\n\nshort"}


@pytest.mark.parametrize("holders", [99, 101, 500])
def test_passage_in_many_documents(spark, holders, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT", 40)
    passage = "one passage that more than a hundred documents have"
    own = lambda d: [f"line {k} that only document {d} has" for k in range(6)]
    df = spark.createDataFrame([(d, "\n".join([*own(d)[:3], passage, *own(d)[3:]])) for d in range(holders)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in line_align.remove_aligned(df).collect()}
    assert texts == {d: "\n".join([*own(d)[:3], *([] if d else [passage]), *own(d)[3:]]) for d in range(holders)}


def test_clashing_names_of_lines(docs):
    out = line_align.remove_aligned(docs)
    assert sorted(out.columns) == sorted({*docs.columns, "lines_total", "lines_removed", "aligned_with"})
    assert {r["lines_total"] for r in out.collect()} >= {0, 1, 1200}


def test_partners_by_definition(spark):
    from test_contracts import aligned

    x, y = "a first passage that has more than fifty characters in it", "another passage that has more than fifty characters too"
    rows = [(1, [x, "p", y]), (2, ["q", x, "r"]), (3, ["s", y, "t", x, "u"]), (4, ["v", x, "w", x]), (5, ["k", "l"]), (6, ["k", "m"]), (7, ["n", "l"]), (8, ["k", "l"]), (9, ["n", "l"])]
    rng = random.Random(3)
    pool = [f"{'line ' * rng.choice([1, 3, 6, 11])}{k}" for k in range(40)] + ["", "  "]
    rows += [(d, [rng.choice(pool) for _ in range(rng.randint(1, 14))]) for d in range(10, 150)]
    wanted = {d: (n, p, text) for d, (text, n, p) in aligned([{"doc_id": d, "text": "\n".join(own)} for d, own in rows]).items()}
    df = spark.createDataFrame([(d, "\n".join(own)) for d, own in rows], "doc_id long, text string")
    assert {r["doc_id"]: (r["lines_removed"], r["aligned_with"], r["text"]) for r in line_align.remove_aligned(df).collect()} == wanted
    assert [wanted[d][0] for d in (3, 8, 9)] == [2, 2, 2]


@pytest.mark.parametrize("documents", [100, 400])
def test_a_common_line_makes_linear_pairs(spark, documents):
    """A divider of 76 characters, twice in every document, pairs each with the first document only."""
    text = lambda d: "\n".join([f"opening of {d}", "-" * 76, f"middle of {d}", "-" * 76, f"end of {d}"])
    df = spark.createDataFrame([(d, text(d)) for d in range(documents)], "doc_id long, text string")
    base = df.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_x"), F.split("text", "\n").alias("_l"))
    hashed = base.select("_id", "_x", F.transform("_l", lambda x: F.xxhash64(x)).alias("_h"), F.transform("_l", lambda x: F.length(x)).alias("_n"), F.transform("_l", lambda x: F.length(x) > 0).alias("_full"))
    assert line_align._pairs(hashed, "long", 50).rows.count() == documents - 1


def test_nul_before_a_repeated_passage():
    passage = bytes(np.random.default_rng(5).integers(97, 123, 1000, np.uint8))
    for regions in ([b"zz", passage, b"abc\0" + passage], [b"zz", b"abc\0" + passage, passage]):
        found = dict(zip(regions, suffix.repeated_starts(regions, 400), strict=True))
        assert found[passage].tolist() == list(range(601))
        assert found[b"abc\0" + passage].tolist() == list(range(4, 605))


def test_patience():
    assert line_align.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_align.patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]
    assert line_align.patience([], [1]) == []


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, docs, none, labels, tmp_path, empty):
    given = none if empty else docs
    labels.filter("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")  # nothing is rejected
    given.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == list(P.COLUMNS), name
        rows = ids(out)
        assert not rows if empty else rows and set(rows) <= set(EVERY), name
        if name == "quality_filter" and not empty:
            assert rows == EVERY
        if name in ("line_dedup", "near_dedup") and not empty:
            assert rows[None] == 2 and rows[4] == rows[8] == rows[9] == 1 and rows[5] + rows[6] < 4
    result = P.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(result.columns)
    assert (result.count() == 0) == empty


def test_one_of_each_group_stays(spark, tmp_path):
    rows = [(1, COPY), (2, COPY + " end"), (3, prose(5, 90)), (3, prose(5, 90)), (None, "alone"), (4, None)]
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(P.near_dedup(spark, df, str(tmp_path))) == Counter([1, 3, None, 4])
    assert df.select(F.lit(1)).count() == 6


def chain(n, rng, size=240):
    """Sets of which neighbours share most and far ones less: the first links with few, each with some."""
    steps = np.concatenate([[0], np.cumsum(rng.integers(1, 4, n - 1))])
    return [np.sort(np.concatenate([np.arange(size // 2), size + s % 300 + np.arange(size // 2)])) * 1_000_003 for s in steps]


def test_large_groups_are_searched_once(monkeypatch):
    """A set is searched in the other blocks of its group only when the links of all blocks leave it apart."""
    rng = np.random.default_rng(5)
    sets = chain(60, rng)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    own = np.arange(60) % 2 == 0
    label = np.where(np.arange(60) % 10 == 3, np.arange(60), 1000)  # six sets are apart, three at most of them linked by another
    asked = []
    partners = shingle_join._partners
    monkeypatch.setattr(shingle_join, "_partners", lambda q, *rest: asked.append(1) or partners(q, *rest))
    assert shingle_join._bridges(sets, own, np.full(60, 7), 75) == [] and not asked
    links = shingle_join._bridges(sets, own, label, 75)
    assert len(asked) == 30 - 24
    assert links and all(near(sets[k], sets[m]) and label[k] != label[m] and own[m] and not own[k] for k, m in links)
    linked = {k for k in np.flatnonzero(~own).tolist() if label[k] != 1000 and any(near(sets[k], sets[m]) for m in np.flatnonzero(own).tolist())}
    assert {k for k, _ in links} == linked and len(links) == len(linked)


def test_near_copies_apart_from_the_first():
    """700 near copies of which the first links with none, each with some: a search for each of them (28 s before)."""
    import time

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 400)
    sets = [np.unique(np.concatenate([base[rng.random(400) > rng.uniform(0.05, 0.3)], rng.integers(0, 1 << 60, 20)])) for _ in range(700)]
    sets[0] = np.unique(np.concatenate([base[:280], rng.integers(0, 1 << 60, 90)]))
    began = time.perf_counter()
    links, apart = shingle_join._spanning(sets, 75)
    assert time.perf_counter() - began < 5
    assert len(apart) == 699
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    assert all(near(sets[a], sets[b]) for a, b in links)
    roots = sorted(set(range(700)) - {m for _, m in links})
    assert len(links) > 100 and not any(near(sets[a], sets[b]) for a in roots[:10] for b in roots if a != b)


def test_blocks_of_one_group_are_bridged(spark):
    """Chains of near copies in blocks of a few sets: what only links between blocks connect is one group."""
    rows = []
    for family in range(3):
        words = prose(family + 20, 160).split()
        for copy in range(14):
            rows.append((len(rows) * 5 % 42, " ".join(words[copy * 3 : copy * 3 + 110])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = groups(shingle_sets(rows))
    assert len({g for _, _, g in wanted}) < 42
    assert {tuple(r) for r in shingle_join.ngram_groups(df, block=2).collect()} == wanted


def test_run_hashes():
    """Runs of any length hash as their own bytes, wherever they are; those that differ in a byte or in length differ."""
    from tessera.llm.kernels import distinct, hash_runs

    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in (*range(1, 40), 700, 5000)]
    words += [w[:-1] + bytes([w[-1] ^ 1]) for w in words] + [b"\x00" * n for n in range(1, 20)] + [b"a" * 8 + b"b" * 8, b"b" * 8 + b"a" * 8]
    kinds = {}
    for order in (words, words[::-1]):
        raw = np.frombuffer(b" ".join(order), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in order]) - 1
        for w, h in zip(order, hash_runs(raw, ends - [len(w) for w in order], ends).tolist(), strict=True):
            assert kinds.setdefault(w, h) == h
    assert len(set(kinds.values())) == len(set(words))
    h, doc = rng.integers(0, 50, 400).astype(np.uint64), rng.permutation(np.repeat(np.arange(9), [0, 90, 10, 0, 100, 1, 99, 100, 0]))
    for d in (doc, np.sort(doc)):
        a, b = distinct(h, d)
        assert list(zip(b.tolist(), a.tolist(), strict=True)) == sorted(set(zip(d.tolist(), h.tolist(), strict=True)))
