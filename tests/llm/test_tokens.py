"""Speculative BPE, tokenizer alignment and the Merkle manifest: brute force, properties and nasty rows."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, merkle, queries, token_alignment
from tessera.llm.tokens import default_path
from test_edges import EVERY, docs, none  # noqa: F401

Q = queries.queries()
NASTY_TEXTS = ["", " ", "  \n\n x  ", "a<|endoftext|> b <|endoftext|>", "<|endoftext|>", "it's we'll I'D", "\x00x", "x y  z", "a▁b c", "日本語 😀é", "z" * 3000 + " " * 500, "\t\r\n mixed \n\nlines\n", "naïve–dash “q” 12³ ½", "﻿a", "<0x41> <s> <unk>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def drawn(seed, n):
    """Texts of single characters, of the vocabulary's tokens, of runs and of characters of any script."""
    rng, v = random.Random(seed), bpe.vocabulary(default_path())
    pool = [b.decode("utf8", "replace") for b in v.bytes]
    kinds = (
        lambda: "".join(rng.choice("abetsnio ") for _ in range(rng.randint(1, 40))),
        lambda: "".join(rng.choice(pool) for _ in range(rng.randint(1, 6))),
        lambda: rng.choice("ab \n-=*0") * rng.randint(1, 300),
        lambda: "".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(0x300, 0x3000), rng.randint(0x4E00, 0x9000), rng.randint(0x1F300, 0x1F600)])) for _ in range(rng.randint(1, 15))),
    )
    return [rng.choice(kinds)() for _ in range(n)]


def test_speculation_is_exact(library):
    texts = [*drawn(1, 4000), *NASTY_TEXTS, None]
    for text, got in zip(texts, bpe.Encoder(default_path()).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), text


def test_compatible_pairs(library):
    """A pair stands exactly if exact merging of its bytes gives the pair; words with a failing pair are merged."""
    v, rng = bpe.vocabulary(default_path()), np.random.default_rng(2)
    x, y = rng.integers(0, 50000, 6000), rng.integers(0, 50000, 6000)
    x[:3000], y[:3000] = rng.integers(0, 400, 3000), rng.integers(0, 400, 3000)
    for a, b, fine in zip(x.tolist(), y.tolist(), v.compatible(x, y).tolist(), strict=True):
        assert fine == (v.merged(v.bytes[a] + v.bytes[b]) == [a, b])
    words = ["the", "q" * 200, *("".join(random.Random(k).choices("abcehinorst", k=k % 14 + 1)) for k in range(400))]
    coded, wrong = v.words(words)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [v.merged(w.encode()) for w in words] and 0 < wrong < 400
    short = [v.merged(w) for w in (b"abcabc" * 6, b"the cat")]
    assert short == [ids_of(library, "abcabc" * 6), v.merged(b"the cat")]


def test_words_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    e, texts = bpe.Encoder(default_path()), drawn(7, 300)
    for i in range(0, 300, 30):
        for t, got in zip(texts[i : i + 30], e.encode(texts[i : i + 30]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(library, t)
    assert len(e.known) <= 400


def test_op11(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q["op11_speculative_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark, docs, none, library):  # noqa: F811
    coded = bpe.encode_documents(docs.withColumn("ids", F.lit("clash")))
    assert sorted(coded.columns) == sorted({*docs.columns, "ids"} - {"text"})
    back = bpe.decode_documents(coded)
    assert sorted(back.columns) == sorted(docs.columns)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert bpe.round_trip(none).count() == 0
    broken = spark.createDataFrame([(np.array([255, 50256, 200], "<u4").tobytes(),), (None,)], "ids binary")
    assert [r[0] for r in bpe.decode_documents(broken).collect()] == [library.decode([255, 50256, 200], skip_special_tokens=False), ""]
    with pytest.raises(ValueError):
        bpe.Vocabulary(default_path().replace("byte_bpe_50k", "word_bpe_49k"))


def alignments(texts):
    """Brute force over whole texts: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each."""
    first, (second, b_bytes, _), a_bytes = token_alignment._byte_level(default_path()), token_alignment._pieces(token_alignment.default_pieces()), bpe.vocabulary(default_path()).bytes
    found, counts = [], Counter()
    for t in texts:
        a, b = (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        if t and not b"".join(a_bytes[i] for i in a) == (" " + t).encode() == b"".join(b_bytes[i] for i in b):
            a, b = [], []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(table[i]) for i in ids], dtype=int)
            spans.append([(i, int(e) - len(table[i]), int(e)) for i, e in zip(ids, ends, strict=True)])
        links = [(i, j) for i, s, e in spans[0] for j, p, q in spans[1] if s < q and p < e] if len(a) < 3000 else merged_links(*spans)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        side = lambda k, lo, hi: ",".join(str(i) for i, _, e in spans[k] if lo < e <= hi)  # noqa: B023, E731
        groups = ";".join(f"{side(0, lo, hi)}|{side(1, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, c, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), g) for a, b, c, links, g in found]


def merged_links(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment(spark):
    texts = [*(t.replace("\x00", "") for t in drawn(3, 200)), *NASTY_TEXTS, *NASTY_TEXTS[:4], "bad ▁ one and good words", "good words and good words", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align_documents(df).collect()}
    for k, wanted in enumerate(alignments(texts)):
        assert rows[k] == wanted, texts[k]


def test_alignment_of_joined_counts(spark, monkeypatch):
    """Counts that are joined by their key instead of being broadcast, many parts, and texts of one long group."""
    monkeypatch.setattr(token_alignment, "LISTED_PAIRS", 0)
    monkeypatch.setattr(token_alignment, "PART_BYTES", 300)
    texts = ["abab" * 200, "aaa" * 400, *(" ".join(random.Random(k).choices("wave tide moon shore gull 123".split(), k=30)) for k in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align_documents(df).collect()}
    assert [rows[k] for k in range(len(texts))] == alignments(texts)


def test_alignment_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Figures travel as one text; when texts meet them only the parts' figures are still on disk."""
    texts = ["one two three", "two \u00e9t\u00e9 two", "x" * 3000, "three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders = []
    save = token_alignment.stored
    monkeypatch.setattr(token_alignment, "stored", lambda rows, name: folders.append(save(rows, name)) or folders[-1])
    out = token_alignment.align_documents(df)
    left = [t for t in folders if os.path.exists(t.path)]
    assert [t.path.rsplit("/", 1)[-1][:12] for t in left if "token-pairs" not in t.path] == ["part-figures"]
    assert set(left[-1].rows.columns) == {"part", "seg", "packed"}
    assert [tuple(r[c] for c in COLUMNS) for r in out.orderBy("doc_id").collect()] == alignments(texts)
    *numbers, groups = token_alignment.unpacked(pa.array(["1 22 3 4 5 67890123456 1|2;3,4|5", "0 0 0 0 0 0 "]))
    assert [x.to_pylist() for x in numbers] == [["1", "0"], ["22", "0"], ["3", "0"], ["4", "0"], ["5", "0"], ["67890123456", "0"]] and groups.to_pylist() == ["1|2;3,4|5", ""]


def test_alignment_gathers_by_numbers(spark, monkeypatch):
    """Segments are numbers where documents gather them: another seed is taken when two are equal, and a part holds no texts of segments."""
    import tracemalloc

    texts = [*drawn(5, 40), "bad \u2581 one and good words", "good words and good words"]
    texts = [t.replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed, seeds = token_alignment.key, []
    monkeypatch.setattr(token_alignment, "key", lambda seg, seed: seeds.append(seed) or (hashed(seg, seed) % 7 if seed < 2 else hashed(seg, seed)))
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align_documents(df).collect()}
    assert [rows[k] for k in range(len(texts))] == alignments(texts) and set(seeds) == {0, 1, 2}
    n = 200_000
    keys = np.sort(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, n))
    names = ["part", "_k", "seg", "packed", "doc_id", "segs"]
    part = lambda size, k: [pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, k, np.int32))]
    figures = [pa.RecordBatch.from_arrays([*part(10_000, 0), pa.array(keys[i : i + 10_000]), pa.array([f"1 1 1 1 1 {k} {k}|7" for k in range(i, i + 10_000)]), pa.nulls(10_000, pa.int64()), pa.nulls(10_000, pa.list_(pa.int64()))], names) for i in range(0, n, 10_000)]
    asked = pa.RecordBatch.from_arrays([*part(2, 1), pa.nulls(2, pa.int64()), pa.nulls(2, pa.string()), pa.array([4, None], pa.int64()), pa.array([[int(keys[5]), int(keys[-1]), int(keys[5])], [int(keys[0])]])], names)
    tracemalloc.start()
    out = pa.Table.from_batches(token_alignment.gather(iter([*figures, asked])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("count_sum").to_pylist() == [n + 9, 0] and out.column("groups").to_pylist() == ["5|7;199999|7;5|7", "0|7"] and out.column("n_a").to_pylist() == [3, 1]
    assert peak < 150 * n  # a dictionary of texts takes more than that alone
    with pytest.raises(KeyError):
        list(token_alignment.gather(iter([figures[0], asked])))


def test_alignment_in_blocks(spark, monkeypatch):
    """Figures travel as compressed blocks, documents reach the gathering task in pieces that go on over its batches."""
    monkeypatch.setattr(token_alignment, "BLOCK", 7)
    monkeypatch.setattr(token_alignment, "PIECE", 3)
    texts = [*(" ".join(random.Random(k).choices([f"tide{i}" for i in range(90)], k=1 + 13 * (k % 4))) for k in range(40)), "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders = []
    save = token_alignment.stored
    monkeypatch.setattr(token_alignment, "stored", lambda rows, name: folders.append(save(rows, name)) or folders[-1])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "2")
        rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.align_documents(df).collect()}
    finally:
        spark.conf.set(batch, given)
    assert [rows[k] for k in range(len(texts))] == alignments(texts)
    sizes = [len(r["seg"]) for r in folders[-1].rows.collect()]
    assert max(sizes) == 7 and 3 * len(sizes) < sum(sizes)
    before = pa.total_allocated_bytes()
    names = ["part", "_k", "seg", "packed", "doc_id", "segs"]
    part = lambda at, k, n, *columns: pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int32)) for x in (at, k)] + list(columns), names)
    wide = 100_000

    def parts():
        """Two parts with a text of figures each; when the second begins, what was held of the first is gone."""
        for at in range(2):
            yield part(at, 0, 1, pa.array([at]), pa.array([f"1 1 1 1 1 1 {'7' * wide}"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())))
            if at:
                assert pa.total_allocated_bytes() - before < 4 * wide
            yield part(at, 1, 1, pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([at]), pa.array([[at]]))

    assert [len(b.column("groups")[0].as_py()) for b in token_alignment.returned(token_alignment.gather(parts()))] == [wide, wide]


def test_op12(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    given = [r for r in given if not r["text"] or len(r["text"]) < 200_000]
    rows = {r["doc_id"]: r for r in Q["op12_token_alignment"](spark, sf_dir).collect()}
    for r, wanted in zip(given, alignments([r["text"] for r in given]), strict=True):
        got = rows[r["doc_id"]]
        assert tuple(got[c] for c in COLUMNS[:-1]) == wanted[:-1]
        assert got["groups_sha256"] == (hashlib.sha256(wanted[-1].encode()).hexdigest() if wanted[0] else "")


def test_alignment_edges(spark, docs, none):  # noqa: F811
    out = token_alignment.align_documents(docs).collect()
    assert Counter(r["doc_id"] for r in out) == EVERY
    assert {r["n_a"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert token_alignment.align_documents(none).count() == 0
    assert token_alignment.align_documents(docs.filter("text is null or text = ''")).count() == 3


def trees(rows, arity=2):
    """Brute force of a manifest: (leaf, subroot, root, siblings by level) of each row (doc_id, source, lang, n_chars, text)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def grow(nodes):
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            runs = [level[i : i + arity] for i in range(0, len(level), arity)]
            for k, p in enumerate(at):
                run, own = runs[p // arity], p % arity
                paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at, level = [p // arity for p in at], [h(*r) for r in runs]
        return level[0], paths

    by = {}
    for k, r in enumerate(rows):
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), k))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    grown = {g: grow([x[2] for x in sorted(by[g])]) for g in names}
    root, tops = grow([grown[g][0] for g in names])
    out = [None] * len(rows)
    for g, top in zip(names, tops, strict=True):
        for x, path in zip(sorted(by[g]), grown[g][1], strict=True):
            out[x[3]] = (x[2], grown[g][0], root, path + top)
    return out


def rows_of(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(tuple(x) for x in r["path"])) for r in df.collect())


@pytest.mark.parametrize(("arity", "block", "languages"), [(2, 256, 3), (2, 4, 1), (3, 9, 7), (5, 25, 40)])
def test_manifest(spark, monkeypatch, arity, block, languages):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(arity)
    rows = [(k if k % 9 else None, rng.choice(["a", None]), rng.choice([None, *map(str, range(languages))]), rng.choice([None, k]), rng.choice([None, "", "é" * k])) for k in range(150)]
    rows += [rows[5], rows[5], (3, "again", "0", 1, "x"), (7, None, "lone", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    out = merkle.document_manifest(df, arity=arity)
    assert rows_of(out) == Counter((r[0], *t[:3], tuple(t[3])) for r, t in zip(rows, trees(rows, arity), strict=True))
    folded = out.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("f"), merkle.fold(F.sha2(F.lit("x"), 256), F.col("path")).alias("wrong")).collect()
    assert all(r["f"] == r["root"] != r["wrong"] for r in folded)


def test_manifest_edges(spark, docs, none):  # noqa: F811
    extra = docs.withColumnsRenamed({"size": "g", "slot": "place", "h": "digest", "id": "key", "x": "leaf", "start": "path"})
    given = [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]
    assert rows_of(merkle.document_manifest(extra)) == Counter((r[0], *t[:3], tuple(t[3])) for r, t in zip(given, trees(given), strict=True))
    assert merkle.document_manifest(none).count() == 0


def test_op13_tampering(spark, sf_dir):
    rows = Q["op13_merkle_manifest"](spark, sf_dir).collect()
    told = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
    assert {r["doc_id"] for r in rows if not r["verified"]} == told and told
    assert len({r["root"] for r in rows}) == 1


def test_templates_are_no_work():
    """Sets that share a template of 80 of 100 shingles need no search: no partner of their size can be reached."""
    import time

    from tessera.llm import shingle_join

    rng = np.random.default_rng(4)
    sets = [np.sort(np.concatenate([np.arange(80), rng.integers(1000, 1 << 60, 20)])) for _ in range(1500)]
    began = time.perf_counter()
    links, apart = shingle_join._spanning(sets, 75)
    assert not links and len(apart) == 1499 and time.perf_counter() - began < 3
    mixed = [np.sort(rng.choice(160, int(n), replace=False)) for n in rng.integers(20, 150, 300)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    wanted = {(i, j) for i in range(300) for j in range(i) if near(mixed[i], mixed[j])}
    found = {(max(i, m), min(i, m)) for i in range(300) for m in shingle_join._partners(mixed[i], shingle_join._bands(mixed, np.arange(300)), 75) if m != i}
    assert found == wanted and wanted


def plain_statistics(text):
    """The classifier's statistics of one text, one by one."""
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    split = lambda data, marks: [w for w in bytes(32 if b in marks else b for b in data).split(b" ") if w]
    words, own = split(low, b" \t\n\x0b\x0c\r"), split(raw, b" \t\n\x0b\x0c\r")
    lines = [x for x in low.split(b"\n") if x]
    n, some, at_least = len(words), max(len(raw), 1), max(len(words), 1)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    sign = lambda b: not letter(b) and not 48 <= b <= 57
    sizes = [len(w) for w in words]
    mean = sum(sizes) / at_least
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)] or ([tuple(words)] if words else [])
    shout = [sum(65 <= b <= 90 for b in w) for w in own]
    signs = [sum(map(sign, w)) for w in own]
    share = lambda marks: sum(marks) / at_least
    count = lambda keep: sum(map(keep, raw)) / some
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), mean,
        max(sum(s * s for s in sizes) / at_least - mean * mean, 0) ** 0.5,
        len(raw) / max(len(lines), 1), n / max(len(lines), 1),
        count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57),
        count(lambda b: b >= 128), count(lambda b: b in b" \t\n\x0b\x0c\r"), count(lambda b: b == 10),
        len(set(words)) / at_least, len(set(triples)) / max(len(triples), 1), len(set(lines)) / max(len(lines), 1),
        share(s <= 3 for s in sizes), share(s >= 12 for s in sizes), share(u >= max(s - 2, 1) for u, s in zip(shout, sizes, strict=True)),
        share(k >= 2 for k in signs), share(k == s for k, s in zip(signs, sizes, strict=True)),
        share(65 <= w[0] <= 90 for w in own), share(not letter(w[-1]) for w in own), 0.0,
        sum(b in b".!?" for b in raw) / at_least, max(Counter(raw).values(), default=0) / some,
        *[raw.count(bytes([c])) / some for c in b".,!?|*$%&#;:-_/()<>{}[]=+@~^\"'\\`"],
    ]


def test_statistics_against_plain_python():
    from tessera.llm import quality

    texts = ["", "   \n\n", "One", "one two", "The QUICK brown fox!! the quick\nbrown fox.\n\nThe quick brown", "été 12,5 % ÉTÉ\t$$$ <b> {x}", "a\x0bb\x0cc\r\nd", "$%& *** ... supercalifragilistic ABC-def", "x" * 500, *drawn(9, 60)]
    coded = [t.encode() for t in texts]
    found = quality.statistics(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    wanted = np.array([plain_statistics(t) for t in texts])
    assert found.shape == wanted.shape and np.allclose(found, wanted)
