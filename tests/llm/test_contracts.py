"""Each operator's query on a whole table, held against SQL or a brute-force version."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.tokens import default_path
from test_edges import groups, shingle_sets

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def lengths(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids, "<u4") for r in docs}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, same_rows):
    same_rows(Q[name], queries.oracle_sql()[name])


def test_op2(spark, sf_dir, docs):
    rows = Q["op2_balanced_shards"](spark, sf_dir).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) == len(by)
    slots = defaultdict(list)
    for d in docs:
        r, raw = by[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    groups = defaultdict(set)
    for d in docs:
        groups[d["text"]].add(by[d["doc_id"]]["shard"])
    least = {t: math.ceil(sum(d["text"] == t for d in docs) / max(sizes)) for t in groups}
    assert sum(len(s) > least[t] for t, s in groups.items()) == 0


def test_op3(spark, sf_dir, docs, lengths):
    rows = Q["op3_cutting_stock_packing"](spark, sf_dir).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(lengths)
    for k, ids in lengths.items():
        ids, at = np.append(ids, np.uint32(1)).astype("<u4"), 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(len(x) + 1 for x in lengths.values())
    assert len(sequences) <= total / 2048 * 1.02 + 2  # padding


def test_op4(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q["op4_content_chunks"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    prints, near_edited = defaultdict(set), []
    for d, n in zip(docs, [*docs[1:], docs[0]], strict=True):
        r, text, following = rows[d["doc_id"]], d["text"] or "", n["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text != following and len(text) > 1000:
            near_edited.append((r["near_edited"], r["near_next"]))
    assert all(len(s) == 1 for s in prints.values())
    assert len({next(iter(s)) for s in prints.values()}) == len(prints)
    a, b = np.array(near_edited).T
    assert np.median(a) > 0.4 and np.median(b) < 0.1


def test_op5(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q["op5_quality_trees"](spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    right = []
    for k, r in rows.items():
        held = zlib.crc32(str(k).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if held and labels.get(k) is not None:
            right.append(r["predicted"] == labels[k])
    assert np.mean(right) >= 0.85


def test_op6_sums(spark, sf_dir):
    df = Q["op6_curriculum_mix"](spark, sf_dir)
    for r in df.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 1
    assert df.filter("taken > 2 * size").count() == 0


def test_op8(spark, sf_dir, docs):
    n, starts = 400, Counter()
    raws = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    for b in raws.values():
        starts.update(hash(b[i : i + n]) for i in range(len(b) - n + 1))
    rows = {r["doc_id"]: r for r in Q["op8_suffix_dedup"](spark, sf_dir).collect()}
    assert len(rows) == len(raws)
    for k, b in raws.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if starts[hash(b[i : i + n])] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        assert (rows[k]["n_bytes"], rows[k]["n_removed"], rows[k]["n_spans"], rows[k]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op9(spark, sf_dir, lengths):
    all_lengths = np.array([len(x) for x in lengths.values()])
    rows = {r["length"]: r for r in Q["op9_token_histogram"](spark, sf_dir).collect()}
    assert set(rows) == set(all_lengths.tolist())
    for n, r in rows.items():
        there = all_lengths[all_lengths >= n]
        below = all_lengths[all_lengths < n]
        assert (r["n_docs"], r["n_tokens"]) == ((all_lengths == n).sum(), n * (all_lengths == n).sum())
        assert (r["docs_at_least"], r["tokens_at_least"], r["docs_below"], r["tokens_below"]) == (len(there), there.sum(), len(below), below.sum())
        assert r["truncated_tokens"] == np.minimum(all_lengths, n).sum()


def windows_of(own, min_chars):
    """The shortest runs of lines from each line on and back to each line with enough characters, not all blank."""
    enough = lambda run: sum(map(len, run)) >= min_chars and any(x.strip(" ") for x in run)
    found = set()
    for i in range(len(own)):
        ahead = next((own[i:j] for j in range(i + 1, len(own) + 1) if enough(own[i:j])), None)
        back = next((own[j : i + 1] for j in range(i, -1, -1) if enough(own[j : i + 1])), None)
        found |= {tuple(w) for w in (ahead, back) if w}
    if sum(map(len, own)) < min_chars and any(x.strip(" ") for x in own):
        found = {tuple(own)}
    return found


def aligned(docs, min_chars=50):
    """Brute force of the operator's definition: kept text, deleted lines and partners of each document (distinct ids)."""
    from tessera.llm.line_align import RARE, removable

    lines = {d["doc_id"]: d["text"].split("\n") for d in docs if d["text"] is not None}
    holders, windows = defaultdict(list), defaultdict(list)
    for k in sorted(lines):
        for x in {x for x in lines[k] if x.strip(" ")}:
            holders[x].append(k)
        for w in windows_of(lines[k], min_chars):
            windows[w].append(k)
    out = {}
    for k, own in lines.items():
        partners = {holders[x][0] for x in own if x.strip(" ")} | {windows[w][0] for w in windows_of(own, min_chars)}
        partners |= {p for x in own if x.strip(" ") and len(holders[x]) <= RARE for p in holders[x]}
        gone, n = set(), 0
        for p in partners:
            if p < k:
                cut = removable(lines[p], own, [len(x) for x in own], min_chars)
                gone |= set(cut)
                n += bool(cut)
        out[k] = ("\n".join(x for i, x in enumerate(own) if i not in gone), len(gone), n)
    return out


def test_op10(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q["op10_line_alignment"](spark, sf_dir).collect()}
    wanted = aligned(docs)
    assert len(rows) == len(docs)
    for k, (kept, removed, partners) in wanted.items():
        r = rows[k]
        assert (r["lines_removed"], r["aligned_with"], r["kept_sha256"]) == (removed, partners, hashlib.sha256(kept.encode()).hexdigest())


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = now.columns
    seen = []
    for name, stage in P.STAGES[:-1]:
        now = P.table(stage(spark, now, sf_dir), name)
        assert now.columns == columns
        seen.append(now.collect())
    assert len(seen[0]) < len(docs)
    before, wanted = {r["doc_id"]: r for r in seen[0]}, aligned(seen[0])
    kept = {k: t for k, (t, removed, _) in wanted.items() if not removed or t.strip(" \t\n\v\f\r")}
    assert {r["doc_id"]: r["text"] for r in seen[1]} == kept
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in seen[1]])
    assert {r["doc_id"] for r in seen[2]} == {c for _, _, c in groups(sets)} and len({r["doc_id"] for r in seen[2]}) == len(seen[2])
    words = lambda rows: sum(len(r["text"].split()) for r in rows if r["text"])
    assert words(seen[3]) == pytest.approx(1.5 * words(seen[2]), rel=0.2)
    pieces = P.STAGES[-1][1](spark, now, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in seen[3])
    assert set(before) >= {r["doc_id"] for r in pieces}
