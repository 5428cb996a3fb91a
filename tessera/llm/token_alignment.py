"""Alignment of two tokenizers by relational operations.

Texts are cut into segments at borders that neither tokenizer's tokens cross (before a space that follows a letter, mark,
number, punctuation or symbol), and each distinct segment is encoded and aligned once:

1. posexplode gives its tokens, a windowed sum of their lengths where each ends.
2. An equi-join on segment and end finds the ends of both: the cuts. Running cut counts are the group ids.
3. Two tokens overlap between two neighbouring ends of either side, so a link is a row of the (outer) join on the end: its
   tokens are the nearest that end there or later. No group's tokens are paired with each other.
4. Links weigh as often as their segment occurs; counts of id pairs and their maximum by B id follow by grouping.

Documents then gather their segments' figures. They are dealt to parts of some tens of megabytes, whose distinct segments are
counted and written first: they sum up to the table of segments, later meet it again, and a part's documents meet only their
part's segments. So texts are shuffled twice and cut twice, occurrences of segments are never shuffled, and a segment that is everywhere is one row for each part. There a segment is a number: a hash with the first seed by which
no two segments of the table are equal, so a part holds no texts of segments. A part's figures travel as compressed blocks,
and its documents reach the gathering task in pieces, so that a batch holds no long documents.

The first tokenizer is a byte-level BPE whose splitting pattern never has a space after a non-space inside a word, the second
a sentencepiece model that adds a space in front; a model with a piece that has a space after another character is refused.
Null and empty texts, and texts whose tokens of one side do not join to a space and the text, have no tokens. Repeated rows
are counted each, null ids are like others, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import vocabulary
from tessera.llm.common import Stored, by_key, lookup, release, slices, stored, table
from tessera.llm.tokens import default_path

#: Bytes of text in a part, and parts at least.
PART_BYTES, LEAST_PARTS = 64_000_000, 6
#: A token in an array is its id times this much, plus its size; a link is the id of A times 2^32, plus the id of B.
SIZES = 1 << 14
#: Distinct pairs of ids that are broadcast; more are joined by their key.
LISTED_PAIRS = 1_000_000
#: Segments whose figures a task gathers at once, whose figures are in a block at most, and of a document in a piece at most.
GATHERED, BLOCK, PIECE = 200_000, 20_000, 50
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: A border between segments: a space after a character that is no space in any Unicode version.
BORDER = "(?= )(?<=[\\p{L}\\p{M}\\p{N}\\p{P}\\p{S}])"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are plain text
    return tokenizer


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[object, list[bytes], int]:
    """(processor, bytes of each piece, pieces of the leading word that gives every segment its context)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError(f"{path} has pieces with a space after another character")
    as_bytes = [bytes([int(n[3:-1], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return model, as_bytes, len(model.encode("x"))


def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Arrow's free memory goes back after the last one, as Python workers wait for other tasks with what they hold."""
    yield from batches
    pa.default_memory_pool().release_unused()


def segments(text: Column) -> Column:
    """The segments of a space and the text."""
    return F.split(F.concat(F.lit(" "), text), BORDER, -1)


def encode_segments(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """rows (seg, n) with the tokens of both sides as arrays (id and size in one number), and whether both join to the segment."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, (second, b_bytes, lead), a_bytes = _byte_level(a_path), _pieces(b_path), vocabulary(a_path).bytes
        sizes = [np.array([len(x) for x in t], np.int32) for t in (a_bytes, b_bytes)]
        for batch in batches:
            segs = batch.column(0).to_pylist()
            a = [e.ids for e in first.encode_batch(segs, add_special_tokens=False)]
            b = [ids[lead:] for ids in second.encode(["x" + s for s in segs], num_threads=1)]
            ok = [b"".join(map(a_bytes.__getitem__, x)) == s.encode() == b"".join(map(b_bytes.__getitem__, y)) for x, y, s in zip(a, b, segs, strict=True)]
            sides = []
            for side, size in zip((a, b), sizes, strict=True):
                ids = np.fromiter((i for x in side for i in x), np.int32)
                sides.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, side)]), pa.int32()), pa.array(ids * np.int32(SIZES) + size[ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, pa.array(ok, pa.bool_())], ["seg", "n", "a", "b", "ok"])

    return rows.select("seg", "n").mapInArrow(lambda batches: returned(encode(batches)), "seg string, n long, a array<int>, b array<int>, ok boolean")


def key(seg: Column, seed: int) -> Column:
    """A segment's number."""
    return F.xxhash64(F.lit(seed), seg)


def telling(segs: DataFrame) -> int:
    """The first seed by which no two segments (distinct seg) have the same number."""
    numbers = lambda seed: segs.select(key(F.col("seg"), seed).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return next(seed for seed in count() if not numbers(seed).filter("n > 1").head(1))


def align_segments(segs: DataFrame) -> DataFrame:
    """A row for each link of each segment (sid, n, a, b): sid, n, end, a, b, group (from 0), and ends_a, ends_b, whether the tokens end here.

    The join on the end is a grouping of both sides' rows, which keeps a segment where it is; Spark's full outer join
    would shuffle all rows again.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("tokens")) for c in "ab"])).alias("s")
    rows = segs.repartition("sid").select("sid", "n", sides).select("sid", "n", "s.side", F.posexplode("s.tokens").alias("pos", "t"))
    order = Window.partitionBy("sid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select("sid", "n", F.sum(F.col("t") % SIZES).over(order).alias("end"), *[F.when(F.col("side") == c, F.floor(F.col("t") / SIZES).cast("int")).alias(c) for c in "ab"])
    met = ends.groupBy("sid", "n", "end").agg(F.max("a").alias("a"), F.max("b").alias("b"))  # a token of each side at most
    back = Window.partitionBy("sid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    links = met.select("sid", "n", "end", *[F.last(c, True).over(back).alias(c) for c in "ab"], *[F.col(c).isNotNull().alias(f"ends_{c}") for c in "ab"], F.count(cut).over(back).alias("_later"))
    return links.withColumn("group", F.max("_later").over(Window.partitionBy("sid")) - F.col("_later")).drop("_later")


def _ids(side: str) -> Column:
    """The ids of a side's tokens that end in a group, in order, as text."""
    return F.array_join(F.transform(F.filter("_l", lambda x: x[f"ends_{side}"]), lambda x: x[side].cast("string")), ",")


def by_segment(links: DataFrame) -> DataFrame:
    """sid, n, n_a, n_b, n_groups, n_links, groups (as text), links (array of both ids in one number) of each segment."""
    here = F.array_sort(F.collect_list(F.struct("end", "a", "b", "ends_a", "ends_b")))
    groups = links.groupBy("sid", "n", "group").agg(here.alias("_l"), *[F.count_if(f"ends_{c}").alias(f"n_{c}") for c in "ab"])
    pairs = F.transform("_l", lambda x: F.shiftleft(x["a"].cast("long"), 32) + x["b"])
    groups = groups.select("sid", "n", "n_a", "n_b", F.struct("group", F.concat(_ids("a"), F.lit("|"), _ids("b")).alias("g"), pairs.alias("links")).alias("_g"))
    per = groups.groupBy("sid", "n").agg(F.array_sort(F.collect_list("_g")).alias("_g"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in "ab"])
    per = per.withColumn("links", F.flatten(F.transform("_g", lambda x: x["links"])))
    return per.select("sid", "n", "n_a", "n_b", F.size("_g").cast("long").alias("n_groups"), F.size("links").cast("long").alias("n_links"), F.array_join(F.transform("_g", lambda x: x["g"]), ";").alias("groups"), "links")


def segment_figures(aligned: DataFrame) -> DataFrame:
    """sid, n, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each segment; aligned: stored."""
    links = aligned.select("sid", "n", F.explode("links").alias("pair"))
    counts = stored(links.groupBy("pair").agg(F.sum("n").alias("pair_count"), F.count("*").alias("n")).withColumn("b", F.col("pair") % (1 << 32)), "token-pairs")
    best = counts.rows.groupBy("b").agg(F.max("pair_count").alias("_most"))  # a row per id of the second vocabulary
    weighed = counts.rows.join(F.broadcast(best), "b").select("pair", "pair_count", (F.col("pair_count") == F.col("_most")).cast("long").alias("_best"), "n")
    if counts.rows.count() <= LISTED_PAIRS:
        met = links.select("sid", "pair").join(F.broadcast(weighed.drop("n")), "pair")  # LISTED_PAIRS rows at most
    else:
        met = lookup(links.select("sid", "pair"), weighed, ["pair"])
    sums = met.groupBy("sid").agg(F.sum("_best").alias("n_best"), F.sum("pair_count").alias("count_sum"))
    return aligned.drop("links").join(sums, "sid")


def packed(figures: DataFrame) -> DataFrame:
    """seg (its number), n, packed: COUNTS and groups as one text, a half of what they take in a shuffle as columns."""
    return figures.select(F.col("sid").alias("seg"), "n", F.concat_ws(" ", *[F.col(c).cast("string") for c in COUNTS], "groups").alias("packed"))


def unpacked(texts: pa.Array) -> list[pa.Array]:
    """COUNTS and groups of packed figures, as texts."""
    flat, width = pc.split_pattern(texts.cast(pa.string()), " ").flatten(), len(COUNTS) + 1
    return [flat.take(pa.array(np.arange(c, len(flat), width))) for c in range(width)]


def blocked(rows: DataFrame) -> DataFrame:
    """part, seg (array), packed (compressed): the rows (part, seg, packed) of each task, up to BLOCK of a part in one."""
    most = BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
        for (part,), all_rows in by_key(batches, 1):
            for at in range(0, all_rows.num_rows, most):
                own = all_rows.slice(at, most).combine_chunks().sort_by("packed")  # like texts beside each other take less
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("packed", pa.string())]), options=options) as out:
                    out.write_table(pa.table([own["packed"].cast(pa.string())], ["packed"]))
                segs = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own["seg"].combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), segs, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "seg", "packed"])

    return rows.select("part", "seg", "packed").sortWithinPartitions("part").mapInArrow(lambda batches: returned(pack(batches)), "part int, seg array<long>, packed binary")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(part, kind, rows) of each run of rows with the same part and kind."""
    at, kind = batch.column("part").to_numpy(), batch.column("_k").to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield int(at[i]), int(kind[i]), batch.slice(i, j - i)


def unblocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `gather` reads, of a part's blocks (_k 0: seg, packed) and then its documents' pieces (_k 1: doc_id, piece, last)."""
    early: list[pa.RecordBatch] = []  # pieces of a document that goes on in the next batch
    for batch in batches:
        for part, kind, run in _runs(batch):
            if not kind:
                for segs, block in zip(run.column("seg"), run.column("packed"), strict=True):
                    packed = pa.ipc.open_stream(block.as_buffer()).read_all()["packed"].combine_chunks()
                    yield _asked(part, 0, len(packed), segs.values, packed, pa.nulls(len(packed), run.column("doc_id").type), pa.nulls(len(packed), pa.list_(pa.int64())))
                continue
            early.append(run.select(["doc_id", "piece", "last"]))
            if not pc.any(run.column("last")).as_py():
                continue
            rows = pa.Table.from_batches(early).combine_chunks().to_batches()[0]
            ends = np.flatnonzero(rows.column("last").to_numpy(zero_copy_only=False))
            done = int(ends[-1]) + 1
            early = [rows.slice(done)] if done < rows.num_rows else []
            pieces = rows.column("piece").slice(0, done)
            edges = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy())[ends])
            segs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pieces.flatten())
            yield _asked(part, 1, len(ends), pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.string()), rows.column("doc_id").take(pa.array(ends)), segs)


def _asked(part: int, kind: int, n: int, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int32)) for x in (part, kind)] + list(columns), ["part", "_k", "seg", "packed", "doc_id", "segs"])


def _bad_texts(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The digests of texts with a segment whose tokens do not join to it."""
    return rows.select(F.md5("_t").alias("_m"), F.explode(segments(F.col("_t"))).alias("seg")).join(bad.select("seg"), "seg", "left_semi").select("_m").distinct()


def _dealt(docs: DataFrame) -> tuple[int, Column]:
    """(number of parts, part of a document) of documents (doc_id, _t)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("_t").cast("long")), F.lit(0)).alias("n")).head()["n"]
    parts = int(size // PART_BYTES) + LEAST_PARTS
    return parts, F.pmod(F.xxhash64("doc_id", "_t"), F.lit(parts)).cast("int").alias("part")


def _gathered(docs: DataFrame, parts: int, part: Column, own: Stored, figures: Stored, seed: int, kind: str) -> DataFrame:
    """doc_id, COUNTS, groups of each document (doc_id, _t), from the packed figures of its part's segments (own), which both go.

    The documents of a part follow its distinct segments in a task. What their figures are is written, so that the shuffles
    before are gone from the disks when texts and figures meet.
    """
    here = own.rows.select("part", key(F.col("seg"), seed).alias("seg"))
    met = stored(blocked(lookup(here, figures.rows.withColumn("n", F.least("n", F.lit(parts))), ["seg"])), "part-figures")  # a segment is in a part once
    for gone in (own, figures):
        gone.drop()
    release(docs.sparkSession)
    first = met.rows.select("part", F.lit(0).alias("_k"), "seg", "packed", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("_t"))
    later = docs.select(part, F.lit(1).alias("_k"), F.lit(None).cast("array<long>").alias("seg"), F.lit(None).cast("binary").alias("packed"), "doc_id", "_t")
    both = first.unionByName(later).repartition(parts, "part").sortWithinPartitions("part", "_k")
    both = both.withColumn("_s", F.transform(segments(F.col("_t")), lambda s: key(s, seed)))
    most = F.floor((F.size("_s") - 1) / PIECE).cast("int")
    cut = lambda i: F.struct(F.slice("_s", i * PIECE + 1, F.lit(PIECE)).alias("piece"), (i == most).alias("last"))
    both = both.select("part", "_k", "seg", "packed", "doc_id", F.explode_outer(F.transform(F.sequence(F.lit(0), most), cut)).alias("_p"))
    both = both.select("part", "_k", "seg", "packed", "doc_id", "_p.piece", "_p.last")
    return both.mapInArrow(lambda batches: returned(gather(unblocked(batches))), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string")


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, COUNTS, groups of documents (segs: their segments' numbers), which follow their part's figures (in any order)."""
    width = len(COUNTS)
    sizes = [np.int64 if c == "count_sum" else np.int32 for c in COUNTS]
    now, held, keys, rows, texts = None, [], np.zeros(0, np.int64), [np.zeros(0, x) for x in sizes], pa.array([], pa.string())
    for batch in batches:
        for at, kind, run in _runs(batch):
            if at != now:
                now, held = at, []
                keys, rows, texts = keys[:0].copy(), [x[:0].copy() for x in rows], pa.array([], pa.string())  # two parts are not held at once
            if not kind:
                *numbers, groups = unpacked(run.column("packed"))
                held.append((run.column("seg").to_numpy(), [x.cast(pa.int64()).to_numpy().astype(y) for x, y in zip(numbers, sizes, strict=True)], groups))
                continue
            if held:  # all figures of the part are there
                keys = np.concatenate([h[0] for h in held])
                order = np.argsort(keys)
                keys, rows = keys[order], [np.concatenate([h[1][c] for h in held])[order] for c in range(width)]
                texts, held = pa.concat_arrays([h[2] for h in held]).take(pa.array(order)), []
            for a, b in slices(pc.list_value_length(run.column("segs")).to_pylist(), GATHERED):
                segs = run.column("segs").slice(a, b - a)
                edges = np.append(0, np.cumsum(pc.list_value_length(segs).to_numpy()))
                asked = segs.flatten().to_numpy()
                found = np.searchsorted(keys, asked)
                if (keys.take(found, mode="clip") != asked).any():
                    raise KeyError(f"part {now} has documents with segments without figures")
                sums = [np.add.reduceat(x[found], edges[:-1], dtype=np.int64) for x in rows]  # a text has a segment at least
                groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), texts.take(pa.array(found))), ";")
                yield pa.RecordBatch.from_arrays([run.column("doc_id").slice(a, b - a), *map(pa.array, sums), groups.cast(pa.string())], ["doc_id", *COUNTS, "groups"])


def align_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as `a1,a2|b1;a3|b2,b3`) of each document."""
    kind = dict(docs.select(F.col(doc_id)).dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    some = rows.filter("_t <> ''")
    parts, part = _dealt(some)
    own = some.select(part, "_t").repartition(parts, "part").select("part", F.explode(segments(F.col("_t"))).alias("seg"))
    own = stored(own.groupBy("part", "seg").agg(F.count("*").alias("n")), "part-segments")
    release(docs.sparkSession)  # of the texts' first shuffle
    found = own.rows.groupBy("seg").agg(F.sum("n").alias("n"))
    segs = stored(encode_segments(found, a_path or default_path(), b_path or default_pieces()), "segments")
    seed = telling(segs.rows)
    bad = segs.rows.filter("not ok")
    good, fine, without = some, segs.rows.filter("ok"), rows.filter("_t is null or _t = ''")
    if bad.head(1):
        gone = table(_bad_texts(some, bad), "segments-bad")
        out = some.join(gone, F.md5("_t") == F.col("_m"), "left_semi")
        less = out.select(F.explode(segments(F.col("_t"))).alias("seg")).groupBy("seg").agg(F.count("*").alias("_less"))
        good, without = some.join(gone, F.md5("_t") == F.col("_m"), "left_anti"), without.unionByName(out)
        fine = fine.join(less, "seg", "left").withColumn("n", F.col("n") - F.coalesce("_less", F.lit(0))).drop("_less").filter("n > 0")
    fine = fine.withColumn("sid", key(F.col("seg"), seed))
    aligned = stored(by_segment(align_segments(fine.select("sid", "n", "a", "b"))), "segments-aligned")
    segs.drop()
    release(docs.sparkSession)
    figures = stored(packed(segment_figures(aligned.rows)), "segment-figures")
    aligned.drop()
    release(docs.sparkSession)
    return _gathered(good, parts, part, own, figures, seed, kind).unionByName(without.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("groups")))
