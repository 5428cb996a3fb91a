"""Posting lists in blocks: no row, task or array holds a whole term.

A task first packs some millions of postings as they come into lists of a term, so rows that are sorted and shuffled are lists and
not postings. The lists are written and dealt to ranges of (term, stretch of ids), where their ids are merged: a
block holds up to BLOCK consecutive chunk ids of a term, as differences from its first id, with the first and last id beside
them. A search that knows which ids it asks for reads only the blocks that cover them. A block also ends where its range
ends, so a term of any length is packed by as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import Saved, saved

#: Chunk ids of a block at most; the greatest difference inside a block.
BLOCK, SPAN = 4096, 1 << 31
SCHEMA = "term string, first_id long, last_id long, n int, ids array<int>"


#: Postings that a task packs at once, and ids of a stretch, whose lists of a term are merged at once.
FLOCK, STRETCH = 2_000_000, 1 << 20
LISTS = "term string, stretch long, first_id long, n int, ids array<int>"


def _starts(new: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where blocks begin in sorted ids; new marks where terms do."""
    run = np.flatnonzero(new)
    place = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))
    new = new | (place % most == 0)
    new[1:] |= ids[1:] // SPAN != ids[:-1] // SPAN
    return np.flatnonzero(new)


def _rows(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(first id, last id, n, differences) of the blocks of sorted ids."""
    edges = np.append(starts, len(ids))
    n = np.diff(edges)
    first = ids[starts]
    offsets = (ids - np.repeat(first, n)).astype(np.int32)
    return first, ids[edges[1:] - 1], n.astype(np.int32), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(offsets))


def _listed(batches: Iterator[pa.RecordBatch], flock: int, width: int) -> Iterator[pa.RecordBatch]:
    """Lists (LISTS) of rows (term, chunk_id) in any order: distinct ids of a term within a flock of rows and a stretch of ids."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        kinds = rows.column(0).cast(pa.string()).combine_chunks().dictionary_encode()
        code, ids = kinds.indices.to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(code, kind="stable") if (ids[1:] >= ids[:-1]).all() else np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        once = np.append(True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1]))
        code, ids = code[once], ids[once]
        stretch = ids // width
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])))
        first, _, n, lists = _rows(ids, starts)
        return pa.RecordBatch.from_arrays([kinds.dictionary.take(pa.array(code[starts])), pa.array(stretch[starts]), pa.array(first), pa.array(n), lists], ["term", "stretch", "first_id", "n", "ids"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= flock:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks (SCHEMA) of lists sorted by term, stretch and first id; what can still grow waits for the next batch."""
    names = ["term", "first_id", "last_id", "n", "ids"]

    def blocks(terms: pa.Array, new: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        first, last, n, lists = _rows(ids, starts)
        return pa.RecordBatch.from_arrays([terms.take(pa.array((np.cumsum(new) - 1)[starts])), pa.array(first), pa.array(last), pa.array(n), lists], names)

    rest: list[pa.RecordBatch] = []  # lists of the last term and stretch, and before them the last block's ids as one list
    waiting = 0

    def settle(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest, waiting
        rows = pa.Table.from_batches(rest).combine_chunks()
        terms, stretch = rows.column("term").combine_chunks(), rows.column("stretch").to_numpy()
        first, n = rows.column("first_id").to_numpy(), rows.column("n").to_numpy()
        ids = np.repeat(first, n) + pc.list_flatten(rows.column("ids").combine_chunks()).to_numpy()
        other = np.append(True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False))
        apart = other.copy()
        apart[1:] |= stretch[1:] != stretch[:-1]
        if not final:  # the last term and stretch may go on
            last = int(np.flatnonzero(apart)[-1])
            if not last:
                return
            tail = rows.slice(last)
            end = int(n[:last].sum())
            rows, terms, n, other, apart, ids = rows.slice(0, last), terms[:last], n[:last], other[:last], apart[:last], ids[:end]
        key = np.repeat(np.cumsum(apart), n)
        if ((key[1:] == key[:-1]) & (ids[1:] <= ids[:-1])).any():
            order = np.lexsort((ids, key))
            ids = ids[order]
            once = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        else:
            once = np.ones(len(ids), bool)
        at = np.repeat(np.cumsum(other) - 1, n)[once]
        ids = ids[once]
        new = np.append(True, at[1:] != at[:-1])
        names_of = terms.take(pa.array(np.flatnonzero(other)))
        starts = _starts(new, ids, most)
        rest = []
        if not final:
            if tail.column("term")[0].as_py() == names_of[-1].as_py():  # its last block may go on too
                cut = int(starts[-1])
                left = ids[cut:]
                lists = pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), pa.array((left - left[0]).astype(np.int32)))
                rest = [pa.RecordBatch.from_arrays([names_of[-1:], pa.array(tail.column("stretch")[:1].to_numpy() - 1), pa.array(left[:1]), pa.array([len(left)], pa.int32()), lists], rows.column_names)]
                new, ids, starts = new[:cut], ids[:cut], starts[:-1]
            rest += tail.to_batches()
        waiting = sum(b.num_rows for b in rest)
        if len(ids):
            yield blocks(names_of, new, ids, starts)

    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(0).cast(pa.string()), *batch.columns[1:4], batch.column(4).cast(pa.list_(pa.int32()))]
        rest.append(pa.RecordBatch.from_arrays(arrays, ["term", "stretch", "first_id", "n", "ids"]))
        if sum(b.num_rows for b in rest) >= 2 * waiting:
            yield from settle(False)
    if rest:
        yield from settle(True)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, chunk_id) of rows (tokens, chunk_id), whose tokens are arrays or joined by a space."""
    for batch in batches:
        lists, ids = batch.columns
        if not pa.types.is_list(lists.type):
            some = pc.not_equal(lists, "")
            lists, ids = pc.split_pattern(lists.filter(some).cast(pa.string()), " "), ids.filter(some)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(ids.to_numpy(), n))], ["term", "chunk_id"])


def listed(postings: DataFrame) -> Saved:
    """Lists of postings (term, chunk_id), or of chunks with their tokens (chunk_id, tokens), not yet merged."""
    flock, width, whole = FLOCK, STRETCH, "tokens" in postings.columns
    rows = postings.select("tokens" if whole else "term", "chunk_id")
    return saved(rows.mapInArrow(lambda batches: _listed(_exploded(batches) if whole else batches, flock, width), LISTS), "posting-lists")


def merged(lists: DataFrame) -> DataFrame:
    """term, first_id, last_id, n, ids (differences from first_id, ascending) of lists."""
    most = BLOCK
    rows = lists.repartitionByRange("term", "stretch").sortWithinPartitions("term", "stretch", "first_id")
    return rows.mapInArrow(lambda batches: _merged(batches, most), SCHEMA)


def packed(postings: DataFrame) -> DataFrame:
    """Blocks of postings; repeated rows count once. The table of lists stays, for the blocks are read from it."""
    return merged(listed(postings).rows)


def unpacked(blocks: DataFrame) -> DataFrame:
    """term, chunk_id of blocks."""
    ids = F.transform("ids", lambda d: F.col("first_id") + d)
    return blocks.select("term", F.explode(ids).alias("chunk_id"))


def document_frequency(blocks: DataFrame) -> DataFrame:
    """term, df of blocks, without reading an id."""
    return blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
