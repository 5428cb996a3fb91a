"""Content hashes in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

#: Fixed values of FNV-1a with 64 bits.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Bytes hashed at once; values whose next bytes are hashed together, at least; bytes of the others in a step, few enough for
#: its arrays to stay in cache.
SLICE, WIDE, STEP = 16_000_000, 64, 250_000


def _advance(state: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The states of few long values after `sizes` more bytes of each, which raw holds one after the other, without a loop over bytes.

    Bit k of the state's low byte depends on its lower bits and is else a running xor, so eight passes give the low byte
    before every input byte. With it, h = (h xor b) * p is h = (h + d) * p with known d: a sum of powers of p.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    some = sizes > 0
    own = np.repeat(starts, sizes)
    low = np.zeros(len(raw), np.uint8)
    for k in range(8):
        known = (low ^ raw) & np.uint8((1 << k) - 1)
        change = (raw >> np.uint8(k) & np.uint8(1)) ^ (known * np.uint8(PRIME & 0xFF) >> np.uint8(k) & np.uint8(1))
        before = np.bitwise_xor.accumulate(change) ^ change if len(raw) else change
        bit = (state >> np.uint64(k) & np.uint64(1)).astype(np.uint8)
        low |= (before ^ before[own] ^ np.repeat(bit, sizes)) << np.uint8(k)
    step = (low ^ raw).astype(np.int64) - low
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), PRIME, np.uint64)]))
        out = state * power[sizes]
        if some.any():
            left = np.repeat(ends, sizes) - np.arange(len(raw))
            out[some] += np.add.reduceat(step.view(np.uint64) * power[left], starts[some])
    return out


def fnv64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each value: byte by byte of all values together while many have one, then the rest of the longest."""
    sizes = np.array([len(v) for v in values], np.int64)
    raw = np.frombuffer(b"".join(values), np.uint8)
    order = np.argsort(-sizes, kind="stable")
    size, at = sizes[order], (np.cumsum(sizes) - sizes)[order]
    state = np.full(len(values), BASIS, np.uint64)
    common = int(size[WIDE - 1]) if len(values) >= WIDE else 0
    longer = np.searchsorted(-size, -np.arange(common), "left")  # values with more bytes than that
    for n in longer.tolist():
        state[:n] = (state[:n] ^ raw[at[:n]]) * np.uint64(PRIME)
        at[:n] += 1
    done = common
    rest = int((size > done).sum())
    while rest:
        some = np.minimum(size[:rest] - done, max(1, STEP // rest))
        place = np.repeat(at[:rest] - np.cumsum(some) + some, some) + np.arange(some.sum())
        state[:rest] = _advance(state[:rest], raw[place], some)
        at[:rest] += some
        done += int(some[0])
        rest = int((size > done).sum())
    out = np.empty_like(state)
    out[order] = state
    return out


def fnv64_bulk(files: DataFrame, content: str = "content", normalize: bool = True) -> DataFrame:
    """files with hash64 (signed) of the content: with normalised newlines, or of the bytes as they are. Null is empty."""
    names = files.columns
    at = names.index(content)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for i, v in enumerate(batch.column(at)):
                v = v.as_py()
                v = v.encode() if isinstance(v, str) else v or b""
                held.append(v.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if normalize else v)
                size += len(held[-1])
                if size >= SLICE or i == batch.num_rows - 1:
                    hashes = pa.array(fnv64_many(held).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, hashes], [*names, "hash64"])
                    start, held, size = i + 1, [], 0

    return files.mapInArrow(apply, StructType(files.schema.fields[:]).add("hash64", LongType()))
