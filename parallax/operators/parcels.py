"""Rows moved as parcels: a task sorts a block of rows by where they go and sends the rows of one place as one compressed value.

N-grams sorted beside each other share most of their bytes, so a parcel takes a fraction of what its rows take in a
shuffle one by one.  A place is a part (0 .. parts - 1); `PARTS_OF` neighbouring parts are one partition and come one
after the other, so a task holds the rows of one part only.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS_OF = 4  # parts of a partition
_CODEC = pa.Codec("zstd", compression_level=3)


def part_of(names: list[bytes], parts: int) -> np.ndarray:
    """The part of each name."""
    return np.fromiter((zlib.crc32(x) for x in names), np.int64, len(names)) % parts


def bucket_of(texts: pa.Array, buckets: int) -> np.ndarray:
    """Spark's bucket of each string (Murmur3 with seed 42)."""
    n, (_, offsets, data) = len(texts), texts.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size, at = np.diff(at), at[:-1]
    h = np.full(n, 42, np.uint32)

    def mix(rows, k):
        k = k * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        x = h[rows] ^ k
        h[rows] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)

    for w in range(int(size.max(initial=0)) // 4):
        rows = np.flatnonzero(size // 4 > w)
        first = at[rows] + 4 * w
        mix(rows, sum(raw[first + b].astype(np.uint32) << np.uint32(8 * b) for b in range(4)))
    for b in range(3):  # the bytes behind, each with its sign
        rows = np.flatnonzero(size % 4 > b)
        mix(rows, raw[at[rows] + size[rows] // 4 * 4 + b].astype(np.int8).astype(np.int32).astype(np.uint32))
    h ^= size.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    h ^= h >> np.uint32(16)
    return h.astype(np.int32).astype(np.int64) % buckets


def packed(part: np.ndarray, names: pa.Array, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, parcel) of rows: a name and numbers each."""
    order = np.lexsort((pa.compute.rank(names, tiebreaker="dense").to_numpy(), part)) if len(names) else np.zeros(0, np.int64)
    part, names, columns = part[order], names.take(pa.array(order)), [c[order] for c in columns]
    if not len(names):
        return
    _, offsets, data = names.buffers()
    at, data = np.frombuffer(offsets, np.int32, len(names) + 1), memoryview(data if data is not None else b"")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        plain = b"".join([np.diff(at[lo : hi + 1]).tobytes(), *[c[lo:hi].tobytes() for c in columns], data[at[lo] : at[hi]]])
        yield int(part[lo]), np.array([hi - lo, len(plain)], np.int64).tobytes() + _CODEC.compress(plain, asbytes=True)


def unpacked(parcel: bytes, *kinds) -> tuple:
    """(names, column, ...) of a parcel."""
    n, size = np.frombuffer(parcel, np.int64, 2).tolist()
    plain = _CODEC.decompress(parcel[16:], decompressed_size=size)
    at, out = 4 * n, []
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(plain, np.int32, n))]).astype(np.int32)
    for kind in kinds:
        out.append(np.frombuffer(plain, kind, n, at))
        at += out[-1].nbytes
    names = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), plain.slice(at)])
    return names, *out


def delivered(parcels: DataFrame, partitions: int, run: Callable, schema: str, *kinds) -> DataFrame:
    """(part, parcel) -> what `run(part, names, column, ...)` yields for the rows of each part."""

    def each(batches):
        now, held = None, []

        def rows():
            columns = list(zip(*[unpacked(x, *kinds) for x in held]))
            return run(now, pa.concat_arrays(columns[0]), *[np.concatenate(c) for c in columns[1:]])

        for batch in batches:
            for part, parcel in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now and held:
                    yield from rows()
                    held = []
                now = part
                held.append(parcel.as_py())
        if held:
            yield from rows()

    to = F.expr(f"cast(part div {PARTS_OF} as int)")
    placed = parcels.select("part", "parcel").repartitionById(partitions, to).sortWithinPartitions("part")
    return placed.mapInArrow(each, schema)
