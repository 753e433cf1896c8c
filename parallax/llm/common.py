"""Shared helpers: vectorised words and word hashes over Arrow text columns, packed rows, shared tables.

Word splitting works on UTF-8 bytes.  Both word definitions of the operators only separate at
ASCII bytes, so every byte >= 0x80 is part of a word and no character is ever cut.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21  # text handled at once inside a task; a longer document is a chunk of its own

_B = np.arange(256)
SPACE_WORDS = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))  # [^\x20\x09-\x0D]+
ALNUM_WORDS = ~((_B <= 0x2F) | ((_B >= 0x3A) & (_B <= 0x60)) | ((_B >= 0x7B) & (_B <= 0x7F)))
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of the public splitmix64 generator)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(64 * 256, dtype=np.uint64) * BASE + np.uint64(seed))


_TABLES: dict[int, np.ndarray] = {}


def column_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text.fill_null("") if text.null_count else text
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def row_slices(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has about `limit` bytes at most (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of some rows: `start`, `end` (bytes), `first` (row r has words first[r]:first[r+1])."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
        self.data, self.offs = data, offs
        inside = kind[data]
        self.inside = inside
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.n = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word: a random value for each (place, byte), summed and mixed."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        table = _TABLES.setdefault(seed, None) if seed in _TABLES else None
        if table is None:
            table = _TABLES[seed] = _byte_table(seed)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
        with np.errstate(over="ignore"):
            x = table[((place & 63) << 8) | self.data[self.inside]]
            if length.max() > 64:
                x = x * (2 * (place >> 6) + 1).astype(np.uint64)
                x = np.where(place >= 64, mix(x), x)
            return mix(np.add.reduceat(x, begin) + length.astype(np.uint64) * BASE)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, BASE_INVERSE)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def rolling(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the words begin..end-1 for each pair, by prefix sums of h[i] * BASE**i."""
    up, down = powers(len(h))
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        x = (total[end] - total[begin]) * down[begin]
        return mix(x + (end - begin).astype(np.uint64))


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of every run of k words that lies in one row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return row, at


def pack(**columns) -> bytes:
    """Columns as one compressed value, so that a shuffle moves few large rows."""
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload.as_buffer() if hasattr(payload, "as_buffer") else payload)).read_all()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def text_bytes(docs: DataFrame, name: str = "text") -> int:
    """Bytes of all texts: the size by which packs and buckets are numbered."""
    return int(docs.agg(F.sum(F.octet_length(name))).first()[0] or 0)


def bucket_count(spark: SparkSession, total: int, each: int) -> int:
    """So many buckets that one holds the work of about `each` bytes of text."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // each), 1)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    The setting is read from the session.  Where it is unset (local tests) the warehouse folder
    of the session is used, never a machine-local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Remove a shared table that no plan needs any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of docs; extra columns, whatever their names, are left out."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def apart(docs: DataFrame, carry: tuple[str, ...], taken: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """(docs, names) with every column of `carry` once; one that is named like a column in `taken`,
    whatever the case of its letters, is called <name>_carried."""
    used = {t.lower() for t in taken} | {c.lower() for c in carry}
    names: dict[str, str] = {}
    for c in dict.fromkeys(carry):
        new = c
        if c.lower() in {t.lower() for t in taken}:
            while new.lower() in used:
                new += "_carried"
            used.add(new.lower())
        names[c] = new
    if all(c == new for c, new in names.items()):
        return docs, tuple(names)
    own = {n: F.col(f"`{n}`") for n in ("doc_id", "text")}
    return docs.select(*[c.alias(n) for n, c in (own | {new: F.col(f"`{c}`") for c, new in names.items()}).items()]), tuple(names.values())
