"""Operator 8: substring dedup with Rabin-Karp hashes of every fixed-length token window.

1. Each task hashes every window of its texts (prefix sums of word hash times base power, modulo
   2**64).  Inside a block of windows only the first start of a hash goes on as a candidate; the
   later ones are repeats already, so a window that stands in a third of all rows is sent once
   per block.
2. The candidates are dealt out by hash; each bucket finds the smallest (doc_id, start) of every
   hash and reports all other starts, as packed rows by document bucket.
3. Texts and reports meet by document bucket; repeated windows that touch or overlap are merged
   into maximal removal intervals, and these are cut.

A null text has no words, like an empty one; a text shorter than a window is kept whole.  A null
doc_id counts as the smallest id.  doc_id is the key: rows that repeat a doc_id and text get the
same result, and do not count as earlier than each other; where rows share a doc_id but not the
text, an interval found in one of them is cut in each.  Only doc_id, text and the columns named in
`carry` are read; a carried column that is named like one of the result, or text, comes back as
<name>_carried.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SPACE_WORDS, Words, apart, bucket_count, column, column_bytes, mix, pack, rolling, row_slices,
                     text_bytes, unpack, windows)

BLOCK_WINDOWS = 1 << 20  # windows whose repeats are found before the shuffle
BUCKET_BYTES = 24 << 20  # text whose windows make up one bucket
NULL_ID = -(1 << 63)


def _ids(values) -> np.ndarray:
    return values.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def _runs(sorted_keys: np.ndarray):
    """(begin, end) of each run of equal keys."""
    cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, int)
    return zip(cut[:-1], cut[1:])


def _earliest(h, doc, start):
    """Indices of the first (doc, start) of each hash, and of the starts that come later."""
    order = np.argsort(h)
    hs = h[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
    single = new & np.append(new[1:], True)[: len(new)]
    many = order[~single]  # only these need the order of documents
    many = many[np.lexsort((start[many], doc[many], h[many]))]
    head = np.ones(len(many), bool)
    head[1:] = h[many[1:]] != h[many[:-1]]
    top = many[head][np.cumsum(head) - 1] if len(many) else many
    later = (doc[many] != doc[top]) | (start[many] != start[top])
    return np.concatenate([order[single], many[head]]), many[later]


def _reports(doc, start, n_docs):
    """(document bucket, packed repeated starts)."""
    bucket = _doc_bucket(doc, n_docs)
    order = np.lexsort((start, doc, bucket))
    bucket, doc, start = bucket[order], doc[order], start[order]
    for a, b in _runs(bucket):
        yield int(bucket[a]), pack(doc=np.diff(doc[a:b], prepend=0), start=start[a:b])


def _batch(rows, **kinds) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _hash_windows(k: int, n_buckets: int):
    """Texts -> (bucket, doc_bucket, payload): candidates by hash bucket (doc_bucket null), and the
    repeats that a block shows by itself."""

    def block_rows(parts):
        h, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        first, again = _earliest(h, doc, start)
        for b, payload in _reports(doc[again], start[again], n_buckets):
            yield b, b, payload
        bucket = (h[first] % np.uint64(n_buckets)).astype(np.int32)
        first = first[np.lexsort((start[first], doc[first], bucket))]
        bucket = (h[first] % np.uint64(n_buckets)).astype(np.int32)
        for a, b in _runs(bucket):
            i = first[a:b]
            yield int(bucket[a]), None, pack(h=h[i], doc=np.diff(doc[i], prepend=0), start=np.diff(start[i], prepend=0))

    def run(batches):
        parts, waiting = [], 0
        for batch in batches:
            ids = _ids(batch.column(0))
            data, offs = column_bytes(batch.column(1))
            for lo, hi in row_slices(offs):
                words = Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], SPACE_WORDS)
                row, at = windows(words.first, k)
                if len(at):
                    h = rolling(words.hashes(), at, at + k)
                    parts.append((h, ids[lo:hi][row], (at - words.first[row]).astype(np.int32)))
                    waiting += len(h)
                if waiting >= BLOCK_WINDOWS:
                    yield _batch(list(block_rows(parts)), bucket=pa.int32(), doc_bucket=pa.int32(), payload=pa.binary())
                    parts, waiting = [], 0
        if waiting:
            yield _batch(list(block_rows(parts)), bucket=pa.int32(), doc_bucket=pa.int32(), payload=pa.binary())

    return run


def _find_repeats(n_buckets: int):
    """A hash bucket -> its repeated starts by document bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows, parts = [], []
        for doc_bucket, payload in zip(table.column("doc_bucket").to_pylist(), table.column("payload")):
            if doc_bucket is None:
                parts.append(unpack(payload))
            else:
                rows.append((doc_bucket, payload.as_py()))
        if parts:
            h = np.concatenate([column(p, "h") for p in parts])
            doc = np.concatenate([np.cumsum(column(p, "doc")) for p in parts])
            start = np.concatenate([np.cumsum(column(p, "start"), dtype=np.int32) for p in parts])
            _, again = _earliest(h, doc, start)
            rows += _reports(doc[again], start[again], n_buckets)
        return pa.Table.from_batches([_batch(rows, bucket=pa.int32(), payload=pa.binary())])

    return run


def _pack_texts(n_buckets: int):
    """Rows of a document bucket as one compressed value, so that texts are shuffled small."""

    def run(batches):
        for batch in batches:
            bucket = _doc_bucket(_ids(batch.column(0)), n_buckets)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for a, b in _runs(bucket[order]):
                part = batch.take(pa.array(order[a:b]))
                rows.append((int(bucket[order[a]]), pack(**dict(zip(batch.schema.names, part.columns)))))
            yield _batch(rows, bucket=pa.int32(), payload=pa.binary())

    return run


def _strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A string column of bytes and offsets."""
    kind, offsets = (pa.string(), np.int32) if len(data) < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(offsets)), pa.py_buffer(np.ascontiguousarray(data))])


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """Each row's kept words, joined by one space."""
    start, length = words.start[keep], words.end[keep] - words.start[keep]
    n_kept = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(words.first[:-1], len(keep))) * (words.n > 0)
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 0x20, np.uint8)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(begin, length) + place] = words.data[np.repeat(start, length) + place]
    cut = np.append(begin, len(out))[np.concatenate([[0], np.cumsum(n_kept)])]  # where each row begins
    used = np.ones(len(out), bool)
    last = cut[1:][n_kept > 0] - 1
    used[last] = False  # the space behind a row's last word
    gone = np.concatenate([[0], np.cumsum(n_kept > 0)])
    return _strings(out[used], cut - gone)


def cut_text(words: Words, keep: np.ndarray) -> pa.Array:
    """Each row's text without the words that are not kept and the white space behind them."""
    first = np.append(words.start, len(words.data))
    nxt = np.minimum(first[1:], words.offs[np.searchsorted(words.offs, words.start, "right")])
    step = np.zeros(len(words.data) + 1, np.int64)
    gone = ~keep
    np.add.at(step, words.start[gone], 1)
    np.add.at(step, nxt[gone], -1)
    used = np.cumsum(step[:-1]) == 0
    return _strings(words.data[used], np.concatenate([[0], np.cumsum(used)])[words.offs])


def _spans(words: Words, keep: np.ndarray) -> pa.Array:
    """Each row's maximal intervals of removed words, [begin, end)."""
    row = words.rows()
    gone = ~keep
    same = np.concatenate([[False], (row[1:] == row[:-1]) & gone[:-1]])[: len(row)]
    begin = np.flatnonzero(gone & ~same)
    go_on = np.concatenate([same[1:] & gone[1:], [False]])[: len(row)]
    end = np.flatnonzero(gone & ~go_on) + 1
    offsets = np.searchsorted(row[begin], np.arange(len(words.n) + 1)).astype(np.int32)
    base = words.first[row[begin]]
    pairs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int64)), pa.array((end - base).astype(np.int64))], names=["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _cut_repeats(k: int, names: list[str], joined: bool):
    """Texts and reports of a document bucket -> rows with their kept text."""

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        found = [unpack(p) for p in reports.column("payload")]
        doc = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(column(r, "doc")) for r in found]])
        start = np.concatenate([np.zeros(0, np.int32), *[column(r, "start") for r in found]])
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        out = []
        for payload in texts.column("payload"):
            table = unpack(payload).combine_chunks()
            ids = _ids(table.column("doc_id").combine_chunks())
            data, offs = column_bytes(table.column("text"))
            for lo, hi in row_slices(offs):
                words = Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], SPACE_WORDS)
                a, b = np.searchsorted(doc, ids[lo:hi], "left"), np.searchsorted(doc, ids[lo:hi], "right")
                row = np.repeat(np.arange(hi - lo), b - a)
                s = start[np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
                fits = s + k <= words.n[row]
                at = words.first[row[fits]] + s[fits]
                step = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + k, -1)
                keep = np.cumsum(step[:-1]) == 0
                removed = np.concatenate([[0], np.cumsum(~keep)])[words.first]
                own = table.slice(lo, hi - lo)
                out.append(pa.table({
                    **{n: own.column(n) for n in names},
                    "n_words": pa.array(words.n.astype(np.int64)), "n_removed": pa.array(np.diff(removed)),
                    "spans": _spans(words, keep), "kept": (joined_words if joined else cut_text)(words, keep),
                }))
        if not out:
            return pa.table({})
        return pa.concat_tables(out)

    return run


def substring_dedup(docs: DataFrame, k: int = 20, carry: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """(doc_id, carry..., n_words, n_removed, spans, kept): `kept` is the text without the words that
    a repeated window of k words covers; with `joined` its words stand one space apart, else the
    white space between kept words is as it was."""
    spark = docs.sparkSession
    docs, carry = apart(docs, carry, ("doc_id", "text", "n_words", "n_removed", "spans", "kept"))
    names = ["doc_id", "text", *carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`") for c in carry])
    n = bucket_count(spark, text_bytes(docs), BUCKET_BYTES)
    candidates = docs.select("doc_id", "text").mapInArrow(_hash_windows(k, n), "bucket int, doc_bucket int, payload binary")
    reports = candidates.repartition(n, "bucket").groupBy("bucket").applyInArrow(_find_repeats(n), "bucket int, payload binary")
    texts = docs.mapInArrow(_pack_texts(n), "bucket int, payload binary")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return (
        texts.repartition(n, "bucket").groupBy("bucket")
        .cogroup(reports.repartition(n, "bucket").groupBy("bucket"))
        .applyInArrow(_cut_repeats(k, [c for c in names if c != "text"], joined),
                      f"{kept}, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept string")
    )
