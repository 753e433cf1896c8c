"""Operator 12: suffix-array dedup - every byte covered by a `length`-byte string that stands elsewhere too.

Suffixes of all bytes would be many times the input, so the array is sparse: every window of
`length` bytes has one anchor, the gram of smallest hash in it (the leftmost of equal ones), and only
suffixes that start at anchors are sorted.  Equal windows have their anchor at the same place, so
none is lost: a window is repeated if another suffix agrees with its own for the bytes from the
anchor on, and for the bytes before the anchor too.

1. Tasks find the anchors of their texts.  Anchors are dealt out by the hash of their gram; those
   whose gram stands once are out.  A task sends one anchor per gram, the others are known repeats.
2. Texts and repeated anchors meet by document bucket.  An item is the text that the windows of one
   anchor cover; equal items of a task are sent once, with the list of their places.
3. Items are range-partitioned by the leading bytes of their suffix, by splitters from a sample of
   suffixes.  A bucket sorts its suffixes, and the reversed texts before the anchors, by multikey
   quicksort, eight bytes a step.  Common prefixes of neighbours then tell for every distance
   between window and anchor which windows are equal.
4. Across boundaries: a window whose part from the anchor on is a prefix of a splitter next to its
   bucket may have its equal in another bucket.  Those windows (one per bucket and content) are
   compared by their hash.
5. Texts meet the removed spans by document bucket and are cut.

A hot passage is one item per task where its surroundings agree; where they differ its items are
split by the splitters, which are whole suffixes and so fall inside the group.  A text is whatever
bytes its UTF-8 has; a null text counts as empty; a text shorter than a window is kept whole.  Every
row is a document of its own: repeated rows remove each other, whatever their doc_id, which may be
null.  Rows are known by a 64-bit hash of doc_id and text.  Only doc_id, text and the columns
named in `carry` are read; a carried column that is named like one of the result comes back as
`<name>_carried`.  An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, column, column_bytes, mix, pack, rolling, row_slices, text_bytes, unpack, windows

BUCKET_BYTES = 6 << 20  # text whose windows make up one bucket
PIECE_BYTES = 1 << 19  # text whose windows are looked at together
BLOCK_ANCHORS = 1 << 18  # anchors whose repeats are found before the shuffle
SAMPLE_EACH = 16  # sampled suffixes for each bucket
SAMPLE_MOST = 1 << 18  # of these at most; they are collected, `length` bytes each
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_MULTIPLIER = 0xD6E8FEB86659FD93
_LOW = np.uint64(0xFFFFFFFF)


def gram_bytes(length: int) -> int:
    """Bytes of a gram: a power of two, a sixth of the window or less."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` bytes, by doubling."""
    h, size, by = _BYTE[data], 1, _MULTIPLIER
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * np.uint64(by) + h[size:]
            by, size = by * by & ((1 << 64) - 1), 2 * size
        return mix(h)


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours, by running minima from both ends of blocks of k."""
    n = len(x) - k + 1
    padded = np.full(-(-len(x) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, k)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[k - 1 : k - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int):
    """(row, hash, anchor, first, last): windows first..last of a row have the anchor; bytes of `data`."""
    gram = gram_bytes(length)
    row, at = windows(offs, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    least = sliding_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (least[at] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return row[begin], h[anchor[begin]], anchor[begin], at[begin], at[last]


def pieces(offs: np.ndarray, length: int, limit: int = PIECE_BYTES):
    """(first row, row offsets of the piece) in bytes; a very long text comes in several pieces that share length - 1 bytes."""
    for lo, hi in row_slices(offs, limit):
        if offs[hi] - offs[lo] <= 2 * limit or hi - lo > 1:
            yield lo, offs[lo : hi + 1]
            continue
        for a in range(int(offs[lo]), int(offs[hi]) - length + 1, limit):
            yield lo, np.array([a, min(a + limit + length - 1, int(offs[hi]))])


def _anchor_columns(batch: pa.RecordBatch, length: int):
    """(key, hash, anchor, first, last) of a batch's anchors, in bytes of their text."""
    key = batch.column(0).to_numpy(zero_copy_only=False)
    data, offs = column_bytes(batch.column(1))
    for lo, cut in pieces(offs, length):
        row, h, *places = anchors(data[cut[0] : cut[-1]], cut - cut[0], length)
        base = cut[0] - offs[lo + row]
        yield key[lo + row], h, *[p + base for p in places], data, offs[lo + row]


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def _runs(sorted_keys: np.ndarray):
    cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, int)
    return zip(cut[:-1], cut[1:])


def _batch(rows: list, **kinds) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _by_bucket(key: np.ndarray, n: int, **columns):
    """(document bucket, packed rows), sorted by key."""
    bucket = _bucket(key, n)
    order = np.lexsort((key, bucket))
    bucket = bucket[order]
    for a, b in _runs(bucket):
        i = order[a:b]
        yield int(bucket[a]), pack(key=key[i], **{name: c[i] for name, c in columns.items()})


# 1. anchors whose gram stands more than once


def _find_anchors(length: int, n: int):
    """Texts -> (bucket, doc_bucket, payload): one anchor per gram by hash bucket (doc_bucket null), and known repeats."""

    def block_rows(parts):
        key, h, anchor, first, last = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.argsort(h, kind="stable")
        hs = h[order]
        new = np.ones(len(hs), bool)
        new[1:] = hs[1:] != hs[:-1]
        many = ~(new & np.append(new[1:], True))
        i = order[many]
        for b, payload in _by_bucket(key[i], n, anchor=anchor[i], first=first[i], last=last[i]):
            yield b, b, payload
        i, several = order[new], many[new]
        bucket = (h[i] % np.uint64(n)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        for a, b in _runs(bucket[by]):
            j = i[by[a:b]]
            yield int(bucket[by[a]]), None, pack(h=h[j], key=key[j], anchor=anchor[j], first=first[j], last=last[j], several=several[by[a:b]])

    def run(batches):
        kinds = {"bucket": pa.int32(), "doc_bucket": pa.int32(), "payload": pa.binary()}
        parts, waiting = [], 0
        for batch in batches:
            for key, h, anchor, first, last, *_ in _anchor_columns(batch, length):
                parts.append((key, h, anchor, first, last))
                waiting += len(h)
                if waiting >= BLOCK_ANCHORS:
                    yield _batch(list(block_rows(parts)), **kinds)
                    parts, waiting = [], 0
        if waiting:
            yield _batch(list(block_rows(parts)), **kinds)

    return run


def _split(table: pa.Table):
    """Packed rows for this bucket, and those that go on to a document bucket."""
    mine, on = [], []
    for doc_bucket, payload in zip(table.column("doc_bucket").to_pylist(), table.column("payload")):
        if doc_bucket is None:
            mine.append(unpack(payload))
        else:
            on.append((doc_bucket, payload.as_py()))
    return mine, on


def _repeated_anchors(n: int):
    """A hash bucket -> its anchors that some other anchor shares the gram with, by document bucket."""

    def run(table: pa.Table) -> pa.Table:
        mine, rows = _split(table)
        if mine:
            h, key, anchor, first, last, several = (np.concatenate([column(p, c) for p in mine]) for c in ("h", "key", "anchor", "first", "last", "several"))
            _, place, count = np.unique(h, return_inverse=True, return_counts=True)
            i = np.flatnonzero((count[place] > 1) & ~several)  # what has several in its task is reported already
            rows += _by_bucket(key[i], n, anchor=anchor[i], first=first[i], last=last[i])
        return pa.Table.from_batches([_batch(rows, bucket=pa.int32(), payload=pa.binary())])

    return run


def _pack_texts(n: int):
    """Rows of a document bucket as one compressed value."""

    def run(batches):
        for batch in batches:
            bucket = _bucket(batch.column(0).to_numpy(zero_copy_only=False), n)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for a, b in _runs(bucket[order]):
                part = batch.take(pa.array(order[a:b]))
                rows.append((int(bucket[order[a]]), pack(**dict(zip(batch.schema.names, part.columns)))))
            yield _batch(rows, bucket=pa.int32(), payload=pa.binary())

    return run


# 2. items


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[begin : begin + size] for each pair, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint8)
    for lo, hi in row_slices(offsets, PIECE_BYTES):
        place = np.arange(offsets[lo], offsets[hi]) + np.repeat(begin[lo:hi] - offsets[lo:hi], size[lo:hi])
        out[offsets[lo] : offsets[hi]] = data[place]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _binary_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _rows_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Matrix of data[begin : begin + size], zero-padded to `width`."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def _width(length: int) -> int:
    return -(-length // 8) * 8


def _suffix_matrix(content: pa.Array, at: np.ndarray, length: int) -> np.ndarray:
    data, offs = _binary_bytes(content)
    return _rows_of(data, offs[:-1] + at, np.diff(offs) - at, _width(length))


def _as_strings(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel()


def _items_of(length: int, splitters):
    """Texts and repeated anchors of a document bucket -> items by range bucket."""

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        found = [unpack(p) for p in reports.column("payload")]
        rows = []
        if found:
            key, anchor, first, last = (np.concatenate([column(p, c) for p in found]) for c in ("key", "anchor", "first", "last"))
            order = np.lexsort((first, key))
            key, anchor, first, last = key[order], anchor[order], first[order], last[order]
            contents, at, keys, firsts = [], [], [], []
            for payload in texts.column("payload"):
                table = unpack(payload).combine_chunks()
                own = column(table, "_key")
                data, offs = column_bytes(table.column("text"))
                a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
                row = np.repeat(np.arange(len(own)), b - a)
                i = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - b, b - a)
                contents.append(_gather(data, offs[row] + first[i], last[i] - first[i] + length))
                at.append(anchor[i] - first[i])
                keys.append(own[row])
                firsts.append(first[i])
            rows = _packed_items(pa.concat_arrays(contents), np.concatenate(at), np.concatenate(keys), np.concatenate(firsts), length, splitters.value)
        return pa.Table.from_batches([_batch(rows, bucket=pa.int32(), payload=pa.binary())])

    return run


def _distinct(content: pa.Array, at: np.ndarray):
    """(distinct contents, their anchors' places, number of each row's content)."""
    coded = content.dictionary_encode()
    which = coded.indices.to_numpy()
    own_at = np.zeros(len(coded.dictionary), np.int64)
    own_at[which] = at  # equal contents have their anchor at the same place
    return coded.dictionary, own_at, which


def _packed_items(content, at, key, first, length, splitters) -> list:
    content, at, which = _distinct(content, at)
    if not len(content):
        return []
    bucket = np.searchsorted(splitters, _as_strings(_suffix_matrix(content, at, length)), "right").astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)  # place of each content in that order
    number[order] = np.arange(len(order))
    place = number[which]
    by = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[by], np.arange(len(order) + 1))
    rows = []
    for a, b in _runs(bucket[order]):
        i = by[cut[a] : cut[b]]
        lists = [pa.ListArray.from_arrays(pa.array((cut[a : b + 1] - cut[a]).astype(np.int32)), pa.array(c[i])) for c in (key, first)]
        rows.append((int(bucket[order[a]]), pack(content=content.take(pa.array(order[a:b])), at=at[order[a:b]], key=lists[0], first=lists[1])))
    return rows


# 3. sorted buckets


def _equal_bytes(difference: np.ndarray) -> np.ndarray:
    """Leading bytes that two words share, from their xor (not zero)."""
    return sum((difference < np.uint64(1 << (8 * i))).astype(np.int64) for i in range(1, 8))


def multikey_sort(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, bytes each row shares with the one before it), eight bytes at a time: rows that
    are equal so far stay in one group, and only groups of several rows are looked at further."""
    n, width = m.shape
    words = m.view(">u8").astype(np.uint64)
    order, shared = np.arange(n), np.zeros(n, np.int64)
    active, group = np.arange(n), np.zeros(n, np.int64)  # places in `order` that are in groups of several
    for j in range(width // 8):
        if len(active) < 2:
            break
        key = words[order[active], j]
        same = group[1:] == group[:-1]
        if (same & (key[1:] != key[:-1])).any():
            by = np.lexsort((key, group))
            order[active] = order[active[by]]
            key = key[by]
            differ = same & (key[1:] != key[:-1])
            at = np.flatnonzero(differ)
            shared[active[at + 1]] = 8 * j + _equal_bytes(key[at + 1] ^ key[at])
            new = np.concatenate([[True], differ | ~same])
            group = np.cumsum(new)
            several = ~(new & np.append(new[1:], True))
            active, group = active[several], group[several]
    if len(active):
        shared[active[1:][group[1:] == group[:-1]]] = width
    return order, shared


def _groups(order: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """The group of each row: rows that share `size` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < size)
    return out


def equal_windows(content: pa.Array, at: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(active, repeated, suffixes): for each item and distance between window and anchor, if there is such a
    window, and if another item (or the same, more than once) has it."""
    data, offs = _binary_bytes(content)
    size = np.diff(offs)
    nearest = length - (size - at)  # distance of the last window that the item covers
    suffixes = _suffix_matrix(content, at, length)
    most = int(at.max(initial=0))
    behind = offs[-1] - (offs[:-1] + at)  # in the reversed bytes, the text before an anchor
    prefixes = _rows_of(data[::-1], behind, at, _width(max(most, 1)))
    right, left = multikey_sort(suffixes), multikey_sort(prefixes)
    distances = np.arange(most + 1)
    active = (nearest[:, None] <= distances) & (distances <= at[:, None])
    repeated = active & (times > 1)[:, None]
    for d in range(most + 1):
        own = np.flatnonzero(active[:, d])
        if len(own) < 2:
            continue
        a = _groups(*right, length - d)[own]
        own = own[np.bincount(a)[a] > 1]
        if len(own) < 2:
            continue
        a, b = _groups(*right, length - d)[own], _groups(*left, d)[own]
        pair = a * (len(content) + 1) + b
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        repeated[own[by[1:][same]], d] = True
        repeated[own[by[:-1][same]], d] = True
    return active, repeated, suffixes


def _shared_with(m: np.ndarray, s: bytes) -> np.ndarray:
    """Leading bytes that each row shares with s."""
    other = np.zeros(m.shape[1], np.uint8)
    other[: len(s)] = np.frombuffer(s, np.uint8)
    differ = m != other
    return np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])


def _decide(length: int, n: int, splitters):
    """A range bucket -> removed spans by document bucket, and windows that may have an equal beyond a boundary."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack(p) for p in table.column("payload")]
        content = pa.concat_arrays([c for p in parts for c in p.column("content").chunks])
        at = np.concatenate([column(p, "at") for p in parts])
        key, first = (pa.concat_arrays([c for p in parts for c in p.column(name).chunks]) for name in ("key", "first"))
        held = np.diff(key.offsets.to_numpy())
        key, first = key.flatten().to_numpy(), first.flatten().to_numpy()
        content, at, which = _distinct(content, at)
        item = np.repeat(which, held)  # of each place
        times = np.bincount(item, minlength=len(content))
        active, repeated, suffixes = equal_windows(content, at, times, length)

        # spans: runs of distances, for each place of an item
        edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        of, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        by = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[by], np.arange(len(content) + 1))
        reach = cut[of + 1] - cut[of]
        span = np.repeat(np.arange(len(of)), reach)
        place = by[np.arange(len(span)) - np.repeat(np.cumsum(reach) - reach - cut[of], reach)]
        anchor = first[place] + at[of[span]]
        begin, end = anchor - (high[span] - 1), anchor - low[span] + length
        rows = [(b, b, p) for b, p in _by_bucket(key[place], n, begin=begin, end=end)]

        # across the boundaries
        s = splitters.value
        known = np.zeros(len(content), np.int64)
        for other in s[max(0, bucket - 1) : bucket + 1]:  # the splitters next to this bucket
            known = np.maximum(known, _shared_with(suffixes, bytes(other)))
        open_ = active & (known[:, None] >= length - np.arange(active.shape[1]))
        i, d = np.nonzero(open_)
        if len(i):
            data, offs = _binary_bytes(content)
            begin = offs[i] + at[i] - d
            h = rolling(_BYTE[data], begin, begin + length)
            decided = repeated[i, d]
            place = by[cut[i]]
            h, one = np.unique(h, return_index=True)  # of several equal windows here, all are decided
            decided, place, i, d = decided[one], place[one], i[one], d[one]
            to = (h % np.uint64(n)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            for a, b in _runs(to[order]):
                j = order[a:b]
                rows.append((int(to[j[0]]), None, pack(h=h[j], decided=decided[j], key=key[place[j]], begin=(first[place] + at[i] - d)[j])))
        return pa.Table.from_batches([_batch(rows, bucket=pa.int32(), doc_bucket=pa.int32(), payload=pa.binary())])

    return run


# 4. windows with equals in other buckets


def _across(length: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        mine, rows = _split(table)
        if mine:
            h, decided, key, begin = (np.concatenate([column(p, c) for p in mine]) for c in ("h", "decided", "key", "begin"))
            _, place, count = np.unique(h, return_inverse=True, return_counts=True)
            i = np.flatnonzero((count[place] > 1) & ~decided)
            rows += _by_bucket(key[i], n, begin=begin[i], end=begin[i] + length)
        return pa.Table.from_batches([_batch(rows, bucket=pa.int32(), payload=pa.binary())])

    return run


# 5. the cut


def _cut(names: list[str]):
    """Texts and spans of a document bucket -> rows with their kept bytes."""

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        found = [unpack(p) for p in reports.column("payload")]
        key, begin, end = (np.concatenate([np.zeros(0, np.int64), *[column(p, c) for p in found]]) for c in ("key", "begin", "end"))
        order = np.argsort(key, kind="stable")
        key, begin, end = key[order], begin[order], end[order]
        out = []
        for payload in texts.column("payload"):
            table = unpack(payload).combine_chunks()
            own = column(table, "_key")
            data, offs = column_bytes(table.column("text"))
            for lo, hi in row_slices(offs):
                a, b = np.searchsorted(key, own[lo:hi], "left"), np.searchsorted(key, own[lo:hi], "right")
                row = np.repeat(np.arange(hi - lo), b - a)
                i = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - b, b - a)
                base, size = offs[lo], int(offs[hi] - offs[lo])
                step = np.zeros(size + 1, np.int32)
                np.add.at(step, offs[lo + row] - base + begin[i], 1)
                np.add.at(step, offs[lo + row] - base + end[i], -1)
                gone = np.cumsum(step[:-1]) > 0
                cuts = offs[lo : hi + 1] - base
                removed = np.concatenate([[0], np.cumsum(gone)])[cuts]
                new = gone.copy()
                new[1:] &= ~gone[:-1]
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                starts = cuts[:-1][(cuts[:-1] < cuts[1:]) & (cuts[:-1] < size)]
                new[starts] = gone[starts]  # a run ends with its text
                stop[starts[1:] - 1] = gone[starts[1:] - 1]
                b0, b1 = np.flatnonzero(new), np.flatnonzero(stop) + 1
                in_row = np.searchsorted(cuts, b0, "right") - 1
                pairs = pa.StructArray.from_arrays([pa.array(b0 - cuts[in_row]), pa.array(b1 - cuts[in_row])], names=["begin", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(b0, cuts).astype(np.int32)), pairs)
                kept = data[base : offs[hi]][~gone]
                kept_offs = (cuts - removed).astype(np.int64)
                part = table.slice(lo, hi - lo)
                out.append(pa.table({
                    **{name: part.column(name) for name in names},
                    "n_bytes": pa.array(np.diff(cuts)), "n_removed": pa.array(np.diff(removed)), "spans": spans,
                    "kept": pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(kept_offs), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.binary()),
                }))
        return pa.concat_tables(out) if out else pa.table({})

    return run


def _sample(length: int, rate: float):
    """Texts -> suffixes at some of their anchors, chosen by place."""

    def run(batches):
        for batch in batches:
            out = []
            for key, _, anchor, _, last, data, base in _anchor_columns(batch, length):
                i = np.flatnonzero(mix(mix(key.astype(np.uint64)) + anchor.astype(np.uint64)) < np.uint64(min(rate, 1) * (2**64 - 2**12)))
                out += [data[base[j] + anchor[j] : base[j] + last[j] + length].tobytes() for j in i]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["suffix"])

    return run


def sampled_splitters(keyed: DataFrame, total: int, n: int, length: int) -> np.ndarray:
    """At most n - 1 sorted suffixes that cut the anchors' suffixes into parts of about equal size."""
    wanted = min(SAMPLE_EACH * n, SAMPLE_MOST)
    there = max(1.0, total / (length - gram_bytes(length) + 1) * 2)
    share = min(1.0, 8 * wanted / there)  # of the documents, so that one document gives a few suffixes
    some = keyed if share == 1 else keyed.sample(share, seed=12)
    found = some.select("_key", "text").mapInArrow(_sample(length, wanted / there / share), "suffix binary")
    suffixes = np.sort(np.array([bytes(r.suffix) for r in found.collect()] or [b""], f"S{_width(length)}"))  # SAMPLE_MOST at most, about
    return np.unique(suffixes[(np.arange(1, n) * len(suffixes)) // n])


def suffix_dedup(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., n_bytes, n_removed, spans, kept): `kept` is what is left of the text's bytes (binary, as a
    cut may fall inside a character), `spans` the maximal removed runs [begin, end) in bytes."""
    spark = docs.sparkSession
    result = ("doc_id", "n_bytes", "n_removed", "spans", "kept")
    inner = [f"_c{i}" for i in range(len(carry))]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "text",
                        *[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner)])
    total = text_bytes(keyed)
    n = bucket_count(spark, total, BUCKET_BYTES)
    splitters = spark.sparkContext.broadcast(sampled_splitters(keyed, total, n, length))
    packed, spread = "bucket int, payload binary", "bucket int, doc_bucket int, payload binary"

    def dealt(df: DataFrame):
        return df.repartition(n, "bucket").groupBy("bucket")

    texts = dealt(keyed.mapInArrow(_pack_texts(n), packed))
    found = dealt(keyed.select("_key", "text").mapInArrow(_find_anchors(length, n), spread)).applyInArrow(_repeated_anchors(n), packed)
    items = texts.cogroup(dealt(found)).applyInArrow(_items_of(length, splitters), packed)
    decided = dealt(items).applyInArrow(_decide(length, n, splitters), spread)
    spans = dealt(decided).applyInArrow(_across(length, n), packed)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name not in ("_key", "text"))
    out = texts.cogroup(dealt(spans)).applyInArrow(
        _cut(["doc_id", *inner]), f"{kept}, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.select("doc_id", *[F.col(i).alias(f"{c}_carried" if c in result else c) for c, i in zip(carry, inner)], *result[1:])
