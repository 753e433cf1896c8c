"""Operator 2: benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents of about SHARD_BYTES of text.  Its words become numbers, each
document ends with a mark of its own, and the suffixes are sorted by prefix doubling (only groups
that are still tied are sorted again).  The Burrows-Wheeler transform is kept as a wavelet tree,
level by level; every benchmark window is searched backward with two ranks a word, all windows at
once, and occurrences are located by walking back to a sampled suffix position.  Occurrences are
merged into removal spans.  No row is shuffled.

Benchmark windows are sent to the tasks in blocks of about BLOCK_BYTES of item text; a larger
benchmark takes several passes, whose spans are put together for each document.

Null and empty texts have no words and hold nothing; an item without words has no window; an item
shorter than a window is one window.  Items that share an item_id count as one, a null item_id as
the empty string.  Repeated documents are searched one by one.  Only doc_id, text, the columns in
`carry`, item_id and the items' text are read; a carried column that is named like one of the
result or of HELPERS comes back as <name>_carried.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER, Words, apart, column_bytes, rolling, row_slices, text_bytes, windows

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 8  # every so many places of a shard keep their suffix position


def lower_words(text) -> Words:
    data, offs = column_bytes(text)
    return Words(LOWER[data], offs, ALNUM_WORDS)


def sort_suffixes(sym: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; the last symbol stands nowhere else."""
    n = len(sym)
    base = int(sym.max()) + 2
    ahead = np.zeros(n + 3, np.int64)
    ahead[:n] = sym + 1
    depth = max(1, min(3, int(62 // np.log2(base))))
    key = ahead[:n].copy()
    for d in range(1, depth):
        key = key * base + ahead[d : n + d]
    rank = np.zeros(n, np.int64)
    tied, old = np.arange(n), None
    while len(tied):
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(tied))
        place = old + at - at[group][np.cumsum(group) - 1]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = place[new][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        follow = tied + depth
        key = rank[tied] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Backward search and location in a sequence of small whole numbers, for many patterns at once."""

    def __init__(self, sym: np.ndarray):
        n = self.n = len(sym)
        suffix = sort_suffixes(sym)
        self.bwt = sym[suffix - 1]
        self.sigma = int(sym.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=self.sigma))])
        marked = suffix % SAMPLE == 0
        self.marked, self.sampled = marked, suffix[marked]
        self.marked_rank = np.cumsum(marked) - 1
        self.levels = []
        rest = self.bwt
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            one = (rest >> bit) & 1 == 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, n - int(ones[-1])))
            rest = np.concatenate([rest[~one], rest[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands in the transform before place i[k]."""
        begin = np.zeros(len(c), np.int64)
        for bit, ones, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            a, b = ones[begin], ones[i]
            begin = np.where(one, zeros + a, begin - a)
            i = np.where(one, zeros + b, i - b)
        return i - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, lo, hi) of the patterns that occur; -1 in a pattern is a symbol that doesn't."""
        alive = np.flatnonzero((patterns >= 0).all(axis=1))
        c = patterns[alive, -1]
        lo, hi = self.before[c], self.before[c + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[alive, k]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
        return alive, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position of each suffix, by its row in suffix order."""
        out = np.empty(len(row), np.int64)
        left, steps = np.arange(len(row)), 0
        while len(left):
            done = self.marked[row]
            out[left[done]] = self.sampled[self.marked_rank[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.bwt[row]
            row = self.before[c] + self.rank(c, row)
            steps += 1
        return out


class BenchmarkWindows:
    """Distinct windows of some items, by length, and the items that hold each."""

    def __init__(self, ids: list[str], texts: list[str | None], k: int):
        words = lower_words(pa.array(texts, pa.large_string()))
        self.names = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.names)}
        item = np.array([number[x] for x in ids], np.int64)
        hashes = words.hashes()
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        self.groups = []  # (window words, items of window: offsets and values)
        for m in range(1, k + 1):
            row, at = windows(words.first, m)
            if m < k:
                at, row = at[words.n[row] == m], row[words.n[row] == m]
            if not len(at):
                continue
            key = rolling(hashes, at, at + m)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            holder = np.unique(np.stack([which, item[row]], axis=1), axis=0)
            self.groups.append((word[at[first][:, None] + np.arange(m)], np.searchsorted(holder[:, 0], np.arange(len(first) + 1)), holder[:, 1]))


def search_shard(words: Words, bench: BenchmarkWindows) -> tuple[np.ndarray, np.ndarray]:
    """(hit by word, unique (row, item) pairs) of one shard."""
    n, rows = len(words.start), len(words.n)
    hit, pairs = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
    if n and bench.groups:
        distinct, word = np.unique(words.hashes(), return_inverse=True)
        sym = np.empty(n + rows, np.int64)
        mark = words.first[1:] + np.arange(rows)  # each document ends with a mark of its own
        is_word = np.ones(n + rows, bool)
        is_word[mark] = False
        sym[mark], sym[is_word] = np.arange(rows), rows + word
        row_of = np.repeat(np.arange(rows), words.n + 1)
        at = np.minimum(np.searchsorted(distinct, bench.vocabulary), len(distinct) - 1)
        symbol = np.where(distinct[at] == bench.vocabulary, rows + at, -1)
        index = None
        for window, begin, holder in bench.groups:
            pattern = symbol[window]
            if not (pattern >= 0).all(axis=1).any():
                continue
            index = index or FMIndex(sym)
            found, lo, hi = index.search(pattern)
            count = hi - lo
            which = np.repeat(found, count)
            place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            place = index.locate(place)
            row = row_of[place]
            np.add.at(hit, place - row, 1)
            np.add.at(hit, place - row + pattern.shape[1], -1)
            held = np.unique(np.stack([row, which], axis=1), axis=0)
            size = begin[held[:, 1] + 1] - begin[held[:, 1]]
            item = holder[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[held[:, 1]], size)]
            pairs.append(np.stack([np.repeat(held[:, 0], size), item], axis=1))
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def removal_spans(words: Words, hit: np.ndarray) -> pa.Array:
    """Each row's maximal runs of hit words, [begin, end)."""
    row = words.rows()
    joined = np.concatenate([[False], (row[1:] == row[:-1]) & hit[:-1] & hit[1:]])[: len(row)]
    begin = np.flatnonzero(hit & ~joined)
    end = np.flatnonzero(hit & ~np.append(joined[1:], False)[: len(row)]) + 1
    offsets = np.searchsorted(row[begin], np.arange(len(words.n) + 1)).astype(np.int32)
    base = words.first[row[begin]]
    pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def without_hits(words: Words, raw: np.ndarray, hit: np.ndarray) -> pa.Array:
    """Each row's text without its removal spans (from a span's first letter to its last)."""
    row = words.rows()
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, words.start[hit], 1)
    np.add.at(step, words.end[hit], -1)
    linked = np.flatnonzero(hit[1:] & hit[:-1] & (row[1:] == row[:-1])) if len(row) else np.zeros(0, int)
    np.add.at(step, words.end[linked], 1)
    np.add.at(step, words.start[linked + 1], -1)
    used = np.cumsum(step[:-1]) == 0
    offs = np.concatenate([[0], np.cumsum(used)])[words.offs]
    kind, offsets = (pa.string(), np.int32) if offs[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(offsets)), pa.py_buffer(np.ascontiguousarray(raw[used]))])


def _search(bench, names: list[str], only_hits: bool, clean: bool):
    """Rows -> rows with n_words, n_hit, items, spans (and the text without the spans)."""

    def run(batches):
        known = bench.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            data, offs = column_bytes(batch.column("text"))
            for lo, hi in row_slices(offs, SHARD_BYTES):
                raw = data[offs[lo] : offs[hi]]
                words = Words(LOWER[raw], offs[lo : hi + 1] - offs[lo], ALNUM_WORDS)
                hit, pairs = search_shard(words, known)
                total = np.concatenate([[0], np.cumsum(hit)])[words.first]
                cut = np.searchsorted(pairs[:, 0], np.arange(hi - lo + 1))
                items = [[known.names[x] for x in pairs[a:b, 1]] for a, b in zip(cut[:-1], cut[1:])]
                own = {n: table.column(n).slice(lo, hi - lo) for n in names}
                own |= {"n_words": pa.array(words.n.astype(np.int64)), "n_hit": pa.array(np.diff(total)),
                        "items": pa.array(items, pa.list_(pa.string())), "spans": removal_spans(words, hit)}
                if clean:
                    own["kept"] = without_hits(words, raw, hit)
                out = pa.table(own)
                if only_hits:
                    out = out.filter(pa.array(np.diff(total) > 0))
                yield from out.combine_chunks().to_batches()

    return run


HELPERS = ("text", "text_key", "found_id", "found_key")
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 10, carry: tuple[str, ...] = (),
                  clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, carry..., n_words, n_hit, items, spans[, kept]): `items` are the item_ids, sorted as
    strings, of which a window occurs; `kept` (with `clean`) is the text without the spans."""
    spark = docs.sparkSession
    docs, carry = apart(docs, carry, ("doc_id", "n_words", "n_hit", "items", "spans", "kept", *HELPERS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`") for c in carry])
    names = ["doc_id", *carry]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    blocks = max(1, -(-text_bytes(items) // block_bytes))

    def block(b: int):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # bounded: one block of the stated query set
        return spark.sparkContext.broadcast(BenchmarkWindows([r.item_id for r in rows], [r.text for r in rows], k))

    if blocks == 1:
        return docs.mapInArrow(_search(block(0), names, False, clean), f"{kept}, {FOUND}" + ", kept string" * clean)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("text_key", key)
    found = None
    for b in range(blocks):
        part = keyed.select("doc_id", "text_key", "text").mapInArrow(
            _search(block(b), ["doc_id", "text_key"], True, False), f"doc_id long, text_key long, {FOUND}")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    both = keyed.join(found, keyed.doc_id.eqNullSafe(found.found_id) & (keyed.text_key == found.found_key), "left")
    return both.select(*names, "text", "items", "spans").mapInArrow(
        _merge_spans(names, clean), f"{kept}, {FOUND}" + ", kept string" * clean)


def _merge_spans(names: list[str], clean: bool):
    """Spans of several passes -> the union of each row's spans."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            data, offs = column_bytes(batch.column("text"))
            for lo, hi in row_slices(offs, SHARD_BYTES):
                raw = data[offs[lo] : offs[hi]]
                words = Words(LOWER[raw], offs[lo : hi + 1] - offs[lo], ALNUM_WORDS)
                step = np.zeros(len(words.start) + 1, np.int64)
                spans = batch.column("spans").slice(lo, hi - lo).to_pylist()
                for row, own in enumerate(spans):
                    for s in own or ():
                        step[words.first[row] + s["begin"]] += 1
                        step[words.first[row] + s["end"]] -= 1
                hit = np.cumsum(step[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])[words.first]
                own = {n: table.column(n).slice(lo, hi - lo) for n in names}
                own |= {"n_words": pa.array(words.n.astype(np.int64)), "n_hit": pa.array(np.diff(total)),
                        "items": pa.array([x or [] for x in batch.column("items").slice(lo, hi - lo).to_pylist()], pa.list_(pa.string())),
                        "spans": removal_spans(words, hit)}
                if clean:
                    own["kept"] = without_hits(words, raw, hit)
                yield from pa.table(own).combine_chunks().to_batches()

    return run
