"""Operator 1: exact n-gram Jaccard join, size-aware (heavy sets and light sets).

A document is the set of its word shingles.  Two sets link when their Jaccard similarity reaches
3/4 (`LINK`).  Equal sets are one set from the start.  A set of n shingles that links with any
other shares at least ceil(3n/4) shingles with it, so in any common order of all shingles their
prefixes of floor(n/4) + j shingles share j or more.  The order puts shingles that many sets hold
last (the heaviest FREQUENT of them are known to all tasks; the order never changes the result).

* Light sets (up to a boundary size) enumerate every 2-element subset of their prefix; two of
  them are candidates when they share a subset.
* Heavy sets scan the inverted lists of their prefix shingles, in which light sets of fitting
  size are entered too.
* An entry knows how many shingles its set can share if the key's are the first that it shares;
  members that no size in their list fits leave it, so a passage that many documents hold, but that
  is too short to link them, makes no candidates.
* The boundary is the size at which enumerating subsets costs more than entering and scanning.
* A shingle whose list has more than LONG members is a repeated one.  The members of such lists enter
  once more by an order that has repeated shingles (a bitmap of fixed size) behind all others but the
  FREQUENT ones; lists of passages that do not make up most of a set are gone then, and what is left
  are short lists and groups of sets that consist of repeated text.

Lists of two are candidate pairs.  A member of longer lists is compared with one centre of about its
size first, the least by a hash of all that its lists have; components of the verified links follow.  Members outside their list's largest
component are compared with other centres of it in further rounds; in the last round those that
are still outside are compared with all others of the list, so no link is lost, and a group of
thousands of near copies costs a few comparisons each, not one for each pair.  The lists of a passage
have nearly the same members, so open lists whose member of least hash is the same are compared as one
bundle: each pair once, however many lists hold it, and only pairs that may link become rows.  A candidate
whose shingle counts by part differ too much cannot link; all others are verified on the whole texts.

Null and empty texts, and texts without words, are empty sets and link with nothing (component:
the document itself).  Repeated rows are equal sets.  A null doc_id never names a component unless
all its members have none.  Only doc_id and text are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (LOWER, SPACE_WORDS, Words, bucket_count, column, column_bytes, drop_shared, mix, pack, rolling,
                     row_slices, shared_table, unpack)
from .components import components

SHINGLE = 5
LINK = (3, 4)  # intersection : union
FREQUENT = 1 << 16  # shingles known as frequent; a bounded table, sent to all tasks
GATHER_BYTES = 1 << 24  # text in which a task counts shingles before it reports the frequent ones
REPORT_AT = 5
BUCKET_BYTES = 16 << 20
LONG = 16  # members of longer lists enter again, with the shingle of the list behind others
BITMAP_BITS = 25  # repeated shingles are known by a bitmap of so many bits (log2); others with the same bit count as repeated
HOT_LIST = 100_000  # lists known to be longer are never gathered in one task
PART_BITS, MOST_PART_BITS = 8, 13  # counts by 256 to 8 192 parts, by the size of a set
LARGEST_BOUNDARY = 64
CENTRES = 4  # centres of a list's size class in each of these rounds
BLOCK = 256  # members of a bundle of lists that are compared with as many others in one task
GATHER_ROWS = 4096  # members of small bundles that go to one task
COUNTS_AT_ONCE = 1 << 20  # counts by part that are compared at once
ROUNDS = 4  # rounds of comparisons in lists that are still open; the last one compares all that is open
NO_ID = -(1 << 63)  # stands for a null doc_id inside


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingles in ascending order."""
    n = np.where(words.n >= k, words.n - k + 1, words.n > 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)
    h = rolling(words.hashes(), at, at + np.minimum(words.n, k)[row])
    cut = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]


def set_keys(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set, in two numbers that don't depend on the order."""
    with np.errstate(over="ignore"):
        return mix(_sums(mix(flat + np.uint64(1)), offs)).astype(np.int64), mix(_sums(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), offs)).astype(np.int64)


def _part_counts(flat: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Shingles of each set by part, 255 at most: 2**PART_BITS parts, more for larger sets: one for two to four shingles."""
    out = []
    for a, b in zip(offs[:-1], offs[1:]):
        bits = min(max(int(b - a - 1).bit_length() - 1, PART_BITS), MOST_PART_BITS)
        count = np.bincount((flat[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        out.append(np.minimum(count, 255).astype(np.uint8).tobytes())
    return out


def _apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only: the difference of their counts by part."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    n = min(len(a), len(b))  # parts are by leading bits, so neighbours make the parts of fewer bits
    return int(np.abs(a.reshape(n, -1).sum(axis=1) - b.reshape(n, -1).sum(axis=1)).sum())


def _chunks(batch):
    """(first row, last row, words) of the parts of a batch whose column 1 is the text."""
    data, offs = column_bytes(batch.column(1))
    for lo, hi in row_slices(offs):
        yield lo, hi, Words(LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], SPACE_WORDS)


FACTS = "kind int, doc_id long, n long, hi long, lo long, parts binary"


def _facts(batches):
    """kind 0: a document's set; kind 1: a shingle (hi) that n gathered sets hold; kind 2: shingles
    (n) and different ones (hi) of a gathering."""

    def frequent(gathered):
        flat, count = np.unique(np.concatenate(gathered), return_counts=True)
        keep = count >= REPORT_AT
        n = int(keep.sum())
        none = pa.nulls(n + 1, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.full(n, 1), 2), pa.int32()), none, pa.array(np.append(count[keep], count.sum())),
             pa.array(np.append(flat[keep].astype(np.int64), len(flat))), none, pa.nulls(n + 1, pa.binary())],
            names=["kind", "doc_id", "n", "hi", "lo", "parts"])

    gathered, size = [], 0
    for batch in batches:
        for lo, hi, words in _chunks(batch):
            flat, offs = shingle_sets(words)
            a, b = set_keys(flat, offs)
            parts = _part_counts(flat, offs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)),
                 pa.array(a), pa.array(b), pa.array(parts, pa.binary())],
                names=["kind", "doc_id", "n", "hi", "lo", "parts"])
            if len(flat):
                first = np.unique(a, return_index=True)[1]  # equal sets count once
                gathered += [flat[offs[r] : offs[r + 1]] for r in first]
            size += len(words.data)
            if size >= GATHER_BYTES and gathered:
                yield frequent(gathered)
                gathered, size = [], 0
    if gathered:
        yield frequent(gathered)


def least_shared(n: int) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-LINK[0] * n // LINK[1])


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The set size up to which enumerating 2-subsets is cheaper than entering and scanning lists.

    sizes: sets of each size (larger ones together under LARGEST_BOUNDARY + 1)."""
    single = lambda n: n - least_shared(n) + 1

    def cost(bound: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= bound:
                q = single(n) + 1
                entered = single(n) if LINK[1] * n >= LINK[0] * (bound + 1) else 0
                total += count * (q * (q - 1) / 2 + entered)
            else:
                total += count * single(n) * (1 + list_length)
        return total

    return min(range(2, LARGEST_BOUNDARY + 1), key=cost)


def _enter(frequent, boundary: int, n_buckets: int):
    """Texts -> packed list entries (key, set, n, most) by key bucket; bucket -1: entries of hot lists.

    most: the largest size of a set that can link if the key holds the first shingles that both share.  Of a
    set of n whose key ends at place p (from 0) at most n - p - 1 shingles follow, and a link with a set of
    m needs 3 (n + m) / 7 shared ones."""

    def prefixes(flat, offs, rows, known):
        """(row, keys, shingles that can be shared) of every set; even keys are single shingles, odd keys 2-subsets."""
        names, ranks, seen, repeated = known
        heavy = seen[(flat & np.uint64(len(seen) - 1)).astype(np.int64)]
        at = np.flatnonzero(heavy)
        place = np.minimum(np.searchsorted(names, flat[at]), max(len(names) - 1, 0))
        rank = np.full(len(flat), -1, np.int64)
        if repeated is not None:
            bit = (mix(flat) >> np.uint64(1)) & np.uint64((1 << BITMAP_BITS) - 1)
            rank[(repeated[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1] = 0
        if len(names):
            true = names[place] == flat[at]
            rank[at[true]] = ranks[place[true]] + 1
        heavy = rank >= 0
        has_heavy = np.add.reduceat(np.append(heavy, False).astype(np.int64), np.minimum(offs[:-1], len(flat))) * (np.diff(offs) > 0)
        for r in rows:
            a, b = offs[r], offs[r + 1]
            n = int(b - a)
            small = n <= boundary
            p = n - least_shared(n) + 1
            if has_heavy[r]:
                s, k = flat[a:b], rank[a:b]
                s = s[np.argsort(k, kind="stable")] if (k >= 0).any() else s
            else:
                s = flat[a : a + p + 1]
            if not small or LINK[1] * n >= LINK[0] * (boundary + 1):
                yield r, mix(s[:p]) & ~np.uint64(1), n - np.arange(len(s[:p]))
            if small:
                s = s[: p + 1]
                i, j = np.triu_indices(len(s), 1)
                with np.errstate(over="ignore"):
                    yield r, mix(s[i] * np.uint64(0x9E3779B97F4A7C15) + s[j]) | np.uint64(1), n - j + 1

    def run(batches):
        names, ranks, hot, repeated = frequent.value
        seen = np.zeros(1 << 20, bool)
        seen[(names & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        waiting, size = [], 0

        def sent():
            key, owner, n, most = (np.concatenate([w[k] for w in waiting]) for k in range(4))
            bucket = ((key >> np.uint64(1)) % np.uint64(n_buckets)).astype(np.int32)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                bucket[hot[place] == key] = -1
            order = np.lexsort((owner, bucket))
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                i = order[a:b]
                rows.append((int(bucket[i[0]]), pack(key=key[i], owner=owner[i], n=n[i], most=most[i])))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "payload"])

        for batch in batches:
            for _, _, words in _chunks(batch):
                flat, offs = shingle_sets(words)
                a, _ = set_keys(flat, offs)
                first = np.unique(a, return_index=True)[1]
                rows = first[np.diff(offs)[first] > 2]  # sets of one or two link with equal sets only
                for r, keys, shared in prefixes(flat, offs, rows, (names, ranks, seen, repeated)):
                    n = int(offs[r + 1] - offs[r])
                    most = (shared * (LINK[0] + LINK[1]) // LINK[0] - n).astype(np.int32)
                    waiting.append((keys, np.full(len(keys), a[r]), np.full(len(keys), n, np.int32), most))
                    size += len(keys)
                if size >= 1 << 20:
                    yield sent()
                    waiting, size = [], 0
        if waiting:
            yield sent()

    return run


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return LINK[1] * np.minimum(a, b) >= LINK[0] * np.maximum(a, b)


ENTRIES = "bucket int, payload binary"
def may_link(n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of n shingles together, `apart` or more of them in one set only, can link."""
    return (n - apart) * (LINK[0] + LINK[1]) >= 2 * LINK[0] * n  # shared <= (n - apart) / 2


LISTS = "kind int, a long, b long, n int, h long"
WAYS = (0.0, 0.5)  # shifts of the two ways to cut sizes into classes whose ends have ratio 4 : 3


def size_class(n: np.ndarray, shift: float) -> np.ndarray:
    return np.floor(np.log(n.astype(float)) / np.log(LINK[1] / LINK[0]) + shift).astype(np.int64)


def stars(where: np.ndarray, owner: np.ndarray, n: np.ndarray):
    """(owner, centre, way, order) of the members of lists `where`: each member with one centre of about its size.  A
    centre is the least of its list and size class by a hash, so lists mostly agree on it; of all the centres
    that a member has in its lists it keeps the least, for each way."""
    out = []
    for way, shift in enumerate(WAYS):
        order = mix(owner.astype(np.uint64) ^ mix(np.full(1, way + 1, np.uint64))) >> np.uint64(1)
        cls = size_class(n, shift)
        by = np.lexsort((order, cls, where))
        new = np.ones(len(by), bool)
        new[1:] = (where[by][1:] != where[by][:-1]) | (cls[by][1:] != cls[by][:-1])
        centre = by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by
        keep = (owner[by] != owner[centre]) & fits(n[by], n[centre])
        member, centre = by[keep], centre[keep]
        least = np.lexsort((order[centre], owner[member]))
        member, centre = member[least], centre[least]
        first = np.ones(len(member), bool)
        first[1:] = owner[member][1:] != owner[member][:-1]
        out.append((owner[member[first]], owner[centre[first]], np.full(int(first.sum()), way, np.int32), order[centre[first]].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out)]


def can_link(begin: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of lists that begin at `begin`: the members that the sizes allow a partner in their list."""
    if not len(begin):
        return np.zeros(0, bool)
    size = np.diff(np.append(begin, len(n)))
    lowest = np.repeat(np.minimum.reduceat(n, begin), size)
    highest = np.repeat(np.maximum.reduceat(most, begin), size)
    return (lowest <= most) & (n <= highest)


def _lists(boundary: int, longest: int | None = None):
    """A bucket of entries -> kind 0: candidate pairs (a, b) of lists of two; kind 1: the members b,
    of n shingles, of the longer lists a, each list of the same members once; kind 2: a member a of
    longer lists with its centre b by way n, whose order is h.  Lists of one shingle with more than
    `longest` members come as kind 3: their key a; kind 4: a member a of any of them."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload")]
        key, owner, n, most = (np.concatenate([column(p, c) for p in parts]) for c in ("key", "owner", "n", "most"))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.concatenate([[False], same])] if len(order) else order
        order = order[np.lexsort((owner[order], n[order], key[order]))]
        key, owner, n, most = key[order], owner[order], n[order], most[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)]
        key, owner, n, most = key[new], owner[new], n[new], most[new]
        for _ in range(3):  # who leaves may leave others without a partner
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            stay = can_link(begin, n, most)
            key, owner, n, most = key[stay], owner[stay], n[stay], most[stay]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        size = np.diff(np.append(begin, len(key)))
        two = begin[size == 2]
        other = (n[two + 1] > boundary) | (key[two] & np.uint64(1) == 1)  # light pairs come from subsets
        two = two[fits(n[two], n[two + 1]) & other & (n[two] <= most[two + 1]) & (n[two + 1] <= most[two])]
        x, y = owner[two], owner[two + 1]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        many = size > 2
        single = key[begin] & np.uint64(1) == 0
        long = single & (size > longest) if longest else np.zeros(len(size), bool)
        with np.errstate(over="ignore"):
            name = _sums(mix(owner.astype(np.uint64)), np.append(begin, len(key)))[many]
        keys = key[begin][long].astype(np.int64)
        name, first = np.unique(name, return_index=True)
        b, s, again = begin[many][first], size[many][first], long[many][first]
        at = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(b, s)
        member, centre, way, rank = stars(np.repeat(np.arange(len(s)), s), owner[at], n[at])
        again, name = np.repeat(again, s), np.repeat(name, s)
        more = np.unique(owner[at][again])
        at, name = at[~again], name[~again]
        none = lambda *parts: np.zeros(sum(map(len, parts)), np.int64)
        return pa.table({
            "kind": pa.array(np.repeat(np.arange(5), [len(pairs), len(at), len(member), len(keys), len(more)]), pa.int32()),
            "a": pa.array(np.concatenate([pairs[:, 0], name.astype(np.int64), member, keys, more])),
            "b": pa.array(np.concatenate([pairs[:, 1], owner[at], centre, none(keys, more)])),
            "n": pa.array(np.concatenate([none(pairs), n[at], way, none(keys, more)]), pa.int32()),
            "h": pa.array(np.concatenate([none(pairs, at), rank, none(keys, more)])),
        })

    return run


def _hot_entries(batches):
    """Packed entries of hot lists -> kind 1 rows."""
    for batch in batches:
        for payload in batch.column(0):
            p = unpack(payload)
            n = p.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), pa.array(column(p, "key").astype(np.int64)), pa.array(column(p, "owner")), pa.array(column(p, "n"), pa.int32()),
                 pa.array(column(p, "most"), pa.int64())],
                names=["kind", "a", "b", "n", "h"])


def _near_parts(batches):
    """Pairs whose counts by part allow a link: |x \\ y| + |y \\ x| is at least the sum of differences."""
    for batch in batches:
        if not len(batch):
            continue
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        apart = np.array([_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())])
        keep = may_link(n, apart)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def _verify(batches):
    """(a, b, text_a, text_b) -> the pairs that link; a text must be the one of its set."""

    def sets(column_):
        data, offs = column_bytes(column_)
        for lo, hi in row_slices(offs):
            flat, cut = shingle_sets(Words(LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], SPACE_WORDS))
            names = set_keys(flat, cut)[0]
            for r in range(hi - lo):
                yield names[r], flat[cut[r] : cut[r + 1]]

    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        keep = np.zeros(len(batch), bool)
        for i, ((x, s), (y, t)) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)))):
            if x == a[i] and y == b[i]:
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = LINK[1] * shared >= LINK[0] * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names that link, verified on whole texts."""
    side = lambda x: sets.select(F.col("hi").alias(x), F.col("n").alias(f"n_{x}"), F.col("parts").alias(f"parts_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "parts_a", "parts_b")
    near = shared_table(near.mapInArrow(_near_parts, "a long, b long").distinct(), "near")
    side = lambda x: texts.select(F.col("hi").alias(x), F.col("text").alias(f"text_{x}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    links = shared_table(both.mapInArrow(_verify, "a long, b long").distinct(), "links")
    drop_shared(pairs.sparkSession, near)
    return links


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies): component_id is the smallest doc_id that is
    reachable by links; copies is the number of rows with the same set."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    facts = shared_table(keyed.mapInArrow(_facts, FACTS), "sets")
    rows = facts.filter("kind = 0").select("doc_id", "n", "hi", "lo", "parts")
    sets = rows.filter("n > 0").groupBy("hi", "lo", "n").agg(
        F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("first_id"), F.count("*").alias("copies"), F.first("parts").alias("parts"))
    sets = shared_table(sets, "sets")

    sizes = {r.n: r.count_ for r in sets.groupBy(F.least("n", F.lit(LARGEST_BOUNDARY + 1)).alias("n")).agg(F.count("*").alias("count_")).collect()}
    total, different = facts.filter("kind = 2").agg(F.sum("n"), F.sum("hi")).first()
    boundary = choose_boundary(sizes, (total or 1) / (different or 1))
    counted = facts.filter("kind = 1").groupBy("hi").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "hi").limit(FREQUENT).collect()  # bounded by FREQUENT
    name = np.array([r.hi for r in top], np.int64).astype(np.uint64)
    count = np.array([r.n for r in top], np.int64)
    order = np.argsort(name)
    rank = np.argsort(np.argsort(count, kind="stable"), kind="stable")
    hot = np.sort(mix(name[count > HOT_LIST]) & ~np.uint64(1))
    known = (name[order], rank[order], hot)

    n = bucket_count(spark, int(total or 0) * 7, BUCKET_BYTES)
    entries = keyed.select("doc_id", "text").mapInArrow(_enter(spark.sparkContext.broadcast((*known, None)), boundary, n), ENTRIES)
    if len(hot):
        entries = shared_table(entries, "entries")
    lists = entries.filter("bucket >= 0").repartition(n, "bucket").groupBy("bucket").applyInArrow(_lists(boundary, LONG), LISTS)
    if len(hot):
        hot_rows = entries.filter("bucket = -1").select("payload").mapInArrow(_hot_entries, LISTS)
        range_ = hot_rows.groupBy("a").agg(F.min("n").alias("lowest"), F.max("h").alias("highest"))  # `can_link` for rows
        hot_rows = hot_rows.join(F.broadcast(range_), "a").filter("lowest <= h AND n <= highest")  # a row for each hot list
        hot_rows = shared_table(hot_rows.select("kind", "a", "b", "n", "h"), "hot")
        lists = lists.unionByName(hot_rows)
    lists = shared_table(lists, "lists")
    again = lists.filter("kind = 4").select(F.col("a").alias("hi"))
    found = [lists]
    owners = _listed(lists).withColumn("again", F.lit(False)).union(again.withColumn("again", F.lit(True))).groupBy("hi").agg(F.max("again").alias("again"))
    wanted = owners.join(sets.select("hi", "rep"), "hi")
    texts = shared_table(keyed.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep").select("hi", "text", "again"), "texts")
    if again.limit(1).count():
        # hot lists have the same members in both orders, as the FREQUENT shingles are last in both
        enter = _enter(spark.sparkContext.broadcast((*known, _repeated(lists))), boundary, n)
        entries_2 = texts.filter("again").select("hi", "text").mapInArrow(enter, ENTRIES).filter("bucket >= 0")
        found.append(shared_table(entries_2.repartition(n, "bucket").groupBy("bucket").applyInArrow(_lists(boundary), LISTS), "lists"))
        lists = lists.union(found[1])
    starred = lists.filter("kind = 2").groupBy("a", "n").agg(F.min(F.struct("h", "b")).alias("c")).select(*_pair("a", "c.b"))
    pairs = lists.filter("kind = 0").select("a", "b").union(starred)
    if len(hot):
        hot_members = hot_rows.select(F.col("a").alias("list"), F.col("b").alias("owner"), "n").distinct()
        pairs = pairs.union(_star_pairs(hot_members, hot_members, 0))
    pairs = pairs.distinct()
    members = lists.filter("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("owner"), "n").distinct()
    members = shared_table(members, "members")

    links = _links(pairs, sets, texts)
    roots = components(links)
    for r in range(1, ROUNDS + 1):
        open_ = _open_members(members, roots)
        if not open_.limit(1).count():
            break
        inside, outside = open_.filter("root = main"), open_.filter("root <> main")
        pairs = _star_pairs(inside, outside, r).distinct() if r < ROUNDS else _open_pairs(open_, sets)
        more = _links(pairs, sets, texts)
        drop_shared(spark, open_)
        roots = _joined_roots(roots, more)
        drop_shared(spark, more)
    for table in (*found, members, texts, links, *([entries, hot_rows] if len(hot) else [])):
        drop_shared(spark, table)
    return _with_components(rows, sets, roots)


def _listed(lists: DataFrame) -> DataFrame:
    """(hi) of lists of two and of longer ones.  Members and centres of kind 2 are of kind 1 or 4 too; a pair comes
    from each bucket in which it is a list."""
    two = lists.filter("kind = 0").select("a", "b").distinct()
    return two.select(F.explode(F.array("a", "b")).alias("hi")).union(lists.filter("kind = 1").select("b"))


def _repeated(lists: DataFrame) -> np.ndarray:
    """The bitmap of the shingles of long lists, in words of 64 bits."""
    bit = F.shiftrightunsigned("a", 1).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = lists.filter("kind = 3").select(bit.alias("bit")).distinct()
    words = words.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[column(words, "word")] = column(words, "bits").astype(np.uint64)
    return out


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links: only the roots that these join are connected anew."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
    new = components(between).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return shared_table(roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")


def _pair(x, y):
    """The pair (a, b) of two columns, the smaller first."""
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _star_pairs(centres: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """Each member of a list with centres of about its size in the list, for two ways to cut sizes
    into classes whose ends have ratio 4 : 3.  Centres are the least by seeded hashes, others in each
    list, so that a member of many lists meets many; seed 0 is for hot lists, which have one."""
    size = F.log(F.col("n").cast("double")) / float(np.log(LINK[1] / LINK[0]))
    out = None
    for k, shift in enumerate(WAYS):
        named = lambda df: df.withColumn("class", F.floor(size + shift))
        orders = [F.struct(F.xxhash64("owner", "list", F.lit((2 * seed + k) * CENTRES + i)).alias("order"), "owner", "n") for i in range(CENTRES if seed else 1)]
        centre = named(centres).groupBy("list", "class").agg(*[F.min(o).alias(f"c{i}") for i, o in enumerate(orders)])
        centre = centre.select("list", "class", F.explode(F.array(*[f"c{i}" for i in range(len(orders))])).alias("c"))
        pairs = named(members).join(centre, ["list", "class"]).filter("owner <> c.owner")
        pairs = pairs.filter(LINK[1] * F.least("n", "c.n") >= LINK[0] * F.greatest("n", "c.n")).select(*_pair("owner", "c.owner"))
        out = pairs if out is None else out.union(pairs)
    return out


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, owner, n, root, main, bundle) of the lists whose members are in several components; `main` is
    the list's largest one, `bundle` the least hash of its members."""
    own = members.join(roots.withColumnRenamed("node", "owner"), "owner", "left").withColumn("root", F.coalesce("root", "owner"))
    count = own.groupBy("list", "root").agg(F.count("*").alias("size"), F.min(F.xxhash64("owner")).alias("least"))
    main = count.groupBy("list").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("roots"), F.min("least").alias("bundle")).filter("roots > 1")
    return shared_table(own.join(main.select("list", F.col("m.root").alias("main"), "bundle"), "list"), "open")


def _together(owner: np.ndarray, side: np.ndarray, out_of: list, main_of: list) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): the rows x of side 0 and y of side 1 that meet in a list of which x is `out_of`, each pair once."""
    lists = [(name, r, True) for r, names in enumerate(out_of) for name in names]
    lists += [(name, r, False) for r, names in enumerate(main_of) for name in names]
    name, row, outside = (np.array(x, t) for x, t in zip(zip(*lists), (np.int64, np.int64, bool)))
    order = np.argsort(name, kind="stable")
    name, row, outside = name[order], row[order], outside[order]
    place = np.where(side == 0, np.cumsum(side == 0), np.cumsum(side == 1)) - 1
    few, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    meet = np.zeros((len(few), len(every)), bool)
    cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:]):
        r, out = row[a:b], outside[a:b]
        x, y = r[out & (side[r] == 0)], r[side[r] == 1]
        meet[np.ix_(place[x], place[y])] |= ~out[side[r] == 1] | (owner[x][:, None] < owner[y])
    x, y = np.nonzero(meet)
    return few[x], every[y]


def _compare(table: pa.Table) -> pa.Table:
    """Of some bundles, the members outside the largest component of one of their lists (side 0) and all members
    (side 1), or a block of either of one bundle -> the pairs of different components in a list whose sizes and
    counts by part allow a link."""
    bundle, side, owner, n, root = (column(table, c) for c in ("bundle", "side", "owner", "n", "root"))
    parts, out_of, main_of = (table.column(c).to_pylist() for c in ("parts", "out_of", "main_of"))
    order, out = np.argsort(bundle, kind="stable"), [np.zeros((0, 2), np.int64)]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(bundle[order]) != 0, [True]]))
    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        x, y = _together(owner[rows], side[rows], [out_of[r] for r in rows], [main_of[r] for r in rows])
        fit = (root[rows[x]] != root[rows[y]]) & fits(n[rows[x]], n[rows[y]])
        x, y = x[fit], y[fit]
        size = np.array([len(parts[r]) for r in rows])
        least = np.minimum(size[x], size[y])
        for k in np.unique(least):
            i, j = x[least == k], y[least == k]
            used = np.unique(np.concatenate([i, j]))
            counts = np.stack([np.frombuffer(parts[r], np.uint8).reshape(k, -1).sum(axis=1, dtype=np.int32) for r in rows[used]])
            for at in range(0, len(i), max(1, COUNTS_AT_ONCE // int(k))):
                u, v = (p[at : at + max(1, COUNTS_AT_ONCE // int(k))] for p in (i, j))
                apart = np.abs(counts[np.searchsorted(used, u)] - counts[np.searchsorted(used, v)]).sum(axis=1)
                near = may_link(n[rows[u]] + n[rows[v]], apart)
                u, v = owner[rows[u[near]]], owner[rows[v[near]]]
                out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _open_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member outside its list's largest component with all members of other components: the pairs that may link.

    A bundle of lists with more than BLOCK members is compared in blocks of about BLOCK x BLOCK, smaller ones
    go several to a task."""
    out = F.col("root") != F.col("main")
    own = open_.groupBy("bundle", "owner", "n", "root").agg(
        F.collect_list(F.when(out, F.col("list"))).alias("out_of"), F.collect_list(F.when(~out, F.col("list"))).alias("main_of"))
    own = own.withColumn("outside", F.size("out_of") > 0)
    blocks = lambda x: F.ceil(F.sum(x) / BLOCK).cast("int")
    count = own.groupBy("bundle").agg(blocks(F.col("outside").cast("int")).alias("n_out"), blocks(F.lit(1)).alias("n_every"))
    own = own.join(count, "bundle").join(sets.select(F.col("hi").alias("owner"), "parts"), "owner")
    block = lambda x: F.pmod(F.xxhash64("owner"), F.col(f"n_{x}")).cast("int").alias(x)
    each = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"n_{x}") - 1)).alias(x)
    small = (F.col("n_out") == 1) & (F.col("n_every") == 1)
    groups = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), open_.count() // GATHER_ROWS)
    rows = ["bundle", "owner", "n", "root", "out_of", "main_of", "parts", F.when(small, F.pmod("bundle", F.lit(groups))).otherwise(F.col("bundle")).alias("group"), small.alias("small")]
    outside = own.filter("outside").select(F.lit(0).alias("side"), *rows, block("out"), each("every"))
    every = own.select(F.lit(1).alias("side"), *rows, each("out"), block("every"))
    near = outside.unionByName(every).groupBy("group", "small", "out", "every").applyInArrow(_compare, "a long, b long")
    return near.distinct()


def _with_components(rows: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    named = sets.join(roots.select(F.col("node").alias("hi"), "root"), "hi", "left").withColumn("root", F.coalesce("root", "hi"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(smallest, "root").select("hi", "lo", "component_id", "copies")
    out = rows.select("doc_id", "n", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", doc_id).alias("component_id"),
                      F.coalesce("copies", F.lit(1)).alias("copies"))
