"""Lexical and positional differences between paired outputs (SURVEY §2.3 J5-J6, §2.4 A16,
§2.5 W2-W4, §2.8 C6-C8).

A pair, its two texts and its alignment block are one row.  A task codes the tokens of a block of
pairs as integers, and alignment, span expansion, exactness, re-indexing and distortion are array
operations over all tokens of the block at once: sorts, running counts and look-ups by place, with
the pair as part of the key.  Without an alignment file nothing is shuffled; with one, the only
shuffle attaches it (J4).  The scores are expressions over the arrays of a pair.

Alignment spans are 0-based, `start1:len1` on side 1 and `start2:len2` on side 2.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import materialize, tokens
from .chunks import improved
from .joins import attach_alignment

SPAN_TYPE = "array<struct<start1:int,len1:int,start2:int,len2:int>>"
BLOCK_CHARS = 1 << 20  # of the pairs that are looked at together; a longer pair is a block of its own


def _coded(*columns: pa.Array):
    """Columns of token arrays -> their sides, with the same code for the same token, and the number of codes."""
    flat = [c.flatten() for c in columns]  # a null array has no tokens
    words = pa.concat_arrays(flat).dictionary_encode()
    codes = words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.cumsum([0, *[len(x) for x in flat]])
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    return [_Side.of_codes(n, codes[lo:hi]) for n, lo, hi in zip(sizes, cut, cut[1:])], len(words.dictionary) + 1


class _Side:
    """The tokens of one side of some pairs: `code`, `pair` and `place` of each, `n` of each pair."""

    def __init__(self, token_lists: list[list], known: dict):
        n = np.array([len(t) for t in token_lists], np.int64)
        self._set(n, np.fromiter((known.setdefault(w, len(known)) for t in token_lists for w in t), np.int64, int(n.sum())))

    @classmethod
    def of_codes(cls, n: np.ndarray, code: np.ndarray):
        side = cls.__new__(cls)
        side._set(n, code)
        return side

    def _set(self, n: np.ndarray, code: np.ndarray):
        self.n, self.code = n, code
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.pair = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.code)) - self.first[self.pair]

    def occurrence(self) -> np.ndarray:
        """How often the token stands in its pair before."""
        order = np.lexsort((self.place, self.code, self.pair))
        code, pair = self.code[order], self.pair[order]
        new = np.ones(len(order), bool)
        new[1:] = (code[1:] != code[:-1]) | (pair[1:] != pair[:-1])
        start = np.flatnonzero(new)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return out


# ------------------------------------------------------------------ J6 exact alignment

def _by_occurrence(one: _Side, two: _Side, n_codes: int):
    """(flat place on side 1, on side 2): the n-th occurrence of a token to its n-th on the other side."""
    longest = int(max(one.n.max(initial=1), two.n.max(initial=1)))
    names = [(s.pair * n_codes + s.code) * longest + s.occurrence() for s in (one, two)]
    _, at1, at2 = np.intersect1d(*names, assume_unique=True, return_indices=True)
    order = np.argsort(at1, kind="stable")
    return at1[order], at2[order]


SHORT, BEAM_SHORT, BEAM = 16, 256, 32  # states that are followed for a first matching, for sides of up to SHORT tokens and beyond
CANDIDATES = 8  # places that a state tries for a token; all of them, if it has no more


def fewest_chunks(left: list, right: list) -> list[tuple[int, int]]:
    """A matching of equal tokens with as many links as there can be, in as few chunks as can be (runs that
    are neighbours on both sides), then with as few crossings.

    A first matching comes from dynamic programming from left to right over (places used, place of the link just
    before), which follows the best states only (a beam) and tries CANDIDATES places of a token at most.  The search
    of `chunks.py`, which leaves out nothing that could be better, then proves it best or finds the best one.
    """
    shared = set(left) & set(right)
    mine, other = ([(i, w) for i, w in enumerate(side) if w in shared] for side in (left, right))
    return _fewest_chunks(mine, other, max(len(left), len(right)), len(left))


def _fewest_chunks(left: list[tuple], right: list[tuple], longest: int, end: int) -> list[tuple[int, int]]:
    """`fewest_chunks` of the (place, token) that the other side has too; `longest` of the sides, `end` of the left."""
    return improved(left, right, _first_matching(left, right, longest, end))


def _first_matching(left: list[tuple], right: list[tuple], longest: int, end: int) -> list[tuple[int, int]]:
    """A matching with as many links as there can be, and mostly few chunks and crossings."""
    beam = BEAM_SHORT if longest <= SHORT else BEAM
    places: dict = {}
    for j, w in right:
        places.setdefault(w, []).append(j)
    ahead: dict = {}  # occurrences on the left that are still to come
    for _, w in left:
        ahead[w] = ahead.get(w, 0) + 1
    # (used, place of the link of the token just before or -1) -> (chunks, crossings, links so far)
    states: dict = {(0, -1): (0, 0, None)}

    def best() -> dict:
        return dict(sorted(states.items(), key=lambda kv: kv[1][:2])[:beam]) if len(states) > beam else states

    def apart() -> dict:
        """Behind tokens that stand on the left only: no link just before."""
        nxt: dict = {}
        for (used, _), value in best().items():
            if (used, -1) not in nxt or value[:2] < nxt[used, -1][:2]:
                nxt[used, -1] = value
        return nxt

    at = 0
    for i, w in left:
        if i > at:
            states = apart()
        at = i + 1
        ahead[w] -= 1
        states = best()
        if len(states) == 1 and len(places[w]) == 1 and not ahead[w]:
            ((used, last), (chunks, crossings, links)), (j,) = *states.items(), places[w]
            if not used >> j & 1:  # the one link there can be
                states = {(used | 1 << j, j): (chunks + (last < 0 or j != last + 1), crossings + (used >> (j + 1)).bit_count(), (links, i, j))}
                continue
        nxt: dict = {}
        for (used, last), (chunks, crossings, links) in states.items():
            free = [j for j in places[w] if not used >> j & 1]
            wanted = len(free)  # that many links of the token are still to be made
            if len(free) > CANDIDATES:
                behind = [j for j in free if j > last]
                free = sorted({*free[: CANDIDATES // 2], *behind[: CANDIDATES // 2]})
            options = [((used | 1 << j, j), (chunks + (last < 0 or j != last + 1), crossings + (used >> (j + 1)).bit_count(), (links, i, j))) for j in free]
            if wanted <= ahead[w]:  # the token may go without: enough others follow
                options.append(((used, -1), (chunks, crossings, links)))
            for state, value in options:
                if state not in nxt or value[:2] < nxt[state][:2]:
                    nxt[state] = value
        states = nxt
    if end > at:
        states = apart()
    links = min(states.values(), key=lambda v: v[:2])[2]
    out = []
    while links:
        links, i, j = links
        out.append((i, j))
    return out[::-1]


def _by_chunks(one: _Side, two: _Side, n_codes: int):
    """As `_by_occurrence` where a pair has no choice (its shared tokens stand once on either side)."""
    keys, counts = zip(*(np.unique(s.pair * n_codes + s.code, return_counts=True) for s in (one, two)))
    both, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    choice = np.zeros(len(one.n), bool)
    choice[both[(counts[0][i] > 1) | (counts[1][j] > 1)] // n_codes] = True
    at1, at2 = _by_occurrence(one, two, n_codes)
    plain = ~choice[one.pair[at1]]
    of, to = [at1[plain]], [at2[plain]]
    sides = []
    for s in (one, two):  # the shared tokens of pairs with a choice
        at = np.flatnonzero(choice[s.pair] & np.isin(s.pair * n_codes + s.code, both))
        sides.append((s.place[at].tolist(), s.code[at].tolist(), np.searchsorted(s.pair[at], np.arange(len(s.n) + 1))))
    for k in np.flatnonzero(choice):
        a, b = (list(zip(place[first[k] : first[k + 1]], code[first[k] : first[k + 1]])) for place, code, first in sides)
        links = np.array(_fewest_chunks(a, b, max(one.n[k], two.n[k]), one.n[k]), np.int64).reshape(-1, 2)
        of.append(one.first[k] + links[:, 0])
        to.append(two.first[k] + links[:, 1])
    at1, at2 = np.concatenate(of), np.concatenate(to)
    order = np.argsort(at1, kind="stable")
    return at1[order], at2[order]


LINKS = {"occurrence": _by_occurrence, "chunks": _by_chunks}


def exact_align(pairs: DataFrame, key: str = "pair_id", t1: str = "t1", t2: str = "t2", method: str = "occurrence") -> DataFrame:
    """J6 [H]: links between equal tokens of two token arrays, as many as there can be.

    `occurrence` links the n-th occurrence of a token on side 1 to its n-th occurrence on side 2;
    `chunks` chooses among the occurrences by `fewest_chunks`.  Output: one span row
    (key, start1, len1=1, start2, len2=1) per link.  No shuffle.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            (one, two), n_codes = _coded(batch.column(1), batch.column(2))
            at1, at2 = LINKS[method](one, two, n_codes)
            ones = np.ones(len(at1), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(one.pair[at1])), pa.array(one.place[at1].astype(np.int32)), pa.array(ones),
                 pa.array(two.place[at2].astype(np.int32)), pa.array(ones)], names=["key", "start1", "len1", "start2", "len2"])

    links = pairs.select(key, t1, t2).mapInArrow(run, f"key {kind}, start1 int, len1 int, start2 int, len2 int")
    return links.withColumnRenamed("key", key)


# ------------------------------------------------------------------ J5 span expansion, W2, W3 over a block

class _Spans:
    """Spans of some pairs, in the order of each pair's block."""

    def __init__(self, lists: list):
        self.pair = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
        flat = [s for x in lists for s in x or ()]
        self.start = [np.array([s[f"start{k}"] for s in flat], np.int64) for k in (1, 2)]
        self.size = [np.array([s[f"len{k}"] for s in flat], np.int64) for k in (1, 2)]

    def covered(self, side: _Side, k: int):
        """(span, flat place) for each place of side k that a span covers."""
        size = np.maximum(self.size[k], 0)
        span = np.repeat(np.arange(len(size)), size)
        place = self.start[k][span] + np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
        inside = (place >= 0) & (place < side.n[self.pair[span]])
        return span[inside], (side.first[self.pair[span]] + place)[inside]


def _identical(spans: _Spans, one: _Side, two: _Side) -> np.ndarray:
    """If the tokens of a span are the same on both sides."""
    (s1, at1), (s2, at2) = spans.covered(one, 0), spans.covered(two, 1)
    n = len(spans.pair)
    n1, n2 = np.bincount(s1, minlength=n), np.bincount(s2, minlength=n)
    same = n1 == n2
    keep1, keep2 = same[s1], same[s2]
    differ = one.code[at1[keep1]] != two.code[at2[keep2]]  # span by span, place by place
    return same & (np.bincount(s1[keep1], differ, n) == 0)


def _align(side: _Side, spans: _Spans, k: int, ident: np.ndarray, punct: set):
    """(align, exact) by flat place: `align` is the place on the other side for the head token of a span, -1
    inside a phrase, -2 where there is none (or for a head in the punctuation set); `exact` says that the
    whole span equals the other side's.  A later span goes over an earlier one."""
    align, exact = np.full(len(side.code), -2, np.int64), np.zeros(len(side.code), bool)
    span, at = spans.covered(side, k)
    of = np.full(len(side.code), -1, np.int64)
    of[at] = span  # of several spans the last stays
    mine = np.flatnonzero(of >= 0)
    span = of[mine]
    head = side.place[mine] == spans.start[k][span]
    align[mine] = np.where(head, spans.start[1 - k][span], -1)
    if punct:
        align[mine[head & np.isin(side.code[mine], list(punct))]] = -2
    exact[mine] = ident[span]
    return align, exact


def _dense(side: _Side, align: np.ndarray) -> np.ndarray:
    """The number of an aligned head token among those of its pair, -1 for the others."""
    head = align >= 0
    total = np.concatenate([[0], np.cumsum(head)])
    return np.where(head, total[:-1] - total[side.first[side.pair]], -1)


def _lists(side_first: np.ndarray, values: np.ndarray, kind, null=None) -> pa.Array:
    flat = pa.array(values).cast(kind) if null is None else pa.array(values, mask=null).cast(kind)
    return pa.ListArray.from_arrays(pa.array(side_first.astype(np.int32)), flat)


_ARRAYS = "a1 array<int>, e1 array<boolean>, a2 array<int>, e2 array<boolean>, x1 array<int>, x2 array<int>, dist array<int>"


def _arrays(texts1: list, texts2: list, blocks: list | None, punct: str, method: str, with_tokens: bool) -> dict:
    known: dict = {}
    lists = [[t.encode().split() for t in texts] for texts in (texts1, texts2)]  # the white space of `tokens`
    one, two = (_Side(x, known) for x in lists)
    if blocks is None:
        at1, at2 = LINKS[method](one, two, max(len(known), 1))
        a1, a2 = np.full(len(one.code), -2, np.int64), np.full(len(two.code), -2, np.int64)
        a1[at1], a2[at2] = two.place[at2], one.place[at1]
        e1, e2 = a1 >= 0, a2 >= 0
        if punct:  # out of the alignment, but still matched
            of = [known[c.encode()] for c in set(punct) if c.encode() in known]
            a1[np.isin(one.code, of)] = -2
            a2[np.isin(two.code, of)] = -2
    else:
        spans = _Spans(blocks)
        ident = _identical(spans, one, two)
        of = {known[c.encode()] for c in set(punct) if c.encode() in known}
        (a1, e1), (a2, e2) = _align(one, spans, 0, ident, of), _align(two, spans, 1, ident, of)
    x1, x2 = _dense(one, a1), _dense(two, a2)
    heads = np.flatnonzero(a1 >= 0)  # W3: index on side 2 less index on side 1, for each head of side 1
    pair, to = one.pair[heads], a1[heads]
    inside = to < two.n[pair]
    other = np.where(inside, x2[np.where(inside, two.first[pair] + to, 0)] if len(x2) else -1, -1)
    first = np.searchsorted(pair, np.arange(len(texts1) + 1))
    out = {}
    if with_tokens:
        names = pa.array(list(known), pa.binary()).cast(pa.string())
        for c, s in (("t1", one), ("t2", two)):
            out[c] = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), names.take(pa.array(s.code)))
    for c, s, a, e in ((1, one, a1, e1), (2, two, a2, e2)):
        out[f"a{c}"] = _lists(s.first, a, pa.int32(), a == -2)
        out[f"e{c}"] = _lists(s.first, e, pa.bool_())
    out["x1"], out["x2"] = _lists(one.first, x1, pa.int32(), x1 < 0), _lists(two.first, x2, pa.int32(), x2 < 0)
    out["dist"] = _lists(first, other - x1[heads], pa.int32(), other < 0)
    return out


def align_tokens(
    pairs: DataFrame, alignments: DataFrame | None = None, key: str = "pair_id", text1: str = "text1",
    text2: str = "text2", punct: str = "", lower: bool = False, method: str = "occurrence", with_tokens: bool = True,
) -> DataFrame:
    """(key, t1, t2, a1, e1, a2, e2, x1, x2, dist): tokens, alignment and exactness by position (J5),
    dense index over aligned heads (W2) and distortion (W3) of each pair; the token arrays are left
    out without `with_tokens`.

    align[i] = aligned position on the other side for the head token of a span, -1 for a
    token inside a phrase, null when unaligned (or a head that is in the punctuation set);
    exact[i] = the whole span equals the other side's span.  A head whose target is no head on
    side 2 has a null distortion (the pair is invalid).  A null text has no tokens.
    """
    text = lambda c: F.coalesce(F.lower(F.col(c)) if lower else F.col(c), F.lit(""))
    kind = pairs.schema[key].dataType.simpleString()
    rows = pairs.select(F.col(key), text(text1).alias("_a"), text(text2).alias("_b"))
    if alignments is not None:
        rows = attach_alignment(rows, alignments, key)
    else:
        rows = rows.withColumn("spans", F.lit(None).cast(SPAN_TYPE))
    given = alignments is not None

    def run(batches):
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = np.cumsum([0, *[len(x) + len(y) for x, y in zip(a, b)]])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + BLOCK_CHARS, "right")) - 1)
                blocks = batch.column(3).slice(lo, hi - lo).to_pylist() if given else None
                out = _arrays(a[lo:hi], b[lo:hi], blocks, punct, method, with_tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *out.values()], names=["key", *out])
                lo = hi

    schema = f"key {kind}, " + "t1 array<string>, t2 array<string>, " * with_tokens + _ARRAYS
    return rows.select(key, "_a", "_b", "spans").mapInArrow(run, schema).withColumnRenamed("key", key)


# ------------------------------------------------------------------ A16, W2-W4

def led_side(exact: Column) -> Column:
    """Share of tokens of one side that are not exactly matched (null for an empty side)."""
    n = F.size(exact)
    return F.when(n > 0, F.size(F.filter(exact, lambda e: ~e)) / n)


def led_score(exact1: Column, exact2: Column) -> Column:
    """Mean over both sides of the non-matched token share."""
    return (led_side(exact1) + led_side(exact2)) / F.lit(2.0)


def reindex_aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """For each new column -> align array: the dense 0-based index over aligned head tokens by
    position (null for the others)."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in columns] + [(c, "array<int>") for c in columns]

    def index(align: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(align), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        head = pc.fill_null(align.flatten(), -1).to_numpy(zero_copy_only=False) >= 0
        before = np.concatenate([[0], np.cumsum(head)])
        place = before[:-1] - np.repeat(before[first[:-1]], n)
        values = pa.array(place.astype(np.int32), mask=~head)
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values, mask=align.is_null() if align.null_count else None)

    def run(batches):
        for batch in batches:
            made = {c: index(batch.column(a)) for c, a in columns.items()}
            given = {c: batch.column(c) for c, _ in kinds if c not in columns}
            yield pa.RecordBatch.from_pydict(given | made)

    return df.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in kinds))


def distortion(align1: Column, index1: Column, index2: Column) -> Column:
    """index2 - index1 for each aligned head of side 1, in side-1 order (the arrays of W2).

    A head whose target is not a head on side 2 yields null (the pair is invalid).
    """
    own = F.filter(F.transform(index1, lambda r, p: F.struct(r.alias("r"), F.try_element_at(align1, p + 1).alias("to"))), lambda x: x["r"].isNotNull())
    return F.transform(own, lambda x: (F.try_element_at(index2, x["to"] + 1) - x["r"]).cast("int"))


def pod_score(dist: Column) -> Column:
    """Cut whenever the running sum is 0; sum of max|d| per closed cut / N (0 when N = 0)."""
    acc0 = F.struct(F.lit(0).alias("cum"), F.lit(0).alias("mx"), F.lit(0).alias("tot"))

    def step(acc, d):
        cum = acc["cum"] + d
        mx = F.greatest(acc["mx"], F.abs(d))
        closed = cum == 0
        return F.struct(
            cum.alias("cum"),
            F.when(closed, F.lit(0)).otherwise(mx).alias("mx"),
            F.when(closed, acc["tot"] + mx).otherwise(acc["tot"]).alias("tot"),
        )

    n = F.size(dist)
    total = F.aggregate(dist, acc0, step, lambda a: a["tot"])
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ C6-C8

def prepare_pairs(pairs: DataFrame, text1: str = "text1", text2: str = "text2", lower: bool = False) -> DataFrame:
    """Token arrays `t1`, `t2` (optionally lower-cased, as the reference's `-l`)."""
    a, b = F.col(text1), F.col(text2)
    if lower:
        a, b = F.lower(a), F.lower(b)
    return materialize(pairs, {"t1": tokens(a), "t2": tokens(b)})  # read per span / index below


def lepod(
    pairs: DataFrame, alignments: DataFrame | None = None, key: str = "pair_id", text1: str = "text1",
    text2: str = "text2", punct: str = "", lower: bool = False, detail: bool = False, method: str = "occurrence",
) -> DataFrame:
    """Per-pair LeD and PoD.

    `alignments` (key, start1, len1, start2, len2) as read by `read_alignments`; without
    it the exact alignment (J6) is built.  Output: key, led, pod, valid, skipped (+ the
    detail columns of C7 when `detail`).  Invalid pairs (unequal aligned lengths, a head
    pointing at a non-head) get null scores and valid = false; a pair with an empty side
    is skipped (null scores), as SURVEY §7.2 decides.  `method` is J6's.
    """
    p = align_tokens(pairs, alignments, key, text1, text2, punct, lower, method, with_tokens=detail)
    skipped = (F.size("e1") == 0) | (F.size("e2") == 0)
    n_heads = lambda c: F.size(F.filter(c, lambda r: r.isNotNull()))
    valid = (n_heads("x1") == n_heads("x2")) & ~F.exists("dist", lambda x: x.isNull())
    led = F.when(~skipped & valid, led_score(F.col("e1"), F.col("e2")))
    pod = F.when(~skipped & valid, pod_score(F.col("dist")))
    out = p.withColumns({"led": led, "pod": pod, "valid": valid & ~skipped, "skipped": skipped})
    cols = [key, "led", "pod", "valid", "skipped"]
    if detail:
        out = out.withColumns(lepod_detail_cols())
        cols += ["mat1", "sub1", "mat2", "sub2"]
    return out.select(*cols)


def lepod_detail_cols() -> dict[str, Column]:
    """Matched (aligned, incl. in-phrase) and substituted (not exact) tokens per side."""
    def pick(t, arr, pred):
        return F.array_join(F.filter(t, lambda x, i: pred(F.try_element_at(arr, i + 1))), " ")

    return {
        "mat1": pick(F.col("t1"), F.col("a1"), lambda a: a.isNotNull()),
        "sub1": pick(F.col("t1"), F.col("e1"), lambda e: ~e),
        "mat2": pick(F.col("t2"), F.col("a2"), lambda a: a.isNotNull()),
        "sub2": pick(F.col("t2"), F.col("e2"), lambda e: ~e),
    }


def lepod_detail(pairs: DataFrame, alignments: DataFrame | None = None, **kw) -> DataFrame:
    """Per pair the MAT / SUB token lists of both sides, with the scores."""
    return lepod(pairs, alignments, detail=True, **kw)


def score_summary(scored: DataFrame) -> DataFrame:
    """A1: mean / min / max of LeD and PoD over the scored (valid) pairs."""
    v = scored.filter("valid")
    return v.agg(
        F.avg("led").alias("led_mean"), F.min("led").alias("led_min"), F.max("led").alias("led_max"),
        F.avg("pod").alias("pod_mean"), F.min("pod").alias("pod_min"), F.max("pod").alias("pod_max"),
    )


def nonzero_summary(scored: DataFrame) -> DataFrame:
    """A2: pairs read; non-zero LeD, non-zero PoD and all-zero counts with percentages."""
    v = scored.filter("valid")
    agg = v.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("led") > 0).alias("n_nonzero_led"),
        F.count_if(F.col("pod") > 0).alias("n_nonzero_pod"),
        F.count_if((F.col("led") == 0) & (F.col("pod") == 0)).alias("n_all_zero"),
    )
    pct = lambda c: F.when(F.col("n_pairs") > 0, F.round(F.col(c) * 100.0 / F.col("n_pairs"), 2))
    return agg.withColumns({
        "pct_nonzero_led": pct("n_nonzero_led"), "pct_nonzero_pod": pct("n_nonzero_pod"), "pct_all_zero": pct("n_all_zero"),
    })


def lepod_report(scored: DataFrame) -> DataFrame:
    """One summary row (A1 + A2 + counts of skipped and invalid pairs) from one pass."""
    valid = F.col("valid")
    led, pod = F.col("led"), F.col("pod")
    agg = scored.agg(
        F.count_if(valid).alias("n_pairs"),
        F.count_if(F.col("skipped")).alias("n_skipped"),
        F.count_if(~valid & ~F.col("skipped")).alias("n_invalid"),
        F.avg(F.when(valid, led)).alias("led_mean"), F.min(F.when(valid, led)).alias("led_min"),
        F.max(F.when(valid, led)).alias("led_max"),
        F.avg(F.when(valid, pod)).alias("pod_mean"), F.min(F.when(valid, pod)).alias("pod_min"),
        F.max(F.when(valid, pod)).alias("pod_max"),
        F.count_if(valid & (led > 0)).alias("n_nonzero_led"),
        F.count_if(valid & (pod > 0)).alias("n_nonzero_pod"),
        F.count_if(valid & (led == 0) & (pod == 0)).alias("n_all_zero"),
    )
    pct = lambda c: F.when(F.col("n_pairs") > 0, F.round(F.col(c) * 100.0 / F.col("n_pairs"), 2))
    return agg.withColumns({
        "pct_nonzero_led": pct("n_nonzero_led"), "pct_nonzero_pod": pct("n_nonzero_pod"), "pct_all_zero": pct("n_all_zero"),
    })


def expand_spans(scored_pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """J5 long form of `align_tokens`: one row per token (key, side, pos, token, align, exact)."""
    side = lambda k: F.struct(F.lit(k).alias("side"), F.arrays_zip(F.col(f"t{k}").alias("token"), F.col(f"a{k}").alias("align"),
                                                                   F.col(f"e{k}").alias("exact")).alias("rows"))
    both = scored_pairs.select(key, F.inline(F.array(side(1), side(2))))  # the pairs are aligned once for both sides
    return both.select(key, "side", F.posexplode("rows").alias("pos", "z")).select(key, "side", "pos", "z.token", "z.align", "z.exact")
