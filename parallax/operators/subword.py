"""Subword merges: learning and applying a pair-merge table.

Learning (Sennrich et al. 2016) takes the most frequent pair of neighbouring symbols again and again
(count desc, then left, right ascending).  The corpus is read once: `groupBy(word).count()` gives the
word table, which stays distributed.  Merges are learned in rounds, each of many merges:

1. The pair counts are a table; a round adds only the changes of the words that the last merges
   touched.  The most frequent pairs, all those with a count of at least some floor, are called open.
2. Words are cut between symbols that are no open pair.  A pair across such a cut counts less than
   the floor.  Merges on either side put a new symbol in the place of the old one, and the pair
   with it cannot count more; only where a new symbol has the name of another one, the counts of the
   pairs across cuts add up.  So as long as the best pair counts more than (floor - 1) times the
   number of old symbols that end in one name, on either side, the pieces do not affect each other.
3. Equal pieces are summed over all words.  The floor is chosen so that there are at most
   `MOST_PIECES` of them, and one task learns merges from these, one at a time, until that bound is
   reached.  These are exactly the merges that learning on all words gives.
4. The merges are applied to the words, which are written again; a word of one symbol is done.

No task reads all words.  When the words that are left are few, every pair is open and the round is
the last.

Applying.  Tokens are coded as packs (`packs.py`): only the dictionary of a pack meets the segmented
words, which are the distinct words of the corpus, each segmented once.
"""
from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..caches import stage
from ..functions.text import tokens
from .packs import recoded

EOW = "</w>"
MOST_PIECES = 200_000  # distinct pieces that one task learns from
FIRST_OPEN = 1024  # open pairs of the first round, if the words are more than that
MOST_OPEN = 200_000  # open pairs, which every task gets


def word_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct words with counts, both sides jointly."""
    words = None
    for c in cols:
        w = df.select(F.explode(tokens(c)).alias("word"))
        words = w if words is None else words.unionByName(w)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def _merged(syms: list, a, b, new) -> list:
    """Every occurrence of the pair, left to right."""
    out, i = [], 0
    while i < len(syms):
        if syms[i] == a and i + 1 < len(syms) and syms[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


class _Ends:
    """The symbols of the round's start that stand at the ends of what a name may mean now."""

    def __init__(self, earlier):
        self.earlier, self.left, self.right, self.product = earlier, {}, {}, 1

    def merged(self, a: str, b: str) -> None:
        new = a + b
        old = new in self.left or new in self.earlier or (new.endswith(EOW) and len(new) == len(EOW) + 1)
        left, right = self.left.get(a, {a}), self.right.get(b, {b})
        if old:
            left, right = left | self.left.get(new, {new}), right | self.right.get(new, {new})
        self.left[new], self.right[new] = left, right
        self.product = max(map(len, self.left.values())) * max(map(len, self.right.values())) if old else self.product


def learn_merges(pieces, n_merges: int, floor: int = 1, earlier=frozenset()) -> list[tuple[str, str]]:
    """Merges of (symbols, count) rows, one at a time, as long as no pair that counts less than `floor` outside of
    them can come to count as much as the best; `earlier` has the names that earlier rounds made."""
    ends = _Ends(earlier)
    names: list[str] = []
    number: dict[str, int] = {}

    def symbol(name: str) -> int:
        if name not in number:
            number[name] = len(names)
            names.append(name)
        return number[name]

    table, weights = [], []
    count: dict[tuple[int, int], int] = defaultdict(int)
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)  # pieces that hold, or held, a pair
    for piece, n in pieces:
        syms = [symbol(s) for s in piece]
        for pair in zip(syms, syms[1:]):
            count[pair] += n
            holders[pair].append(len(table))
        table.append(syms)
        weights.append(n)
    # an entry is never lower than its pair's count; it is put back where the count has fallen
    heap = [(-n, names[a], names[b], (a, b)) for (a, b), n in count.items()]
    heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < n_merges:
        n, left, right, pair = heappop(heap)
        now = count.get(pair, 0)
        if now != -n:
            if 0 < now < -n:
                heappush(heap, (-now, left, right, pair))
            continue
        if now < floor or now <= (floor - 1) * ends.product:
            break
        merges.append((left, right))
        if floor > 1:
            ends.merged(left, right)
        a, b = pair
        new = symbol(left + right)
        change: dict[tuple[int, int], int] = defaultdict(int)
        for w in holders.pop(pair):
            syms = table[w]
            out = _merged(syms, a, b, new)
            if len(out) == len(syms):
                continue
            for x in zip(syms, syms[1:]):
                change[x] -= weights[w]
            table[w] = out
            for x in zip(out, out[1:]):
                change[x] += weights[w]
                if new in x:
                    holders[x].append(w)
        for x, d in change.items():
            if d:
                count[x] += d
                if count[x] == 0:
                    del count[x]
                    holders.pop(x, None)
                elif d > 0:
                    heappush(heap, (-count[x], names[x[0]], names[x[1]], x))
    return merges


def replay(syms: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges applied in rank order to one word's symbols."""
    while len(syms) > 1:
        best, at = None, -1
        for i, pair in enumerate(zip(syms, syms[1:])):
            k = ranks.get(pair)
            if k is not None and (best is None or k < best):
                best, at = k, i
        if best is None:
            break
        syms = _merged(syms, syms[at], syms[at + 1], syms[at] + syms[at + 1])
    return syms


_PAIRS = "array<struct<left: string, right: string, n: long>>"


def _apply_round(merges):
    """(symbols, cnt) -> (symbols, cnt, change): words after a round's merges and what that changes in the pair counts."""
    pair = pa.struct([("left", pa.string()), ("right", pa.string()), ("n", pa.int64())])
    schema = pa.schema([("symbols", pa.string()), ("cnt", pa.int64()), ("change", pa.list_(pair))])

    def run(batches):
        ranks = {m: k for k, m in enumerate(merges.value)}
        for batch in batches:
            out = []
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                syms, change = text.split(" "), []
                if any(p in ranks for p in zip(syms, syms[1:])):
                    now = replay(syms, ranks)
                    diff: dict[tuple[str, str], int] = defaultdict(int)
                    for p in zip(syms, syms[1:]):
                        diff[p] -= n
                    for p in zip(now, now[1:]):
                        diff[p] += n
                    change = [{"left": a, "right": b, "n": d} for (a, b), d in diff.items() if d]
                    text = " ".join(now)
                out.append({"symbols": text, "cnt": n, "change": change})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _pieces(open_pairs):
    """(symbols, cnt) -> (piece, cnt): words cut where no open pair stands, summed within the task."""

    def run(batches):
        known, total = open_pairs.value, defaultdict(int)

        def emit():
            rows = list(total.items())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["piece", "cnt"])

        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                syms = text.split(" ")
                first = 0
                for i in range(1, len(syms) + 1):
                    if i == len(syms) or (known is not None and (syms[i - 1], syms[i]) not in known):
                        if i - first > 1:
                            total[" ".join(syms[first:i])] += n
                        first = i
            if len(total) >= MOST_PIECES:
                yield emit()
        yield emit()

    return run


def _learn(n_merges: int, floor: int, earlier: set[str]):
    def run(batches):
        rows = ((p.split(" "), n) for b in batches for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        merges = learn_merges(rows, n_merges, floor, earlier)
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in merges], pa.string()), pa.array([m[1] for m in merges], pa.string())], names=["left", "right"])

    return run


def _open_pairs(counts: DataFrame, most: int) -> tuple[list[tuple[str, str]], int]:
    """The most frequent pairs and their floor: all pairs with that count or more, at most `most` if the counts allow."""
    top = counts.orderBy(F.desc("n")).limit(most + 1).collect()
    floor = top[-1]["n"]
    if len(top) <= most:
        return [(r["left"], r["right"]) for r in top], floor
    if top[0]["n"] > floor:  # the last count may go on below: only whole counts are open
        return [(r["left"], r["right"]) for r in top if r["n"] > floor], floor + 1
    level = counts.filter(F.col("n") == floor).orderBy("left", "right").collect()  # one count only: all of it
    return [(r["left"], r["right"]) for r in level], floor


def learn_subwords(df: DataFrame, cols: list[str], n_merges: int, most_pieces: int = MOST_PIECES, first_open: int = FIRST_OPEN) -> DataFrame:
    """Merge table (rank INT, left STRING, right STRING) of up to `n_merges` merges."""
    spark = df.sparkSession
    chars = F.split(F.col("word"), "")
    chars = F.filter(chars, lambda c: c != "")
    symbols = F.concat_ws(" ", F.slice(chars, 1, F.size(chars) - 1), F.concat(F.element_at(chars, -1), F.lit(EOW)))
    words = word_table(df, cols).filter(F.length("word") > 1).select(symbols.alias("symbols"), F.col("cnt").cast("long").alias("cnt"))
    words = stage(words, "subword-words")
    pair = F.explode(F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right"))))
    counts = words.select(F.split("symbols", " ").alias("_s"), "cnt").select(pair.alias("p"), "cnt").groupBy("p.left", "p.right").agg(F.sum("cnt").alias("n"))
    counts = stage(counts, "subword-pairs")
    merges: list[tuple[str, str]] = []
    n_open = first_open
    left = words.count()
    while len(merges) < n_merges and left:
        if left <= most_pieces:
            known, floor = None, 1
        else:
            pairs, floor = _open_pairs(counts, min(n_open, MOST_OPEN))
            known = set(pairs)
        bc = spark.sparkContext.broadcast(known)  # MOST_OPEN pairs, or the pairs of one count
        pieces = words.select("symbols", "cnt").mapInArrow(_pieces(bc), "piece string, cnt long").groupBy("piece").agg(F.sum("cnt").alias("cnt"))
        pieces = stage(pieces, "subword-pieces")
        n = pieces.count()
        if n > most_pieces and known is not None and len(known) > 1 and n_open > 1:
            n_open = max(1, min(n_open // 4, len(known) - 1))
            continue
        # at most most_pieces rows (but for one pair alone): the only rows that one task reads
        new = pieces.repartition(1).mapInArrow(_learn(n_merges - len(merges), floor, {a + b for a, b in merges}), "left string, right string").collect()
        merges += [(r["left"], r["right"]) for r in new]
        if known is None or len(merges) >= n_merges:
            break
        bc = spark.sparkContext.broadcast([(r["left"], r["right"]) for r in new])
        after = stage(words.select("symbols", "cnt").mapInArrow(_apply_round(bc), f"symbols string, cnt long, change {_PAIRS}"), "subword-words")
        change = after.select(F.explode("change").alias("c")).select("c.left", "c.right", "c.n")
        counts = stage(counts.unionByName(change).groupBy("left", "right").agg(F.sum("n").alias("n")).filter("n > 0"), "subword-pairs")
        words = after.filter(F.instr("symbols", " ") > 0)
        left = words.count()
        n_open *= 4 if n < most_pieces // 4 else 2 if n < most_pieces // 2 else 1
    rows = [(i, a, b) for i, (a, b) in enumerate(merges[:n_merges], 1)]  # bounded by n_merges
    return spark.createDataFrame(rows, "rank int, left string, right string")


def _segment_words(merge_list: list[tuple[int, str, str]]):
    ranks = {(l, r): k for k, l, r in merge_list}

    def seg(word: str) -> str:
        if not word:
            return word
        syms = replay([*word[:-1], word[-1] + EOW], ranks)
        syms[-1] = syms[-1][: -len(EOW)]
        return "@@ ".join(syms)

    return seg


def segment_table(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word, seg) for distinct words: merges replayed in rank order per word."""
    merge_list = [(int(r["rank"]), r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    bc = words.sparkSession.sparkContext.broadcast(merge_list)  # two symbols a merge: 32 000 merges are under 2 MB

    def run(batches):
        seg = _segment_words(bc.value)
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seg(w) for w in words], pa.string())], names=["word", "seg"])

    return words.select("word").mapInArrow(run, "word string, seg string")


def subword_apply(df: DataFrame, merges: DataFrame, col: str = "text", key: str = "line_no") -> DataFrame:
    """Replace `col` by its subword segmentation (`@@ ` between pieces of a word)."""
    return recoded(df, col, lambda words: segment_table(words, merges))
