"""Operator 11: ranked lexical search with hashed max-sketches.

A document's impact of a term is its saturated count `(10**9 * tf) div (1000 * tf + 8 * m)`; a
query's score of the document is the sum of weight times impact over the query's terms.

1. One pass counts documents, terms and the document frequency of the queries' terms; the counts
   are summed by Spark and give the weights.
2. A second pass folds each document's impacts into a sketch: coordinate `hash(term) mod WIDTH`
   holds the largest impact of the terms that fall on it.  The coordinates of a query's terms are
   looked up for a block of documents at once; their weighted sum is at least the score.
3. The documents of a block are rescored exactly by descending bound, until the next bound is
   under the query's threshold: the score of the worst of the best documents that the task has
   seen.  A task returns the best of each query, and a window ranks them over all tasks.

A row of documents counts as one document, repeated rows too; a null or empty text has no terms and
is never found; among equal scores a null doc_id comes last.  Equal (item_id, text) rows of the
queries are one item; rows that share an item_id but not the text are ranked each by itself; an
item without terms has no rows.  Other columns of either table are not read.  Queries are taken in
blocks of `block_bytes` of text, so what is broadcast is bounded.
"""
from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, _B, column_bytes, row_slices, text_bytes

WIDTH_BITS = 11  # 2048 coordinates
BLOCK_BYTES = 4 << 20  # query text of one pass
BLOCK_ROWS = 512  # documents whose sketches are held at once
TERMS = ~((_B <= 0x2F) | ((_B >= 0x3A) & (_B <= 0x40)) | ((_B >= 0x5B) & (_B <= 0x60)) | ((_B >= 0x7B) & (_B <= 0x7F)))
K_DOCS, K_TERMS = -1, -2  # rows of the counts that are no query term
SLACK = 1e-9  # of a bound, for sums beyond 2**53


def _blocks(batch: pa.RecordBatch):
    """(ids, Words of lower-cased terms) for some documents at a time."""
    ids = batch.column(0)
    data, offs = column_bytes(batch.column(1))
    for lo, hi in row_slices(offs):
        for a in range(lo, hi, BLOCK_ROWS):
            b = min(hi, a + BLOCK_ROWS)
            yield ids.slice(a, b - a), Words(LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], TERMS)


class Queries:
    """The terms of a block of items: `vocab` (sorted hashes), and each item's places in it with repeats."""

    def __init__(self, texts: list[str | None]):
        data, offs = column_bytes(pa.array(texts, pa.string()))
        words = Words(LOWER[data], offs, TERMS)
        h = words.hashes()
        self.vocab, place = np.unique(h, return_inverse=True)
        self.items = []
        for a, b in zip(words.first[:-1], words.first[1:]):
            self.items.append(np.unique(place[a:b], return_counts=True))


class Weighted:
    """Queries with what the whole table gives: weights, and the constants of the length term."""

    def __init__(self, queries: Queries, counts: dict[int, int]):
        self.n_docs, self.n_terms = counts.get(K_DOCS, 0), counts.get(K_TERMS, 0)
        df = [counts.get(i, 0) for i in range(len(queries.vocab))]
        weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
        self.hashes, self.coords, self.weights = [], [], []
        for place, times in queries.items:
            found = np.array([df[i] > 0 for i in place], bool)  # a term of no document adds nothing
            place, times = place[found], times[found]
            self.hashes.append(queries.vocab[place])
            self.coords.append((queries.vocab[place] >> np.uint64(64 - WIDTH_BITS)).astype(np.int64))
            self.weights.append(weight[place] * times)


def _count(known):
    """Texts -> (term, n): documents with terms, all terms, and documents by query term."""

    def run(batches):
        vocab = known.value.vocab
        df, docs, terms = np.zeros(len(vocab), np.int64), 0, 0
        for batch in batches:
            for _, words in _blocks(batch):
                docs, terms = docs + int((words.n > 0).sum()), terms + int(words.n.sum())
                if not len(vocab):
                    continue
                h = words.hashes()
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                mine = vocab[at] == h
                pairs = np.unique(words.rows()[mine] * len(vocab) + at[mine])
                df += np.bincount(pairs % len(vocab), minlength=len(vocab))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[K_DOCS, K_TERMS], some]).astype(np.int64)), pa.array(np.concatenate([[docs, terms], df[some]]).astype(np.int64))],
            names=["term", "n"])

    return run


class Sketches:
    """Some documents: their distinct terms with impacts, and the coordinatewise maxima of these."""

    def __init__(self, words: Words, n_docs: int, n_terms: int):
        h, row = words.hashes(), words.rows()
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.terms, self.row = h[first], row[first]
        tf = np.diff(np.append(first, len(h)))
        m = 25 + (75 * words.n.astype(np.int64) * n_docs) // max(n_terms, 1)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.row])
        self.first = np.searchsorted(self.row, np.arange(len(words.n) + 1))
        coord = (self.terms >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)
        self.maxima = np.zeros((1 << WIDTH_BITS, len(words.n)))
        if len(first):
            cell = np.ones(len(first), bool)  # terms of a document lie by hash, so by coordinate
            cell[1:] = (coord[1:] != coord[:-1]) | (self.row[1:] != self.row[:-1])
            at = np.flatnonzero(cell)
            self.maxima[coord[at], self.row[at]] = np.maximum.reduceat(self.impact, at)

    def bounds(self, coords: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """At least the score of each document."""
        return weights.astype(float) @ self.maxima[coords]

    def score(self, doc: int, hashes: np.ndarray, weights: np.ndarray) -> int:
        a, b = self.first[doc], self.first[doc + 1]
        at = a + np.searchsorted(self.terms[a:b], hashes)
        found = at < b
        found[found] = self.terms[at[found]] == hashes[found]
        return int((weights[found] * self.impact[at[found]]).sum())


class Best:
    """The best documents of one item so far: (-score, id is null, id), sorted."""

    def __init__(self, top: int):
        self.top, self.found, self.rescored = top, [], 0

    def threshold(self) -> int:
        return -self.found[-1][0] if len(self.found) == self.top else 1

    def search(self, docs: Sketches, ids: list, hashes: np.ndarray, coords: np.ndarray, weights: np.ndarray) -> None:
        bound = docs.bounds(coords, weights) * (1 + SLACK)
        some = np.flatnonzero(bound >= self.threshold())
        for doc in some[np.argsort(-bound[some], kind="stable")]:
            if bound[doc] < self.threshold():
                break
            self.rescored += 1
            score = docs.score(doc, hashes, weights)
            if score > 0:
                insort(self.found, (-score, ids[doc] is None, ids[doc] or 0))
                del self.found[self.top :]


def _search(known, top: int):
    """Texts -> (item, doc_id, score): the best documents of this task for each item."""

    def run(batches):
        q = known.value
        best = [Best(top) for _ in q.hashes]
        for batch in batches:
            for ids, words in _blocks(batch):
                if not len(words.start):
                    continue
                docs, ids = Sketches(words, q.n_docs, q.n_terms), ids.to_pylist()
                for own, hashes, coords, weights in zip(best, q.hashes, q.coords, q.weights):
                    if len(hashes):
                        own.search(docs, ids, hashes, coords, weights)
        rows = [(i, None if null else doc, -score) for i, own in enumerate(best) for score, null, doc in own.found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))],
                                             names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([r.text for r in items])
    counted = docs.mapInArrow(_count(spark.sparkContext.broadcast(queries)), "term long, n long")
    counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per query term
    found = docs.mapInArrow(_search(spark.sparkContext.broadcast(Weighted(queries, counts)), top), "item int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", place).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id string")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item by descending score, then doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # bounded: one block of the stated query set
        own = _search_block(docs, rows, top)
        found = own if found is None else found.unionByName(own)
    return found.withColumn("item_id", F.col("item_id").cast(kind))
