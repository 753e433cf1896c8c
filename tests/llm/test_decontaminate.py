import random
import re

import numpy as np

from parallax.llm.decontaminate import FMIndex, decontaminate, sort_suffixes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    out = {}
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - k + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in wins}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (x := tuple(w[s : s + m])) in wins:
                    hit.update(range(s, s + m))
                    found |= wins[x]
        out[i] = (len(w), len(hit), sorted(found), hit)
    return out


def check(df, docs, items, k=10):
    want = brute(docs, items, k)
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        n, h, found, hit = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items) == (n, h, found), r.doc_id
        assert {j for s in r.spans for j in range(s.begin, s.end)} == hit
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))


def test_index_against_scans():
    rng = np.random.default_rng(5)
    for n, sigma in ((1, 1), (40, 2), (300, 3), (2000, 30)):
        sym = np.append(rng.integers(1, sigma + 1, n), 0)
        assert list(sort_suffixes(sym)) == sorted(range(n + 1), key=lambda i: list(sym[i:]))
        index = FMIndex(sym)
        patterns = np.array([sym[a : a + 3] for a in rng.integers(0, max(1, n - 3), 20)] if n > 3 else [[1, 1, 1]])
        found, lo, hi = index.search(patterns)
        for p, a, b in zip(found, lo, hi):
            want = [i for i in range(n - 1) if list(sym[i : i + 3]) == list(patterns[p])]
            assert sorted(index.locate(np.arange(a, b))) == want


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(("the", "of", "é", "x1", "Ab", "zz", "q"))
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 6, 12, 30))))) for i in range(12)]
    items += [(3, items[5][1]), (None, "lone null item of some seven words"), (50, None)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            w[len(w) // 2 : len(w) // 2] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice((" ", ", ", "\n")).join(w)))
    return docs + [(900, docs[2][1]), (901, ""), (902, None)], items


def test_against_brute_force(spark, docs_of):
    for seed, k in ((1, 4), (2, 10)):
        docs, items = make(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        check(decontaminate(docs_of(docs), bench, k), docs, items, k)


def test_many_blocks_give_the_same(spark, docs_of):
    docs, items = make(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate(docs_of(docs), bench, 5, block_bytes=200), docs, items, 5)


def test_sf_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    check(decontaminate(docs, bench), [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_clean_text_and_odd_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three"), (2, "")], "item_id long, text string")
    docs = docs_of([(1, "A. One, two - THREE! z"), (1, "A. One, two - THREE! z"), (2, "é one two"), (None, "one two three one two three"), (3, None)])
    got = sorted((r.doc_id or 0, r.kept, r.n_hit) for r in decontaminate(docs, bench, clean=True, carry=("lang",)).collect())
    assert got == [(0, "", 6), (1, "A. ! z", 3), (1, "A. ! z", 3), (2, "é one two", 0), (3, "", 0)]
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate(docs, bench.limit(0)).collect())
    long = docs_of([(1, "one two three " * 150_000), (2, "x" * 300_000)])
    assert {r.doc_id: r.n_hit for r in decontaminate(long, bench).collect()} == {1: 450_000, 2: 0}
