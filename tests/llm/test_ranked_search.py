import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from parallax.llm import queries
from parallax.llm.common import LOWER, Words, column_bytes
from parallax.llm.ranked_search import TERMS, Best, Queries, Sketches, Weighted, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in items:
        want, scores = Counter(terms(text)), []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, k in want.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out |= {(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:top], 1)}
    return out


def random_docs(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ÉA", "x9", "9", "ß"]
    text = lambda k: rng.choice((" ", "-", "\n")).join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=k))
    docs = [(i * 3 - 50, text(rng.randrange(0, 80))) for i in range(n)]
    docs += [(9000 + i, docs[5][1]) for i in range(25)] + [(None, docs[7][1]), (8000, None), (8001, ""), (8002, " .,\n")]
    items = [(i, text(rng.randrange(1, 30)).upper()) for i in range(12)] + [(50, None), (51, "?!"), (52, "nowhere"), (53, docs[5][1])]
    return docs, items


def frames(spark, docs, items, parts=5):
    d = spark.createDataFrame([(i, t, 1, 0) for i, t in docs], "doc_id long, text string, score long, item_id long").repartition(parts)
    return d, spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, doc_id string")


def test_against_brute_force(spark):
    for seed, parts in ((1, 5), (2, 1)):
        docs, items = random_docs(seed)
        want = brute(docs, items)
        got = ranked_search(*frames(spark, docs, items, parts)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        got = ranked_search(*frames(spark, docs, items, parts), block_bytes=300)  # several passes
        assert {tuple(r) for r in got.collect()} == want


def test_bounds_hold_and_prune():
    docs, items = random_docs(3, 500)
    data, offs = column_bytes(pa.array([t for _, t in docs], pa.string()))
    words = Words(LOWER[data], offs, TERMS)
    q = Queries([t for _, t in items])
    h, rows = words.hashes(), words.rows()
    df = {i: len(set(rows[h == v])) for i, v in enumerate(q.vocab)}
    known = Weighted(q, df | {-1: int((words.n > 0).sum()), -2: int(words.n.sum())})
    sketches = Sketches(words, known.n_docs, known.n_terms)
    rescored = 0
    for hashes, coords, weights in zip(known.hashes, known.coords, known.weights):
        exact = np.array([sketches.score(d, hashes, weights) for d in range(len(docs))])
        assert (sketches.bounds(coords, weights) >= exact).all()
        own = Best(10)
        if len(hashes):
            own.search(sketches, [i for i, _ in docs], hashes, coords, weights)
        rescored += own.rescored
    assert 0 < rescored < 0.25 * len(docs) * len(items)


def test_empty_tables_and_long_text(spark):
    docs, items = random_docs(4, 20)
    d, q = frames(spark, docs, items)
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0
    long = " ".join(f"t{i % 5000}" for i in range(300_000))
    rows, asked = [(1, long), (2, "t1 t2"), (3, "t" * 200_000)], [(0, "t1 T2 t2"), (1, "t" * 200_000)]
    got = {tuple(r) for r in ranked_search(*frames(spark, rows, asked)).collect()}
    assert got == brute(rows, asked)


def test_given_tables_and_sql(spark, sf):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    df = queries.QUERIES["op11_ranked_search"](spark, sf)
    assert {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()} == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert set(con.execute(queries.ORACLE["op11_ranked_search"]).fetchall()) == want
