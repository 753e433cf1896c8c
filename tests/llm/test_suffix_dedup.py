import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parallax.llm import queries
from parallax.llm.common import column_bytes
from parallax.llm.suffix_dedup import anchors, gram_bytes, multikey_sort, pieces, suffix_dedup


def brute(rows, k):
    """[(n_bytes, spans, kept)] by counting every string of k bytes."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = {}
    for t in texts:
        for p in range(len(t) - k + 1):
            count[t[p : p + k]] = count.get(t[p : p + k], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if count[t[p : p + k]] > 1:
                gone[p : p + k] = b"\1" * k
        spans, p = [], 0
        while p < len(t):
            q = p
            while q < len(t) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((len(t), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def check(df, rows, k):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept), r.n_removed) for r in df.collect())
    want = sorted((i is None, i or 0, n, spans, kept, n - len(kept)) for (i, *_), (n, spans, kept) in zip(rows, brute(rows, k)))
    assert got == want


def random_rows(seed, n=150, letters="abcdé \n", long=160):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [text(rng.randrange(5, long)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, long))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p[a : a + rng.randrange(1, long)] * rng.choice((1, 1, 1, 3)) + t[at:]
        rows.append((i - 20, t))
    for i in range(30):  # near copies
        t = list(rows[i % 5][1])
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = "x"
        rows.append((1000 + i, "".join(t)))
    return rows + [(5000, None), (5001, ""), (None, rows[3][1]), (3, rows[8][1]), (6000, "a" * 90), (6001, "ab" * 60 + "\0\0\0" * 30)]


@pytest.mark.parametrize("seed,k", [(1, 12), (2, 24), (3, 50), (4, 7)])
def test_against_brute_force(spark, docs_of, seed, k):
    rows = random_rows(seed)
    check(suffix_dedup(docs_of(rows, 5), k), rows, k)


def test_hot_passage_with_many_surroundings(spark, docs_of):
    """One passage in every document: its suffixes are cut apart by splitters, so boundaries decide."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = text(60)
    rows = [(i, text(rng.randrange(50)) + passage[rng.randrange(8) :] + text(rng.randrange(50))) for i in range(300)]
    check(suffix_dedup(docs_of(rows, 7), 40), rows, 40)


def test_repeated_rows_and_clashing_columns(spark, docs_of):
    rows = [(1, "abcdefgh" * 4), (1, "abcdefgh" * 4), (2, "zyxwvutsrqponm" + "0123456789")]
    docs = docs_of(rows).selectExpr("*", "lang AS kept", "source AS _key", "1 AS bucket")
    got = suffix_dedup(docs, 10, carry=("kept", "_key", "bucket")).collect()
    assert got[0].asDict().keys() == {"doc_id", "kept_carried", "_key", "bucket", "n_bytes", "n_removed", "spans", "kept"}
    assert sorted((r.doc_id, r.n_removed, r.kept_carried) for r in got) == [(1, 32, "en"), (1, 32, "en"), (2, 0, "en")]
    rows = [(1, "0123456789")] * 2
    check(suffix_dedup(docs_of(rows), 10), rows, 10)


def test_empty_table_and_long_texts(spark, docs_of):
    docs = docs_of([(1, "a")])
    assert suffix_dedup(docs.limit(0), 400).count() == 0
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(4_300_000))
    rows = [(1, long), (2, "x" + long[2_000_000:2_200_000] + "y"), (3, "z" * 1000)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup(docs_of(rows, 3), 400).collect()}
    assert got == {1: [(2_000_000, 2_200_000)], 2: [(1, 200_001)], 3: [(0, 1000)]}


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (0, 5, 30, 400, 41, 39)] + ["a" * 100]
    data, offs = column_bytes(pa.array(texts))
    for length in (6, 12, 40):
        row, h, anchor, first, last = anchors(data, offs, length)
        covered = [p for a, b in zip(first, last) for p in range(a, b + 1)]
        assert covered == [p for a, b in zip(offs, offs[1:]) for p in range(a, b - length + 1)]
        assert ((anchor >= last) & (anchor + gram_bytes(length) <= first + length)).all()
        place = {}
        for a, lo, hi in zip(anchor, first, last):
            for p in range(lo, hi + 1):
                assert place.setdefault(data[p : p + length].tobytes(), a - p) == a - p
    whole = anchors(data, offs, 6)
    split = [anchors(data[c[0] : c[-1]], c - c[0], 6) for _, c in pieces(offs, 6, 50)]
    assert {(a + c[0], p) for (_, c), (_, _, anchor, first, last) in zip(pieces(offs, 6, 50), split) for a, lo, hi in zip(anchor, first, last) for p in range(lo + c[0], hi + c[0] + 1)} \
        == {(a, p) for _, _, a, lo, hi in zip(*whole) for p in range(lo, hi + 1)}


def test_multikey_sort():
    rng = np.random.default_rng(8)
    m = rng.integers(0, 2, (300, 24)).astype(np.uint8)
    m[50:150, :20] = m[0, :20]
    m[200:220] = m[5]
    order, shared = multikey_sort(m)
    rows = [r.tobytes() for r in m]
    assert [rows[i] for i in order] == sorted(rows)
    for i in range(1, len(order)):
        a, b = rows[order[i - 1]], rows[order[i]]
        assert shared[i] == next((j for j in range(24) if a[j] != b[j]), 24)


def test_given_tables_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for (i, _), (n, spans, kept) in zip(rows, brute(rows, 400))}
    got = queries.QUERIES["op12_suffix_dedup"](spark, sf)
    assert {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert set(con.execute(queries.ORACLE["op12_suffix_dedup"]).fetchall()) == want
