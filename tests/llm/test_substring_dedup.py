import hashlib
import random
import re

from parallax.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """{doc_id: kept words}; a window is a repeat if its words start earlier anywhere."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first, out = {}, {}
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (i, s))
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (i, s):
                gone.update(range(s, s + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), gone)
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    passage = [rng.choice("abcdef") + str(rng.randrange(5)) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            a = rng.randrange(30)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[a : a + rng.randrange(3, 40)] * rng.choice((1, 1, 2))
        rows.append((i * 7 - 20, rng.choice((" ", "\n", " \t")).join(w)))
    return rows + [(5000, rows[3][1]), (5001, rows[3][1]), (6000, ""), (6001, None), (6002, " \n ")]


def check(df, rows, k):
    want = brute(rows, k)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept, _ = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, gone, kept), r.doc_id
        covered = {j for s in r.spans for j in range(s.begin, s.end)}
        assert covered == want[r.doc_id][3]
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))


def test_against_brute_force(spark, docs_of):
    for seed, k in ((1, 4), (2, 8), (3, 20)):
        rows = random_rows(seed)
        check(substring_dedup(docs_of(rows, 5), k), rows, k)


def test_sf_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(substring_dedup(docs, 20), rows, 20)


def test_original_white_space_and_carried_columns(spark, docs_of):
    rows = [(1, "a b  c\nd e f"), (2, "x\n a b  c d\n\ny z"), (3, "é a b c d")]
    got = {r.doc_id: r for r in substring_dedup(docs_of(rows), 4, carry=("source", "lang"), joined=False).collect()}
    assert got[1].kept == "a b  c\nd e f" and got[2].kept == "x\n y z" and got[3].kept == "é "
    assert got[2].source == "a" and got[2].lang == "en"


def test_repeated_rows_and_null_ids(spark, docs_of):
    text = "a b c d e f g h"
    got = substring_dedup(docs_of([(1, text), (1, text), (None, text + " i"), (2, text)]), 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.kept)
    assert by[None] == [text + " i"] and by[1] == ["", ""] and by[2] == [""]
    got = substring_dedup(docs_of([(1, text), (1, text)]), 4).collect()
    assert [r.kept for r in got] == [text, text]


def test_empty_table_and_long_text(spark, docs_of):
    docs = docs_of([(1, "a")])
    assert substring_dedup(docs.limit(0), 20).count() == 0
    long = " ".join(str(i) for i in range(400_000))
    got = substring_dedup(docs_of([(1, long), (2, long + " z"), (3, "x" * 200_000)]), 20).collect()
    assert {r.doc_id: (r.n_removed, len(r.kept)) for r in got} == {1: (0, len(long)), 2: (400_000, 1), 3: (0, 200_000)}
