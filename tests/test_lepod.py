"""LeD / PoD against the hand fixtures of FIXTURES.md §4."""
import random
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from parallax.operators import chunks
from parallax.operators import lepod as L
from parallax.operators.chunks import improved

ROWS = [
    # s1, s2, spans as "start2:len2 start1:len1", punct, led, pod, mat1, sub1, mat2, sub2
    ("a b c d", "d a b x", "1:1 0:1, 2:1 1:1, 0:1 3:1", "", 0.25, 0.666667, "a b d", "c", "d a b", "x"),
    ("kick the bucket now", "die now", "0:1 0:3, 1:1 3:1", "", 0.625, 0.0, "kick the bucket now", "kick the bucket", "die now", "die"),
    ("a , b", "b , a", "2:1 0:1, 1:1 1:1, 0:1 2:1", "", 0.0, 0.666667, "a , b", "", "b , a", ""),
    ("a , b", "b , a", "2:1 0:1, 1:1 1:1, 0:1 2:1", ",", 0.0, 0.5, "a b", "", "b a", ""),
    ("x y", "p q", "", "", 1.0, 0.0, "", "x y", "", "p q"),
    ("a b", "a b", "0:1 0:1, 1:1 1:1", "", 0.0, 0.0, "a b", "", "a b", ""),
]


def _spans(spark, pid, text):
    out = []
    for blk in [b for b in text.split(",") if b.strip()]:
        s2, s1 = blk.split()
        a, b = s2.split(":")
        c, d = s1.split(":")
        out.append((pid, int(c), int(d), int(a), int(b)))
    return out


def _run(spark, i, row):
    s1, s2, spans, punct = row[:4]
    pairs = spark.createDataFrame([(i, s1, s2)], "pair_id long, text1 string, text2 string")
    al = spark.createDataFrame(_spans(spark, i, spans), "pair_id long, start1 int, len1 int, start2 int, len2 int")
    return L.lepod(pairs, al, punct=punct, detail=True).first()


@pytest.mark.parametrize("i", range(len(ROWS)))
def test_fixture_rows(spark, i):
    row = ROWS[i]
    r = _run(spark, i, row)
    assert r["valid"]
    assert r["led"] == pytest.approx(row[4], abs=1e-6)
    assert r["pod"] == pytest.approx(row[5], abs=1e-6)
    assert (r["mat1"], r["sub1"], r["mat2"], r["sub2"]) == row[6:]


def test_empty_side_is_skipped(spark):
    pairs = spark.createDataFrame([(1, "", "a")], "pair_id long, text1 string, text2 string")
    al = spark.createDataFrame([], "pair_id long, start1 int, len1 int, start2 int, len2 int")
    r = L.lepod(pairs, al).first()
    assert r["skipped"] and r["led"] is None and r["pod"] is None


def test_summary_of_fixture_rows(spark):
    rows, spans = [], []
    for i, row in enumerate(ROWS):
        if row[3]:
            continue  # the punctuation variant needs its own option
        rows.append((i, row[0], row[1]))
        spans += _spans(spark, i, row[2])
    pairs = spark.createDataFrame(rows, "pair_id long, text1 string, text2 string")
    al = spark.createDataFrame(spans, "pair_id long, start1 int, len1 int, start2 int, len2 int")
    # add the punctuation row through its own call and union the scores
    p4 = spark.createDataFrame([(3, ROWS[3][0], ROWS[3][1])], "pair_id long, text1 string, text2 string")
    a4 = spark.createDataFrame(_spans(spark, 3, ROWS[3][2]), "pair_id long, start1 int, len1 int, start2 int, len2 int")
    scored = L.lepod(pairs, al).unionByName(L.lepod(p4, a4, punct=","))
    r = L.lepod_report(scored).first()
    assert r["n_pairs"] == 6
    assert r["led_mean"] == pytest.approx(0.3125)
    assert r["pod_mean"] == pytest.approx(0.305556, abs=1e-6)
    assert (r["led_min"], r["led_max"]) == (0.0, 1.0)
    assert r["pod_max"] == pytest.approx(0.666667, abs=1e-6)
    assert (r["n_nonzero_led"], r["n_nonzero_pod"], r["n_all_zero"]) == (3, 3, 1)
    assert (r["pct_nonzero_led"], r["pct_all_zero"]) == (50.0, 16.67)


@pytest.mark.parametrize("perm,expected", [([0, 1, 2], 0.0), ([2, 0, 1], 2 / 3), ([1, 0, 3, 2], 0.5),
                                           ([0, 4, 1, 2, 3, 7, 5, 6, 8, 9], 0.5)])
def test_pod_from_permutation(spark, perm, expected):
    d = [p - i for i, p in enumerate(perm)]
    df = spark.createDataFrame([(d,)], "d array<int>")
    assert df.select(L.pod_score(F.col("d"))).first()[0] == pytest.approx(expected)


def test_exact_alignment_distortions_sum_to_zero(spark):
    pairs = spark.createDataFrame([(1, "a b c a", "c a b a d")], "pair_id long, text1 string, text2 string")
    p = L.prepare_pairs(pairs)
    spans = {(r.start1, r.start2) for r in L.exact_align(p).collect()}
    assert spans == {(0, 1), (1, 2), (2, 0), (3, 3)}
    r = L.lepod(pairs).first()
    assert r["valid"] and r["led"] == pytest.approx((0 / 4 + 1 / 5) / 2)


def chunks_and_crossings(links):
    links = sorted(links)
    chunks = sum(k == 0 or links[k][0] != links[k - 1][0] + 1 or links[k][1] != links[k - 1][1] + 1 for k in range(len(links)))
    return chunks, sum(a[1] > b[1] for k, a in enumerate(links) for b in links[k + 1 :])


def maximal_matchings(left, right):
    """Every matching of equal tokens that links as many of each token as there can be."""
    per = []
    for w in sorted(set(left) & set(right)):
        a, b = ([i for i, x in enumerate(side) if x == w] for side in (left, right))
        n = min(len(a), len(b))
        per.append([list(zip(x, y)) for x in permutations(a, n) if list(x) == sorted(x) for y in permutations(b, n)])
    for combo in product(*per):
        yield [link for links in combo for link in links]


def test_fewest_chunks_equals_brute_force():
    rng = random.Random(11)
    for k in range(400):
        letters = "ab" if k % 4 == 0 else "abc" if k % 2 else "abcde"
        left, right = ([rng.choice(letters) for _ in range(rng.randrange(0, 8 if letters != "ab" else 7))] for _ in range(2))
        got = L.fewest_chunks(left, right)
        assert all(left[i] == right[j] for i, j in got) and len({j for _, j in got}) == len(got) == len({i for i, _ in got})
        best = min((chunks_and_crossings(m) for m in maximal_matchings(left, right)), default=(0, 0))
        assert len(got) == sum(min(left.count(w), right.count(w)) for w in set(left)) and chunks_and_crossings(got) == best


def test_fewest_chunks_of_long_sides():
    words = [f"w{i % 50}" for i in range(2000)]
    got = L.fewest_chunks(words, words[1000:] + words[:1000])
    assert len(got) == 2000 and chunks_and_crossings(got)[0] <= 2
    got = L.fewest_chunks(["a"] * 300, ["a"] * 200 + ["b"])
    assert len(got) == 200 and chunks_and_crossings(got) == (1, 0)


def test_fewest_chunks_is_exact_beyond_the_beam():
    """More states than a beam follows and more places than it tries: the best is among the last ones."""
    rng = random.Random(31)
    worse = 0
    for k in range(60):
        left, right = ([rng.choice("aaaabbc") for _ in range(n)] for n in (rng.randrange(4, 8), rng.randrange(8, 11)))
        shared = set(left) & set(right)
        sides = [[(i, w) for i, w in enumerate(side) if w in shared] for side in (left, right)]
        best = min((chunks_and_crossings(m) for m in maximal_matchings(left, right)), default=(0, 0))
        some = sorted(next(iter(maximal_matchings(left, right)), []))
        assert chunks_and_crossings(improved(*sides, some)) == best
        assert chunks_and_crossings(L.fewest_chunks(left, right)) == best
    for k in range(40):  # one long side
        left, right = (["x"] * a + [f"u{i}" for i in rng.sample(range(6), 6)] + ["x"] * b for a, b in ((2, 1), (7, 7)))
        rng.shuffle(left), rng.shuffle(right)
        shared = [[(i, w) for i, w in enumerate(side)] for side in (left, right)]
        best = min(chunks_and_crossings(m) for m in maximal_matchings(left, right))
        worse += chunks_and_crossings(L._first_matching(*shared, max(len(left), len(right)), len(left))) != best
        assert chunks_and_crossings(L.fewest_chunks(left, right)) == best
    assert worse  # the beam alone does not find them all


def test_search_in_narrow_blocks(monkeypatch):
    """States that do not fit a block wait: the result is the same."""
    monkeypatch.setattr(chunks, "WIDE", 2)
    test_fewest_chunks_equals_brute_force()


def test_chunk_alignment_lowers_pod(spark):
    pairs = spark.createDataFrame([(1, "the dog saw the cat", "the cat saw the dog"), (2, "x the cat", "the the cat"), (3, "", "a"), (4, None, None)],
                                  "pair_id long, text1 string, text2 string")
    old = {r.pair_id: r for r in L.lepod(pairs).collect()}
    new = {r.pair_id: r for r in L.lepod(pairs, method="chunks").collect()}
    assert (old[2].pod, new[2].pod) == (0, 0) and old[2].led == new[2].led and new[1].led == 0
    assert new[3].skipped and new[4].skipped and new[1].valid
    spans = {(r.pair_id, r.start1, r.start2) for r in L.exact_align(L.prepare_pairs(pairs), method="chunks").collect()}
    assert {(2, 1, 1), (2, 2, 2)} <= spans and (2, 1, 0) not in spans


def slow_arrays(t1, t2, spans, punct):
    """J5, W2 and W3 of one pair, token by token."""
    a, e = [[None] * len(t) for t in (t1, t2)], [[False] * len(t) for t in (t1, t2)]
    for s1, l1, s2, l2 in spans:
        same = t1[s1 : s1 + l1] == t2[s2 : s2 + l2]
        for k, (t, s, n, o) in enumerate(((t1, s1, l1, s2), (t2, s2, l2, s1))):
            for p in range(s, min(s + n, len(t))):
                a[k][p] = (None if t[p] in punct else o) if p == s else -1
                e[k][p] = same
    x = []
    for k in range(2):
        n, own = 0, []
        for v in a[k]:
            own.append(n if v is not None and v >= 0 else None)
            n += own[-1] is not None
        x.append(own)
    dist = []
    for i, v in zip(x[0], a[0]):
        if i is not None:
            other = x[1][v] if v < len(x[1]) else None
            dist.append(None if other is None else other - i)
    return a[0], e[0], a[1], e[1], x[0], x[1], dist


def test_arrays_of_any_spans(spark):
    """Overlapping, crossing and too long spans, with and without a punctuation set, many pairs in a block."""
    rng = random.Random(12)
    rows, spans = [], []
    for i in range(150):
        t1, t2 = ([rng.choice("ab,c") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        rows.append((i, " ".join(t1), "  ".join(t2)))
        if t1 and t2:
            for _ in range(rng.randrange(0, 5)):
                spans.append((i, rng.randrange(len(t1)), rng.randrange(1, 4), rng.randrange(len(t2)), rng.randrange(1, 4)))
    pairs = spark.createDataFrame(rows, "pair_id long, text1 string, text2 string").coalesce(1)
    al = spark.createDataFrame(spans, "pair_id long, start1 int, len1 int, start2 int, len2 int").coalesce(1)
    # the order of a pair's spans is the order of its block: read it back
    from parallax.operators.joins import attach_alignment

    order = {r.pair_id: [tuple(s) for s in r.spans] for r in attach_alignment(pairs, al).collect()}
    for punct in ("", ",", ",a"):
        for r in L.align_tokens(pairs, al, punct=punct).collect():
            t1, t2 = rows[r.pair_id][1].split(), rows[r.pair_id][2].split()
            want = slow_arrays(t1, t2, [(a, b, c, d) for a, b, c, d in order[r.pair_id]], set(punct))
            assert (r.t1, r.t2) == (t1, t2)
            assert (r.a1, r.e1, r.a2, r.e2, r.x1, r.x2, r.dist) == want, r.pair_id
