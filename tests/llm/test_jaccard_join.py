import random
import re

import pytest

from parallax.llm import jaccard_join as join
from parallax.llm.components import components
from parallax.llm.jaccard_join import choose_boundary, jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{doc_id: (set size, component)} over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def check(df, rows):
    none = lambda x: (x[0] is not None, x)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def random_rows(seed, n, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if w:
                    at = rng.randrange(len(w))
                    kind = rng.random()
                    w[at : at + 1] = [] if kind < 0.3 else [rng.choice(vocabulary)] if kind < 0.7 else [w[at], rng.choice(vocabulary)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        texts.append(rng.choice((" ", "\n ")).join(w) if rng.random() < 0.9 else " ".join(w).upper())
    return list(zip(rng.sample(range(-50, 5 * n), n), texts))


@pytest.mark.parametrize("seed,sizes", [(1, (1, 2, 4, 5, 6, 7, 8, 9)), (2, (8, 10, 12, 14, 16, 20)), (3, (30, 60, 120, 300)), (4, (5, 12, 40))])
def test_against_brute_force(spark, docs_of, seed, sizes):
    rows = random_rows(seed, 260, sizes)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[0][1]), (9003, rows[0][1]), (None, rows[1][1]), (None, "alone here")]
    check(jaccard_join(docs_of(rows, 4)), rows)


def test_group_of_near_copies_and_shared_passage(spark, docs_of):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(150):  # copies at the edge of the threshold: many of them link through others only
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(rng.randrange(1, 30))]
        rows.append((1000 + i, " ".join(own[:5] + passage + own[5:])))
    check(jaccard_join(docs_of(rows, 6)), rows)


@pytest.mark.parametrize("kind,n,parts", [("passage", 120, 60), ("copies", 300, 4)])
def test_long_lists_without_links_make_few_pairs(spark, docs_of, monkeypatch, kind, n, parts):
    """Sets that share a passage (two in a task, so that no task sees how frequent it is), or most of a
    base text with eight words changed in each; next to none of them link."""
    made, links = [], join._links

    def counted(pairs, *tables):
        made.append(pairs.count())
        return links(pairs, *tables)

    monkeypatch.setattr(join, "_links", counted)
    rng, rows = random.Random(4), []
    for i in range(n):
        if kind == "passage":
            w = [f"o{i}x{j}" for j in range(20)] + [f"p{j}" for j in range(60)] + [f"e{i}x{j}" for j in range(40)]
        else:
            w = [f"b{j}" for j in range(300)]
            for j in rng.sample(range(300), 8):
                w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    check(jaccard_join(docs_of(rows, parts)), rows)
    assert sum(made) < n * n / 4, made


def passages(seed, groups, members):
    """Sets of two passages of their group and words of their own: two of a group share most of their prefixes and never link."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        for i in range(members):
            a, b = [f"p{g}x{j}" for j in range(34)], [f"q{g}x{j}" for j in range(34)]
            own = [f"o{g}x{i}x{j}" for j in range(rng.randrange(38, 46))]
            rows.append((1000 * g + i, " ".join(a + own[:19] + b + own[19:])))
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_open_lists_make_rows_of_near_pairs_only(spark, docs_of, monkeypatch, block):
    """Every two members of an open list are in some component apart: only pairs near by their counts become rows."""
    made, links = [], join._links

    def counted(pairs, *tables):
        made.append(pairs.count())
        return links(pairs, *tables)

    monkeypatch.setattr(join, "_links", counted)
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "ROUNDS", 1)
    rng = random.Random(5)
    rows = passages(3, 4, 14)
    base = [f"b{i}" for i in range(80)]
    for i in range(40):  # a chain of near copies, at the edge of the threshold
        base[rng.randrange(80)] = f"n{i}"
        rows.append((9000 + i, " ".join(base)))
    check(jaccard_join(docs_of(rows, 4)), rows)
    assert made[-1] < 4 * 14 * 13 / 4, made


def test_bundle_of_lists_compares_each_pair_once():
    """Two lists of one bundle; 1 and 2 are in the largest component, 3 and 4 apart, 5 in the second list only."""
    def row(side, owner, root, out_of, main_of, part):
        return {"bundle": 7, "side": side, "owner": owner, "n": 8, "root": root, "parts": bytes([part] * 8), "out_of": out_of, "main_of": main_of}

    members = [(1, 1, [], [10, 11], 1), (2, 1, [], [10], 1), (3, 3, [10, 11], [], 1), (4, 4, [10], [], 9), (5, 1, [], [11], 1)]
    table = join.pa.Table.from_pylist(
        [row(1, *m) for m in members] + [row(0, *m) for m in members if m[2]],
        join.pa.schema([("bundle", join.pa.int64()), ("side", join.pa.int32()), ("owner", join.pa.int64()), ("n", join.pa.int32()), ("root", join.pa.int64()),
                        ("parts", join.pa.binary()), ("out_of", join.pa.list_(join.pa.int64())), ("main_of", join.pa.list_(join.pa.int64()))]))
    assert [tuple(r.values()) for r in join._compare(table).to_pylist()] == [(1, 3), (2, 3), (3, 5)]


def test_texts_are_looked_up_once_for_a_pair_and_not_for_centres(spark):
    """Pairs of lists of two come from several buckets; a member of longer lists has its centres in each bucket."""
    rows = [(0, 1, 2, 0, 0)] * 3 + [(1, 9, 3, 8, 0), (1, 9, 4, 8, 0), (1, 9, 5, 8, 0)] + [(2, 4, 3, 0, 1), (2, 5, 3, 0, 1)] * 4
    assert sorted(r.hi for r in join._listed(spark.createDataFrame(rows, join.LISTS)).collect()) == [1, 2, 3, 4, 5]


def test_sf_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(jaccard_join(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_tables(spark, docs_of):
    docs = docs_of([(1, "a")])
    assert jaccard_join(docs.limit(0)).count() == 0
    long = " ".join(f"x{i}" for i in range(100_000))
    got = {r.doc_id: r.component_id for r in jaccard_join(docs_of([(5, long), (3, long + " z"), (9, "y" * 100_000)])).collect()}
    assert got == {5: 3, 3: 3, 9: 9}


def test_boundary_follows_cost():
    assert choose_boundary({n: 10 for n in range(1, 66)}, 1.0) < choose_boundary({n: 10 for n in range(1, 66)}, 20.0)
    assert choose_boundary({}, 1.0) == 2


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)} | {4000: 4000, 5000: 4000}
