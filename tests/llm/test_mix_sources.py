import math
import random
import re

import pytest

from parallax.llm.mix_sources import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(sizes, weights, share, most):
    """Capped water-filling in plain rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: weight[s] * left / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def rows_of(seed, sources, n=900):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 20, 100, 300)))), rng.choice(sources)) for i in range(n)]
    return rows + [(n, None, sources[0]), (n + 1, "", sources[-1]), (n + 2, "x " * 3000, sources[0])]


@pytest.mark.parametrize("seed,sources", [(1, ["a"] * 8 + ["b", "c", "é", None]), (2, list("abcdefghij")), (3, ["only"])])
def test_targets_and_taken_words(spark, docs_of, seed, sources):
    rows = rows_of(seed, sources)
    docs = docs_of(rows, 5)
    got = mix_sources(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size(dict((i, t) for i, t, _ in rows)[r.doc_id])
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.repeats * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(25, 0.01 * want[s]), (s, n, want[s])
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    other = {(r.doc_id, r.taken) for r in mix_sources(docs, seed="other").collect()}
    assert len(set(s for s in sources)) == 1 or other != again


def test_repeated_rows_nulls_and_empty_table(spark, docs_of):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (None, "d e", None), (2, None, "t")]
    got = mix_sources(docs_of(rows)).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)
    assert len({(r.doc_id, r.source, r.taken) for r in got}) == 3
    assert mix_sources(docs_of(rows).limit(0)).count() == 0
    assert [r.taken for r in mix_sources(docs_of([(1, "", "s"), (2, None, None)])).collect()] == [0, 0]
