import math
import re
import zlib
from collections import Counter

import numpy as np

from parallax.llm.common import SPACE_WORDS, Words
from parallax.llm.maxent_lm import END, OUTPUTS, OWN, PENALTY, SLOTS, MaxEnt, fit_pairs, lm_scores, shared_slot

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, x in rows:
        w = tokens(x)
        out[i] = (held[i], len(w), sum(count[t] > 0 for t in w), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w))
    return out


def check(rows, got):
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9, abs_tol=1e-6)
        assert math.isfinite(r.score) and r.score < 0


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scores(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    print("log10 a token, held out: base", sum(r.base_score for r in held) / n, "model", sum(r.score for r in held) / n)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    known = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    net = MaxEnt(known[:OWN], [rng.standard_normal(s).astype(np.float32) for s in ((1 << 13, OUTPUTS // SLOTS), (1 << 13, SLOTS))])
    out = net.outputs(known)
    assert list(out[:OWN]) == list(range(OWN)) and (out[OWN:] == shared_slot(known[OWN:])).all()
    first = np.array([np.flatnonzero(out == o)[0] for o in np.unique(out)])
    assert len(first) == OUTPUTS
    for history in ([], [5], [7, 9, 11, 2]):
        p = 0.0
        for t in first:
            token = np.array([*history, t])
            p += 10 ** net.log10(token, np.array([len(token)]), known)[-1]
        assert abs(p - 1) < 1e-4


def test_odd_rows(spark, docs_of):
    rows = [(i, "A b  c\nd" if i % 2 else f"x{i} b") for i in range(40)] + [(100, None), (101, ""), (None, "lone B"), (103, "b " * 100_000)]
    check(rows, lm_scores(docs_of(rows, 3)).collect())
    twice = lm_scores(docs_of([(1, "a b"), (1, "a b")])).collect()
    assert len(twice) == 2 and twice[0].train_tokens == 6 and twice[0].score == twice[1].score
    assert lm_scores(docs_of(rows).limit(0)).count() == 0
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    assert all(r.n_known == 0 for r in lm_scores(docs_of([(i, "a") for i in only_held])).collect())


def climb(n, q, penalty=PENALTY):
    """Weights of one group by plain coordinate steps to the end: the gradient of each is bisected."""
    x, total = [0.0] * len(n), sum(n)
    for _ in range(60):
        for i, c in enumerate(n):
            if not c:
                continue
            rest = 1 + sum(b * math.expm1(y) for j, (b, y) in enumerate(zip(q, x)) if j != i) - q[i]
            low, high = -20.0, 20.0
            for _ in range(60):
                mid = (low + high) / 2
                p = q[i] * math.exp(mid) / (rest + q[i] * math.exp(mid))
                low, high = (mid, high) if c - total * p - penalty * mid > 0 else (low, mid)
            x[i] = low
    z = 1 + sum(b * math.expm1(y) for b, y in zip(q, x))
    return [y - math.log(z) for y in x]


def test_pair_weights_reach_the_top():
    groups = [([1], [0.01]), ([3, 0, 1], [0.2, 0.1, 1e-4]), ([0, 0], [0.3, 0.1]), ([40, 7, 7, 1], [1e-3, 0.5, 0.01, 0.2]), ([2000], [0.4])]
    begin = np.cumsum([0] + [len(n) for n, _ in groups])[:-1]
    got = fit_pairs(begin, np.concatenate([n for n, _ in groups]), np.concatenate([q for _, q in groups]))
    want = [g for n, q in groups for g in climb(n, q)]
    assert np.allclose(got, want, atol=2e-3)
    assert len(fit_pairs(np.zeros(0, int), np.zeros(0), np.zeros(0))) == 0


def test_last_factor_equals_brute_force(spark, docs_of):
    """Without training rounds the first two factors are even; the last one is computed plainly."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{min(int(x), 1500)}" for x in rng.zipf(1.2, 60))) for i in range(120)]
    rows += [(200, None), (201, "W7 w1400  w1400 never seen"), (201, "w7 w1400 w1400"), (None, "w3 w1499")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in lm_scores(docs_of(rows, 4), rounds=0).collect())

    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [tokens(x) for _, x in rows]
    words = sorted({t for x in texts for t in x[:-1]})
    joined = "".join(words).encode()
    offs = np.cumsum([0] + [len(w) for w in words])
    name = dict(zip(words, Words(np.frombuffer(joined, np.uint8), offs, SPACE_WORDS).hashes())) | {None: END}
    count = Counter(t for h, x in zip(held, texts) if not h for t in x)
    signed = {w: int(np.uint64(h).astype(np.int64)) for w, h in name.items()}
    top = set(sorted(count, key=lambda w: (-count[w], signed[w]))[:OWN])
    slot = {w: int(shared_slot(np.array([h]))[0]) for w, h in name.items() if w not in top}
    n_slot, v_slot = Counter(), Counter()
    for w, s in slot.items():
        n_slot[s] += count[w]
        v_slot[s] += count[w] > 0
    q = {w: (count[w] + 0.1) / (n_slot[s] + 0.1 * (v_slot[s] + 1)) for w, s in slot.items()}
    pair = Counter()
    for h, x in zip(held, texts):
        for v, w in zip(["<start>", *x], x):
            if w in slot:
                pair[v, w] += not h
    groups = {}
    for v, w in pair:
        groups.setdefault((v, slot[w]), []).append(w)
    gain = {}
    for (v, _), ws in groups.items():
        gain |= {(v, w): g for w, g in zip(ws, climb([pair[v, w] for w in ws], [q[w] for w in ws]))}
    assert any(len(ws) > 1 for ws in groups.values()) and any(not n for n in pair.values())
    want = []
    for (i, _), x in zip(rows, texts):
        s = -len(x) * math.log10(OUTPUTS) + sum(math.log10(q[w]) + gain[v, w] / math.log(10) for v, w in zip(["<start>", *x], x) if w in slot)
        want.append((-1 if i is None else i, len(x), s))
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-4 * a[1]), (a, b)
