import random
from collections import Counter

from parallax.operators import bleu as B
from parallax.sources import tables as T


def _grams(text, n):
    w = text.encode().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def _brute(hyp, refs):
    """num and den of one hypothesis, its length and the closest reference length."""
    out = {}
    for n in range(1, 5):
        own, most = _grams(hyp, n), Counter()
        for r in refs:
            most |= _grams(r, n)
        out[f"num{n}"], out[f"den{n}"] = sum((own & most).values()), sum(own.values())
    hl = len(hyp.encode().split())
    return out | {"hl": hl, "rl": min((abs(len(r.encode().split()) - hl), len(r.encode().split())) for r in refs)[1] if refs else 0}


def test_segments_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda: rng.choice(["", " ", " a"]) if rng.random() < 0.1 else rng.choice([" ", "\t", "\n "]).join(rng.choice("aAbcéÉ") for _ in range(rng.randrange(12)))
    hyps = [("s", i % 50, None if i == 7 else text()) for i in range(80)]  # some segments have several
    refs = [("s", rng.randrange(52), i % 3, None if i == 9 else text()) for i in range(150)]
    h = spark.createDataFrame(hyps, "system string, seg_id long, hyp string").repartition(3)
    r = spark.createDataFrame(refs, "system string, seg_id long, ref_no int, ref string")
    tests = {"all": (None, False), "first": ([0], False), "low": (None, True)}
    names = ["test_id", "seg_id", "scored", "hl", "rl", *B.COUNTS]

    def want(name, seg, hyp):
        numbers, low = tests[name]
        case = str.lower if low else str
        mine = [case(x) for _, s, no, x in refs if s == seg and x is not None and (numbers is None or no in numbers)]
        got = _brute(case(hyp or ""), mine)
        return (name, seg, hyp is not None and bool(mine), *[got[c] for c in names[3:]])

    for wanted in (list(tests), ["low"], ["first"]):
        got = B.segment_statistics(h, r, ["system"], {t: tests[t] for t in wanted}).select(*names).collect()
        assert sorted(map(tuple, got)) == sorted(want(t, seg, x) for t in wanted for _, seg, x in hyps)


def test_hypotheses_meet_references_without_a_join(spark, tmp_path):
    text = lambda i, n: "\n".join(f"d{i} l{k}" for k in range(n))
    rows = [(i, text(i, n), "en", "ab"[i % 2]) for i, n in enumerate([0, 1, 4, 5, 6, 9])] + [(20, None, "en", "a"), (None, text(21, 7), "en", "a")]
    for name, more in (("once", []), ("twice", [(5, text(30, 7), "fr", None), (3, text(3, 5), "en", "b")])):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = T.table(spark, f"{tmp_path}/{name}", "documents")
        found = T.v_hyps_refs(spark, f"{tmp_path}/{name}")
        for got, want in zip(found, T._joined_hyps_refs(docs)):
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
            if name == "once":
                assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
