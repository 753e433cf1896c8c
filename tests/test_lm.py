"""Stored language models: trained once, scored by joins that do not move them."""
import math

import numpy as np
import pyarrow as pa

from parallax.operators import lm as LM
from parallax.operators import parcels as PA


def corpus(spark, n=40, step=3):
    return spark.createDataFrame([(i, f"the w{i % 5} saw a w{i % step} and the w{(i * 7) % 11}") for i in range(n)], "line_no long, text string")


def test_one_model_scores_several_pools(spark):
    model = LM.train_ngram_lm(corpus(spark), "text", 3)
    pools = [corpus(spark, 25, 4), corpus(spark, 10, 2)]
    got = [{r.line_no: r.logprob for r in LM.lm_score(p, model, order=3).collect()} for p in pools]
    both = pools[0].unionByName(pools[1].selectExpr("line_no + 100 AS line_no", "text"))
    again = {r.line_no: r.logprob for r in LM.lm_score(both, model, order=3).collect()}
    assert set(again) == {*got[0], *(k + 100 for k in got[1])}
    assert all(math.isclose(again[k], v) for k, v in got[0].items()) and all(math.isclose(again[k + 100], v) for k, v in got[1].items())


def test_model_is_not_shuffled_again(spark):
    """Both models are scanned by bucket; the only exchange below their joins is that of the looked-up n-grams."""
    pos, neg = (LM.train_ngram_lm(corpus(spark, 40, k), "text", 2) for k in (3, 4))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        plan = LM.score_segments(corpus(spark), [pos, neg], "text", "line_no", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Bucketed: true") == 2
    assert plan.count("hashpartitioning(ngram#") == 1


def test_plans_do_not_grow_with_the_order(spark):
    lines = [len(LM.train_ngram_lm(corpus(spark, 12), "text", k)._jdf.queryExecution().analyzed().toString().splitlines()) for k in (2, 5)]
    assert lines[0] == lines[1] <= 3


def test_odd_corpora(spark):
    empty = spark.createDataFrame([], "line_no long, text string")
    model = LM.train_ngram_lm(empty, "text", 3)
    assert LM.lm_score(corpus(spark, 3), model, order=3).count() == 3
    model = LM.train_ngram_lm(spark.createDataFrame([(1, None), (2, "a"), (3, "")], "line_no long, text string"), "text", 3)
    got = {r.line_no: (r.n_words, r.n_oov) for r in LM.lm_score(spark.createDataFrame([(1, None), (2, " a\u00a0b a "), (3, "a " * 70_000)], "line_no long, text string"), model, order=3).collect()}
    assert got == {1: (0, 0), 2: (2, 1), 3: (70_000, 0)}
    assert LM.lm_score(empty, model, order=3).count() == 0


def test_scoring_keeps_nothing_in_memory_and_gathers_no_lists(spark):
    """A pack's rows come back one pack at a time; packs are staged."""
    from parallax import caches

    model = LM.train_ngram_lm(corpus(spark), "text", 2)
    kept = len(caches._KEPT)
    plan = LM.lm_score(corpus(spark), model, order=2)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan and len(caches._KEPT) == kept


def test_training_stages_only_the_model(spark):
    from parallax import caches

    before = len(caches._STAGED)
    LM.train_ngram_lm(corpus(spark), "text", 3)
    assert [table is not None for _, _, table in caches._STAGED[before:]] == [True]


def test_only_ngrams_of_known_pairs_are_looked_up(spark):
    """`a b c` goes on as both of its pairs are known, `b c d` does not."""
    keys, first = pa.array([7], pa.int64()), [0, 6]
    block = LM.Coded()
    block.add("a b c d")
    (words, names, _), (pairs, two, _) = block.grams(2)
    codes = np.concatenate([words, np.where(pairs < 0, -1, pairs + len(names))])
    grams = [*names, *two]
    pack = pa.table({"pack": pa.array([1], pa.int64()), "keys": pa.array([keys.to_pylist()], pa.list_(pa.int64())), "first": pa.array([first], pa.list_(pa.int32())),
                     "codes": pa.array([codes.tolist()], pa.list_(pa.int32())), "words": [[w.decode() for w in names]]})
    hits = [grams.index(g) for g in (b"a", b"b", b"c", b"a b", b"b c", b"<s> a")]
    out = LM._pruned(4)(pack, pa.table({"of": pa.array([1] * len(hits), pa.int64()), "i": pa.array(hits, pa.int32())}))
    assert out.column("grams")[0].as_py() == ["a", "b", "c", "<s> a", "a b", "b c", "<s> a b", "a b c", "<s> a b c"]
    table = np.array(out.column("codes")[0].as_py()).reshape(4, -1)
    assert table[0].tolist() == [-1, 0, 1, 2, -1, -1] and (table[1:, 4:] == -1).all() and table[3].tolist() == [-1, -1, -1, 8, -1, -1]


def test_parcels_and_buckets(spark):
    words = ["a", "ab", "abc", "abcd", "", "é x", "<s> the longer word é", "x" * 1001]
    want = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("pmod(hash(w), 17)").collect()]
    assert PA.bucket_of(pa.array(words), 17).tolist() == want == PA.bucket_of(pa.array(["zz", *words]).slice(1), 17).tolist()
    part = np.array([3, 1, 3, 1, 3, 1, 3, 1])
    rows = {}
    for p, parcel in PA.packed(part, pa.array(words), np.arange(8), np.arange(8) / 3):
        names, i, x = PA.unpacked(parcel, np.int64, np.float64)
        rows |= {(p, name): (k, y) for name, k, y in zip(names.to_pylist(), i, x)}
    assert rows == {(p, w): (k, k / 3) for k, (p, w) in enumerate(zip(part, words))}
