"""Hand fixtures of FIXTURES.md §4: CED tagging, BLEU, strings; positional properties."""
import pytest
from pyspark.sql import functions as F

from parallax.functions import text as X
from parallax.operators import bleu as B
from parallax.operators import ced as C
from parallax.operators import mix as M
from parallax.operators import sequence as S


def _scores(spark, xs):
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(xs)], "line_no long, ced double")


@pytest.mark.parametrize("scores,k,low,high,tags", [
    ([-3, -2, -0.1, 0.2, 1, 4], 1, -3.0, 4.0, ["<2formal>", "<2unk>", "<2unk>", "<2unk>", "<2unk>", "<2informal>"]),
    ([-3, -3, 0, 3], 1, -3.0, 3.0, ["<2formal>", "<2formal>", "<2unk>", "<2informal>"]),
    ([1, 1, 1, 1], 0, None, None, ["<2unk>"] * 4),
])
def test_ced_to_tag(spark, scores, k, low, high, tags):
    df = _scores(spark, scores)
    th = C.ced_thresholds(df).first()
    assert (th["k"], th["low_threshold"], th["high_threshold"]) == (k, low, high)
    out = C.ced_to_tag(df, "formal", "informal").orderBy("line_no").collect()
    assert [r["src_tag"] for r in out] == tags
    flip = {"<2formal>": "<2informal>", "<2informal>": "<2formal>", "<2unk>": "<2unk>"}
    assert [r["tgt_tag"] for r in out] == [flip[t] for t in tags]


def test_ced_thresholds_independent_of_partitioning(spark):
    xs = [((i * 7919) % 1000) / 10.0 - 50 for i in range(3000)]
    df = _scores(spark, xs)
    ref = sorted(xs)
    for parts in (1, 3, 50):
        th = C.kth_thresholds(df.repartition(parts), 123).first()
        assert th["low_threshold"] == ref[122] and th["high_threshold"] == ref[-123]


def test_bleu_fixture(spark):
    hyps = spark.createDataFrame([("s", 1, "the cat sat on the mat today"), ("s", 2, "a b c d e")],
                                 "system string, seg_id int, hyp string")
    refs = spark.createDataFrame([("s", 1, 0, "the cat sat on a mat today"), ("s", 1, 1, "the cat was on the mat"),
                                  ("s", 2, 0, "a b c d e f g"), ("s", 2, 1, "a b c d x")],
                                 "system string, seg_id int, ref_no int, ref string")
    r = B.corpus_bleu(hyps, refs, ["system"]).first()
    assert [r[f"num{n}"] for n in range(1, 5)] == [12, 10, 6, 3]
    assert [r[f"den{n}"] for n in range(1, 5)] == [12, 10, 8, 6]
    assert (r["c"], r["r"], r["bp"]) == (12, 12, 1.0)
    assert r["bleu_raw"] == pytest.approx(78.2542, abs=1e-4)


@pytest.mark.parametrize("fn,inp,out", [
    (X.undo_subword, "foo@@ bar@@", "foobar"),
    (X.undo_subword, "a@@ b @@ c@@", "ab c"),
    (X.strip_tags, "<2formal> x <2unk> y", "x y"),
    (lambda c: X.factor_stream(c, "formal"), "  a  b ", "  <2formal>  <2formal> "),
    (lambda c: X.tag_prefix(c, "unk"), "", "<2unk> "),
    (X.normalize_all_caps, "ABC! 1", "Abc! 1"),
    (X.normalize_all_caps, "123", "123"),
    (X.normalize_all_caps, " aB ", "aB"),
    (X.n_tokens, "", 0),
    (X.n_tokens, "  a  b ", 2),
])
def test_string_fixtures(spark, fn, inp, out):
    df = spark.createDataFrame([(inp,)], "x string")
    assert df.select(fn(F.col("x")).alias("y")).first()["y"] == out


def test_positions_are_contiguous_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("text"))
    for parts in (1, 3, 17):
        got = S.with_position(df.repartition(parts), "p", order_by=["k"]).orderBy("k").select("p").collect()
        assert [r["p"] for r in got] == list(range(1, 5001))


def test_grouped_positions(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = S.with_position(df, "p", order_by=["-k"], partition_by=["g"]).collect()
    for g in range(3):
        ks = sorted((r["k"] for r in got if r["g"] == g), reverse=True)
        assert [r["p"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: -r["k"])] == list(range(1, len(ks) + 1))


def test_balanced_chunks_roundtrip(spark):
    df = spark.createDataFrame([(i, "w" * (i % 13 + 1)) for i in range(1, 400)], "line_no long, text string")
    ch = S.balanced_chunks(df, 5)
    sizes = {r["chunk"]: r["b"] for r in ch.groupBy("chunk").agg(F.sum(F.length("text") + 1).alias("b")).collect()}
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 30
    back = S.ordered_concat(ch).orderBy("out_line_no").select("line_no").collect()
    assert [r["line_no"] for r in back] == list(range(1, 400))


def test_replicate_multiplies_counts(spark):
    df = spark.range(0, 37)
    assert M.replicate(df, 10).count() == 370


def test_row_parity(spark):
    a, b = spark.range(5), spark.range(6)
    with pytest.raises(ValueError):
        S.assert_parity(a, b)
    assert S.assert_parity(a, spark.range(5)) == 5
