"""Join semantics that the oracle does not exercise."""
import pytest
from pyspark.sql import functions as F

from parallax.operators import joins as J


def test_strict_zip_fails_on_unequal_counts(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "line_no long, x string")
    b = spark.createDataFrame([(1, "c")], "line_no long, y string")
    with pytest.raises(Exception):
        J.zip_lines(a, b, "strict").collect()
    pad = {r["line_no"]: (r["x"], r["y"]) for r in J.zip_lines(a, b, "pad").collect()}
    assert pad == {1: ("a", "c"), 2: ("b", "")}


def test_overlay_null_new_value_wins(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "k long, v int")
    new = spark.createDataFrame([(2, None), (3, 30)], "k long, v int")
    got = {r["k"]: (r["v"], r["from_new"]) for r in J.overlay_merge(old, new, "k").collect()}
    assert got == {1: (10, False), 2: (None, True), 3: (30, True)}


def test_guarded_join_drops_and_counts_mismatches(spark):
    pos = spark.createDataFrame([(1, 3, 1.0, 0), (2, 4, 2.0, 0)], "line_no long, n_words int, xent double, n_oov int")
    neg = spark.createDataFrame([(1, 3, 1.5, 0), (2, 5, 2.5, 0)], "line_no long, n_words int, xent double, n_oov int")
    assert [r["line_no"] for r in J.guarded_join(pos, neg).collect()] == [1]
    assert J.guarded_mismatches(pos, neg).first()["n_mismatch"] == 1


def test_interleave_positions(spark):
    refs = spark.createDataFrame([(l, r, f"{l}.{r}") for l in (1, 2) for r in range(4)], "line_no long, ref_no int, ref string")
    got = [r["ref"] for r in J.interleave_references(refs).orderBy("interleaved_no").collect()]
    assert got == ["1.0", "1.1", "1.2", "1.3", "2.0", "2.1", "2.2", "2.3"]
    assert J.interleave_references(refs).agg(F.max("interleaved_no")).first()[0] == 8
