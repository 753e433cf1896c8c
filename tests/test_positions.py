"""Positions, selections and thresholds: any number of partitions, null scores, both selection plans."""
import random

import pytest
from pyspark.sql import functions as F

from parallax.caches import release
from parallax.operators import ced as C
from parallax.operators import sequence as S


@pytest.fixture(autouse=True)
def released(spark):
    yield
    release(spark)


def scored(spark, n=500, nulls=30, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if i < nulls else round(rng.gauss(0, 3), 1)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "line_no long, ced double").repartition(5)


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_positions_for_any_partition_count(spark, buckets):
    rows, df = scored(spark)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
    got = {r.line_no: r.pos for r in S.with_position(df, "pos", ["ced", "line_no"], buckets=buckets).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    down = sorted((r for r in rows), key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))
    got = {r.line_no: r.pos for r in S.with_position(df, "pos", ["-ced", "-line_no"], base=0, buckets=buckets).collect()}
    assert got == {r[0]: k for k, r in enumerate(down)}
    got = {(r.g, r.pos): r.line_no for r in S.with_position(
        df.withColumn("g", F.when(F.col("line_no") % 7 > 0, F.col("line_no") % 7)), "pos", ["line_no"], partition_by=["g"], buckets=buckets).collect()}
    assert got == {((r % 7) or None, r // 7 + (1 if r % 7 == 0 else 1)): r for r in range(500)}


def test_no_job_while_building(spark):
    _, df = scored(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "plans only")
    S.rank_by_score(df)
    S.seeded_shuffle(df)
    S.balanced_chunks(df.withColumn("text", F.lit("abc")), 4)
    assert not tracker.getJobIdsForGroup("build-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n", [1, 40, 470, 600])
def test_both_selection_plans_agree(spark, n):
    rows, df = scored(spark)
    have = [r for r in rows if r[1] is not None]
    low = sorted(have, key=lambda r: (r[1], r[0]))[:n]
    high = sorted(have, key=lambda r: (-r[1], -r[0]))[:n]
    for most in (10_000, 0):  # a TakeOrdered, and the numbered sort
        assert [tuple(r) for r in S.select_lowest(df, n, max_take=most).collect()] == low
        assert [tuple(r) for r in S.select_highest(df, n, max_take=most).collect()] == high


@pytest.mark.parametrize("partitions", [1, 4])
def test_thresholds_leave_null_scores_out(spark, partitions):
    rows = [(i, float(i - 50)) for i in range(101)] + [(1000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "line_no long, ced double").repartition(partitions)
    r = C.kth_thresholds(df, 40).first()
    assert (r.low_threshold, r.high_threshold) == (-11.0, 11.0)
    tagged = {x.line_no: x.src_tag for x in C.ced_to_tag(df, "formal", "informal").collect()}
    assert all(tagged[1000 + i] == "<2unk>" for i in range(30)) and tagged[0] == "<2formal>" and tagged[100] == "<2informal>"
    assert C.kth_thresholds(df, 0).first().low_threshold is None
    assert C.kth_thresholds(df.filter("ced IS NULL"), 3).first().low_threshold is None


def test_release_drops_what_was_kept(spark):
    _, df = scored(spark)
    S.rank_by_score(df).count()
    assert release(spark) >= 1 and release(spark) == 0
