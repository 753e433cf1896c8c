"""Order statistics by splitter refinement, and plans that do not grow with the scores' own plan."""
import random

import pytest
from pyspark.sql import functions as F

from parallax.caches import release
from parallax.operators import ced as C
from parallax.operators import lm as LM
from parallax.operators import selection


def plan_lines(df) -> int:
    return len(df._jdf.queryExecution().analyzed().toString().splitlines())


@pytest.fixture
def small(monkeypatch):
    """Sizes at which a thousand rows need several rounds."""
    monkeypatch.setattr(selection, "SPLITTERS", 5)
    monkeypatch.setattr(selection, "SAMPLE", 40)
    monkeypatch.setattr(selection, "SMALL", 10)


def draws(kind: str, rng: random.Random, n: int):
    return {
        "even": [rng.uniform(-3, 3) for _ in range(n)],
        "steep": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "ties": [float(rng.choice((0, 0, 0, 0, 1, 2, -5))) for _ in range(n)],
        "third": [0.25 if rng.random() < 0.4 else rng.uniform(0, 0.5) for _ in range(n)],
        "same": [7.0] * n,
    }[kind]


@pytest.mark.parametrize("kind", ["even", "steep", "ties", "third", "same"])
def test_kth_smallest(spark, small, kind):
    rng = random.Random(kind)
    values = draws(kind, rng, 1500)
    rows = [(v,) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "s double").repartition(7)
    ordered = sorted(values)
    ranks = [1, 2, 100, 749, 1499, 1500, 0, 1501]
    assert selection.kth_smallest(df, ranks, "s") == [ordered[r - 1] if 1 <= r <= 1500 else None for r in ranks]


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "s double")
    assert selection.kth_smallest(df, [1], "s") == [None]
    row = C.ced_thresholds(df, "s").first()
    assert (row["k"], row["low_threshold"], row["high_threshold"]) == (0, None, None)


def test_tagging_reads_its_input_once(spark):
    """The plan of the tags is as long for a two-model CED as for given scores."""
    lines = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x") for i in range(60)], "line_id long, text string")
    given = lines.select("line_id", (F.col("line_id") / 7 - 4).alias("ced"))
    shallow = C.ced_to_tag(given, "formal", "informal")
    scored = LM.ced(lines, LM.train_ngram_lm(lines, "text", 2), LM.train_ngram_lm(lines.filter("line_id % 2 = 0"), "text", 2), "text", "line_id", 2)
    deep = C.ced_to_tag(scored.select("line_id", "ced"), "formal", "informal")
    assert plan_lines(deep) == plan_lines(shallow) < 15
    thresholds = C.ced_thresholds(scored.select("ced"))
    assert plan_lines(thresholds) < 5
    assert {r[0] for r in deep.select("src_tag").distinct().collect()} <= {"<2formal>", "<2informal>", "<2unk>"}
    assert deep.count() == 60


def test_release_deletes_what_was_staged(spark):
    from parallax.caches import stage

    table = stage(spark.range(5).toDF("x"), "some")
    path = table.inputFiles()[0]
    assert table.count() == 5 and release(spark) >= 1
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
