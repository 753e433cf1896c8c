"""Round 3: guarded rules, pairs without a shuffle, chunk search over shared tokens, streamed interpolation."""
import random

import pytest
from pyspark.sql import functions as F

from parallax.functions import rules as R
from parallax.functions import text as X
from parallax.operators import lepod as L
from parallax.operators import lm as LM
from parallax.sources import io as IO
from parallax.sources import tables as T

PIECES = ["a", "B", "é", "7", " ", "  ", "\t", "\r", "\n", "(", ")", "%", ":", ";", ",", ".", "..", "!", "?", "-", "'", "''", '"', "„", "“", "–", "—", "´", "‘", "’", "‚", "…",
          " « ", "»", " ", " ", "\x0b"]


def _texts(n=400):
    draw = random.Random(3)
    return ["".join(draw.choices(PIECES, k=draw.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("rules", [R.PUNCT_RULES_COMMON + R.PUNCT_RULES_EN, R.PUNCT_RULES_COMMON + R.PUNCT_RULES_OTHER, *map(R.tokenize_rules, ("en", "fr", "de")), R.DETOKENIZE_RULES])
def test_guards_change_nothing(spark, rules):
    plain = F.col("t")
    for pattern, repl in rules:
        plain = F.regexp_replace(plain, pattern, repl)
    df = spark.createDataFrame([(x,) for x in [*_texts(), None]], "t string").select(X._apply_rules("t", rules).alias("a"), plain.alias("b"))
    assert df.filter("NOT a <=> b").count() == 0


def test_rules_are_few_stretches():
    found = R.guarded(R.PUNCT_RULES_COMMON)
    assert len(found) == 4 and all(trace for trace, _ in found)
    assert [rule for _, own in found for rule in own] == R.PUNCT_RULES_COMMON


def test_pairs_move_no_text(spark, tmp_path):
    rows = [(1, "en", "s", "a\nb\n\nc\nd"), (2, "en", "s", "x"), (None, "en", "s", "n\nm"), (3, None, None, None), (4, "en", "s", " \ny\nz")]
    schema = "doc_id long, lang string, source string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = T.v_pairs(spark, str(tmp_path))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, pairs.collect()))
    assert got == [(100001, "a", "b"), (100004, "c", "d"), (400002, "y", "z")]
    spark.createDataFrame([*rows, (1, "en", "s", "a\nB")], schema).write.parquet(f"{tmp_path}/two/documents.parquet")
    got = sorted(map(tuple, T.v_pairs(spark, f"{tmp_path}/two").collect()))
    assert got == [(100001, "a", "B"), (100001, "a", "B"), (100001, "a", "b"), (100001, "a", "b"), (100004, "c", "d"), (400002, "y", "z")]


def test_chunks_of_pairs_with_and_without_a_choice(spark):
    draw = random.Random(5)
    lists = [([draw.choice("abcdefghijkl") for _ in range(draw.randrange(12))], [draw.choice("abcdefghijkl") for _ in range(draw.randrange(12))]) for _ in range(200)]
    known: dict = {}
    one, two = (L._Side([p[k] for p in lists], known) for k in (0, 1))
    at1, at2 = L._by_chunks(one, two, len(known))
    got = [(int(one.pair[i]), int(one.place[i]), int(two.place[j])) for i, j in zip(at1, at2)]
    assert got == [(p, i, j) for p, (a, b) in enumerate(lists) for i, j in L.fewest_chunks(a, b)]
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "a"]), (2, None, ["a"]), (3, ["a", None], [])], "pair_id long, t1 array<string>, t2 array<string>")
    assert [(r.pair_id, r.start1, r.start2) for r in L.exact_align(df).collect()] == [(1, 0, 0), (1, 2, 1)]


def test_reindex_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, [3, None, -1, 0]), (2, None), (3, []), (4, [None, 5])], "pair_id long, a array<int>")
    assert {r.pair_id: r.i for r in L.reindex_aligned(df, {"i": "a"}).collect()} == {1: [0, None, None, 1], 2: None, 3: [], 4: [None, 0]}


def test_model_moves_neither_context_nor_tail(spark):
    """Each order sums to 1 over the words behind a context, across batches of the streamed pass."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        corpus = spark.createDataFrame([(i, f"a w{i % 3} a b\x01 w{i % 5} a b w{i % 2}") for i in range(30)], "line_no long, text string")
        model = {r.ngram: r for r in LM.train_ngram_lm(corpus, "text", 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    words = [g for g, r in model.items() if r.n == 1 and r.log_p is not None]

    def p(context, w):
        g = f"{context} {w}".strip()
        if g in model and model[g].log_p is not None:
            return 10 ** model[g].log_p
        shorter = " ".join(context.split(" ")[1:])
        return 10 ** (model[context].log_b or 0.0) * p(shorter, w)

    for context in [g for g, r in model.items() if r.log_b is not None]:
        assert abs(sum(p(context, w) for w in words) - 1) < 1e-6, context


def test_columns_made_behind_the_shuffle(spark, tmp_path):
    df = spark.range(50).selectExpr("49 - id AS k", "concat('t', id) AS t")
    IO.write_columns(df, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, ["k"], partitions=3, made={"a": F.concat("t", F.lit("x")), "b": F.col("k")})
    read = lambda x: [r.text for r in IO.read_lines(spark, f"{tmp_path}/{x}").orderBy("file", "line_no").collect()]
    assert read("b") == [str(k) for k in range(50)] and read("a") == [f"t{49 - k}x" for k in range(50)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
