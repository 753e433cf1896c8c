"""Columns that are carried through an operator and named like one of its own."""
from pyspark.sql import functions as F

from parallax.llm.byte_cnn import ByteCNN, score_quality
from parallax.llm.common import apart
from parallax.llm.decontaminate import decontaminate
from parallax.llm.substring_dedup import substring_dedup

PASSAGE = " ".join(f"w{i}" for i in range(12))
ROWS = [(1, f"a {PASSAGE} b"), (2, f"c {PASSAGE}"), (3, None), (4, "")]


def named(docs, *names):
    """docs with columns that hold the name and the doc_id."""
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])


def same(got, plain, *names):
    """The result is that of a call without the columns, and each column comes back on its row."""
    own = plain.columns
    assert got.columns == ["doc_id", *[f"{n}_carried" for n in names], *own[1:]]
    key = lambda r: r.doc_id
    assert sorted(got.select(*own).collect(), key=key) == sorted(plain.collect(), key=key)
    for r in got.collect():
        assert [r[f"{n}_carried"] for n in names] == [f"{n}-{r.doc_id}" for n in names]


def test_names(spark, docs_of):
    docs = named(docs_of(ROWS), "kept", "kept_carried")
    out, names = apart(docs, ("lang", "kept", "lang", "kept_carried"), ("doc_id", "kept"))
    assert names == ("lang", "kept_carried_carried", "kept_carried") and out.columns == ["doc_id", "text", *names]
    assert apart(docs, ("lang", "source"), ("kept",)) == (docs, ("lang", "source"))
    assert apart(docs.withColumn("Score", F.lit(1)), ("Score",), ("score",))[1] == ("Score_carried",)


def test_decontaminate(spark, docs_of):
    items = spark.createDataFrame([("x", PASSAGE), ("y", "c w0"), ("z", "none of it")], "item_id string, text string")
    names = ("n_words", "items", "text_key", "found_id")
    docs = docs_of(ROWS)
    for size in (1 << 20, 8):  # one pass and several
        same(decontaminate(named(docs, *names), items, carry=names, clean=True, block_bytes=size),
             decontaminate(docs, items, clean=True, block_bytes=size), *names)
    assert sorted(decontaminate(docs, items, carry=("text",)).select("doc_id", "text_carried").collect()) == ROWS


def test_substring_dedup(spark, docs_of):
    names = ("kept", "spans", "n_words")
    docs = docs_of(ROWS)
    same(substring_dedup(named(docs, *names), k=5, carry=names), substring_dedup(docs, k=5), *names)
    assert [r.text_carried for r in substring_dedup(docs, k=5, carry=("text", "lang")).orderBy("doc_id").collect()] == [t for _, t in ROWS]


def test_score_quality(spark, docs_of):
    docs, net = docs_of(ROWS), ByteCNN()
    same(score_quality(named(docs, "score"), net, carry=("score",)), score_quality(docs, net), "score")
    assert score_quality(docs, net, carry=("text", "lang")).columns == ["doc_id", "text", "lang", "score"]
