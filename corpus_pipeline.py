"""A training corpus in five stages over the `documents` table.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.byte_cnn import score_quality, train_quality
from parallax.llm.common import shared_path
from parallax.llm.decontaminate import decontaminate
from parallax.llm.jaccard_join import jaccard_join
from parallax.llm.mix_sources import mix_sources, word_count
from parallax.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY = 0.3  # a lower score is rejected


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of QUALITY or more stay."""
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select(*COLUMNS), model, carry=("text", "lang", "source", "n_chars"))
    return scored.filter(F.col("score") >= QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once; a
    document without doc_id cannot be told from others and stays."""
    kept = jaccard_join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that stand earlier are cut; a document of which nothing is left goes."""
    kept = substring_dedup(docs.select(*COLUMNS), k=20, carry=("lang", "source", "n_chars"), joined=False)
    text = F.col("kept")
    kept = kept.filter("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of benchmark windows are cut; a document of which no word is left goes."""
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"), k=10, carry=("lang", "source", "n_chars"), clean=True)
    found = found.filter("n_hit < n_words OR n_words = 0")
    changed = F.col("n_hit") > 0
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; `copy` numbers the repetitions from 0."""
    mix = mix_sources(docs).select("doc_id", "source", "size", "repeats").distinct()
    mix = mix.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "repeats").filter("repeats > 0")
    docs = docs.select(*COLUMNS)
    same = docs.doc_id.eqNullSafe(mix.m_id) & docs.source.eqNullSafe(mix.m_source) & (word_count(docs.text) == mix.m_size)
    copies = F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1)).alias("copy")
    return docs.join(mix, same).select(*COLUMNS, "repeats", copies)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources", mixture),
]

#: The trained classifier of the first stage cannot be said in SQL; the stages are tested against
#: brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir; each result is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
