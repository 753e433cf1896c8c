"""Driver tables and the derived corpus views (FIXTURES.md §3).

The reference works on corpora that are not shipped; these views play their
roles over the given tables.  Every view is lazy: filters and projections written
after them are pushed into the parquet scan by Catalyst (`lang = 'en'` reaches the
`documents` scan as a pushed filter, and only the needed columns are read).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_tokens, materialize, n_tokens

LINE_ID_STRIDE = 100000  # line_id = doc_id * stride + line_no; a longer document fails the job
TURN_STRIDE = 1000  # pair_id = conv_id * stride + turn; a longer conversation fails the job


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _below(value, stride: int, what: str):
    """`value`, or an error where it would collide with the next key."""
    return F.when(value < stride, value).otherwise(F.raise_error(F.lit(f"{what}: more than {stride - 1}")).cast("int"))


def lines(docs: DataFrame) -> DataFrame:
    """v_lines(line_id, doc_id, line_no, lang, source, text): one row per line of a document."""
    exploded = docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    line_no = _below((F.col("pos") + 1).cast("int"), LINE_ID_STRIDE, "lines of a document")
    return exploded.select(
        (F.col("doc_id") * LINE_ID_STRIDE + line_no).alias("line_id"),
        "doc_id",
        (F.col("pos") + 1).cast("int").alias("line_no"),
        "lang",
        "source",
        "text",
    )


def v_lines(spark, sf_dir) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def _english_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("lang") == "en")


def v_style(spark, sf_dir, quality: int) -> DataFrame:
    """v_pos (quality=1) / v_neg (quality=0): English lines of labelled documents.

    A left-semi join keeps the labels side as a key set only; no document row is duplicated.
    """
    lab = table(spark, sf_dir, "labels").filter(F.col("quality") == quality).select("doc_id")
    return lines(_english_docs(spark, sf_dir).join(lab, "doc_id", "left_semi"))


def v_pos(spark, sf_dir) -> DataFrame:
    return v_style(spark, sf_dir, 1)


def v_neg(spark, sf_dir) -> DataFrame:
    return v_style(spark, sf_dir, 0)


def v_pool(spark, sf_dir) -> DataFrame:
    """English lines of unlabelled documents (anti join on the label keys)."""
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return lines(_english_docs(spark, sf_dir).join(lab, "doc_id", "left_anti"))


def v_pool_e(spark, sf_dir) -> DataFrame:
    """v_pool(line_id, text) and one empty line for each of its documents (line_id = -doc_id - 1)."""
    pool = v_pool(spark, sf_dir)
    empty = pool.select("doc_id").distinct().select((-F.col("doc_id") - 1).alias("line_id"), F.lit("").alias("text"))
    return pool.select("line_id", "text").unionByName(empty)


def v_bitext(spark, sf_dir) -> DataFrame:
    """v_bitext(pair_id, src, tgt): a user turn and the assistant turn right after it.

    An equi-join on (conv_id, turn) instead of a window over a conversation: a very
    long conversation is then spread over many tasks instead of one.
    """
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    turn = _below(F.col("turn"), TURN_STRIDE, "turns of a conversation").cast("bigint")
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * TURN_STRIDE + turn).alias("pair_id"), "src", "tgt"
    )


def _lines_with_ntok(spark, sf_dir) -> DataFrame:
    return v_lines(spark, sf_dir).withColumn("nt", n_tokens("text"))


def repeated(df: DataFrame, key: str) -> DataFrame | None:
    """The values of `key` that several rows have; None if no value has (one pass over the keys alone)."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col(key).isNotNull()).select(key)
    return None if twice.isEmpty() else twice


def _joined_pairs(docs: DataFrame) -> DataFrame:
    """Pairs of the lines of documents by (doc_id, line_no): a line meets the next line of every row of its document."""
    ln = lines(docs).filter(has_tokens("text"))
    a = ln.select("doc_id", "line_no", "line_id", F.col("text").alias("text1"))
    b = ln.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("text2"))
    return a.join(b, ["doc_id", "line_no"]).select(F.col("line_id").alias("pair_id"), "text1", "text2")


def _neighbours(docs: DataFrame) -> DataFrame:
    """Pairs of the lines of documents, each document in its own row."""
    split = materialize(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), {"_l": F.split("text", "\n")})
    both = F.arrays_zip(F.col("_l").alias("text1"), F.slice("_l", 2, LINE_ID_STRIDE).alias("text2"))
    pairs = split.select("doc_id", F.posexplode(both).alias("pos", "_p")).select("doc_id", "pos", "_p.text1", "_p.text2")
    line_no = _below((F.col("pos") + 1).cast("int"), LINE_ID_STRIDE, "lines of a document")
    pairs = pairs.filter(has_tokens("text1") & has_tokens("text2"))
    return pairs.select((F.col("doc_id") * LINE_ID_STRIDE + line_no).alias("pair_id"), "text1", "text2")


def v_pairs(spark, sf_dir) -> DataFrame:
    """v_pairs(pair_id, text1, text2): a line and the next line of its document, both with tokens.

    pair_id is the first line's line_id.  A document is one row, so its lines meet there and no text
    is shuffled; only rows that share their doc_id are joined on (doc_id, line_no).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    twice = repeated(docs, "doc_id")
    if twice is None:
        return _neighbours(docs)
    once, many = (docs.join(twice, "doc_id", how) for how in ("left_anti", "left_semi"))
    return _neighbours(once).unionByName(_joined_pairs(many))


N_REFS = 4  # references of a hypothesis


def _joined_hyps_refs(docs: DataFrame):
    """Hypotheses and references by (doc_id, line_no): a line meets the next lines of every row of its document."""
    ln = lines(docs).select("doc_id", "line_no", "line_id", "source", "text")
    last = ln.select("doc_id", (F.col("line_no") - N_REFS).alias("line_no"))
    hyps = ln.join(last, ["doc_id", "line_no"], "left_semi").select(
        F.col("source").alias("system"), F.col("line_id").alias("seg_id"), F.col("text").alias("hyp"),
        "doc_id", "line_no",
    )
    offs = F.explode(F.sequence(F.lit(1), F.lit(N_REFS))).alias("off")
    want = hyps.select("system", "seg_id", "doc_id", (F.col("line_no")).alias("base"), offs)
    want = want.select(
        "system", "seg_id", "doc_id", (F.col("base") + F.col("off")).alias("line_no"),
        (F.col("off") - 1).alias("ref_no"),
    )
    refs = want.join(ln.select("doc_id", "line_no", F.col("text").alias("ref")), ["doc_id", "line_no"]).select(
        "system", "seg_id", "ref_no", "ref"
    )
    return hyps.select("system", "seg_id", "hyp"), refs


def _own_hyps_refs(docs: DataFrame):
    """Hypotheses and references of documents, each document in its own row."""
    split = materialize(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", "text"), {"_l": F.split("text", "\n")})
    n = _below(F.size("_l"), LINE_ID_STRIDE, "lines of a document")
    first = lambda at: F.slice("_l", at, F.greatest(n - N_REFS, F.lit(0)))
    own = [F.col("source").alias("system"), (F.col("doc_id") * LINE_ID_STRIDE + (F.col("pos") + 1)).alias("seg_id")]
    hyps = split.select("doc_id", "source", F.posexplode(first(1)).alias("pos", "hyp")).select(*own, "hyp")
    beside = F.arrays_zip(*[first(2 + i).alias(f"r{i}") for i in range(N_REFS)])
    refs = split.select("doc_id", "source", F.posexplode(beside).alias("pos", "_p"))
    return hyps, refs.select(*own, F.posexplode(F.array(*[f"_p.r{i}" for i in range(N_REFS)])).alias("ref_no", "ref"))


def v_hyps_refs(spark, sf_dir):
    """(v_hyps(system, seg_id, hyp), v_refs(system, seg_id, ref_no, ref)).

    hyp = line k, refs = lines k+1..k+4 of the same document (all four must exist);
    system = the document source.  A document is one row, so its lines meet there; only rows that
    share their doc_id are joined on (doc_id, line_no).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    twice = repeated(docs, "doc_id")
    if twice is None:
        return _own_hyps_refs(docs)
    once, many = (docs.join(twice, "doc_id", how) for how in ("left_anti", "left_semi"))
    return tuple(a.unionByName(b) for a, b in zip(_own_hyps_refs(once), _joined_hyps_refs(many)))


def v_score(spark, sf_dir) -> DataFrame:
    """v_score(line_id, ced): a given score column for the CED tagging slice."""
    ln = _lines_with_ntok(spark, sf_dir).filter(F.col("nt") > 0)
    ced = F.round(F.length("text") / F.col("nt") - F.lit(6.0), 6)
    return ln.select("line_id", ced.alias("ced"), "text")


def v_text(spark, sf_dir) -> DataFrame:
    """(line_id, doc_id, line_no, source, text): the lines of all documents, in every language."""
    return v_lines(spark, sf_dir).select("line_id", "doc_id", "line_no", "source", "text")
