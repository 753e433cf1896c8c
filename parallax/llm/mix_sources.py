"""Operator 3: mixing sources to target weights by capped water-filling (DataFrame operations only).

Every source gets a target in words, in proportion to its weight; a source whose target would pass
`most` times its size is clamped there, and the excess goes to the others by weight, again until
no target is above its clamp.  A source's documents are then taken `floor(target / size)` times
whole, and a seeded part of them once more: documents are laid out by a seeded hash in bins of
about BIN_DOCS documents, whole bins are taken while they fit, and in the one bin that does not
fit the largest documents that still fit are taken first.  So each source's taken words come near
its target, no group is larger than a bin, and reruns agree.

Null and empty texts have size 0 and are never short of their part.  A null source is a source of
its own, last in order.  Rows that share source, doc_id and size are taken together.  An empty
table gives an empty result.  Columns besides doc_id, text and source are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

BIN_DOCS = 64
MOST_BINS = 1 << 16  # bins of one source; with more documents the bins grow, and none is dropped
HASH_BITS = 52
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(text, 1, HASH_BITS // 4), 16, 10).cast("double") / float(1 << HASH_BITS)


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources(weight, source_size, ...) with `target`: clamps are found in rounds, each one
    aggregate over the table of sources."""
    cap = F.col("source_size") * float(most)
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        total, open_weight, held, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap)), F.count(F.when(over, 1))
        ).first()
        if n == clamped or not open_weight:
            break
        level, clamped = ((total or 0) * share - (held or 0.0)) / open_weight, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if open_weight else cap)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) of each row of docs(doc_id, text,
    source).  Sources, by code point and null last, have the weights in turn."""
    sized = docs.select(
        "doc_id", "source", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"),
        word_count(F.col("text")).alias("size"), seeded_hash(seed, F.col("doc_id")).alias("u"),
    )
    sized = shared_table(sized, "sized")
    per = sized.groupBy("s", "no_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy("no_s", "s"))  # one row for each source
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    per = water_fill(shared_table(per, "sources"), share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("whole", whole.cast("long"))
    per = per.withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    per = per.withColumn("bins", F.least(F.lit(MOST_BINS), F.greatest(F.lit(1), F.floor(F.col("n_docs") / BIN_DOCS))))

    # one row for each source: small beside the documents; Spark decides whether it is broadcast
    rows = sized.join(per.select("s", "no_s", "source_size", "target", "whole", "need", "bins"), ["s", "no_s"])
    rows = rows.withColumn("bin", F.floor(F.col("u") * F.col("bins")))
    bins = rows.groupBy("s", "no_s", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    upto = F.sum("words").over(Window.partitionBy("s", "no_s").orderBy("bin"))
    bins = bins.withColumn("upto", upto).select(
        "s", "no_s", "bin", (F.col("upto") <= F.col("need")).alias("full"), (F.col("need") - F.col("upto") + F.col("words")).alias("rest"))
    edge = bins.filter("NOT full AND rest > 0")
    rows = rows.join(bins.select("s", "no_s", "bin", "full"), ["s", "no_s", "bin"])

    # the one bin of a source that is not taken whole: largest first, each document that still fits
    docs_of = rows.join(edge.select("s", "no_s", "bin", "rest"), ["s", "no_s", "bin"]).filter("size > 0")
    docs_of = docs_of.groupBy("s", "no_s", "bin", "rest", "u", "doc_id", "size").agg(F.sum("size").alias("all"))
    docs_of = docs_of.groupBy("s", "no_s", "bin", "rest").agg(F.sort_array(F.collect_list(F.struct(-F.col("all"), "u", "doc_id", "size"))).alias("d"))
    # a running choice: (words left, taken flags)
    chosen = F.expr("""aggregate(d, named_struct('left', rest, 'flags', array_repeat(false, 0)), (x, e) ->
        named_struct('left', IF(-e.col1 <= x.left, x.left + e.col1, x.left), 'flags', concat(x.flags, array(-e.col1 <= x.left))), x -> x.flags)""")
    picked = docs_of.select("s", "no_s", "bin", F.explode(F.arrays_zip(F.col("d"), chosen.alias("flag"))).alias("e"))
    picked = picked.select("s", "no_s", "bin", *[F.col(f"e.d.{c}").alias(c) for c in ("u", "doc_id", "size")], F.col("e.flag").alias("picked"))
    picked = picked.filter("picked").withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).drop("u", "doc_id")
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.join(picked, ["s", "no_s", "bin", "size", "key"], "left")
    repeats = F.col("whole") + (F.col("full") | F.coalesce("picked", F.lit(False))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
