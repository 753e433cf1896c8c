"""Keyed and positional joins.

Spark picks the join strategy; no side is hinted for broadcast here because both sides
grow with the data.  Per-key collections (`collect_list`) are only built for groups whose
size is bounded by the reference's data model (four references per segment, one
alignment block per sentence pair).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zip_lines(a: DataFrame, b: DataFrame, mode: str = "strict", key: str = "line_no") -> DataFrame:
    """Positional join on `key`.

    `pad` (as `paste`): full outer join; where a side has no such line its string columns are ''
    and its other columns null (a null of a line that is there stays null); `truncate` (as
    `zip`): inner join on the common positions; `strict`: the same keys must be on both sides,
    else the job fails at run time (a lazy assertion, no extra action).
    """
    if mode == "truncate":
        return a.join(b, key, "inner")
    if mode not in ("pad", "strict"):
        raise ValueError(f"unknown zip mode {mode!r}")
    j = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full_outer")
    if mode == "strict":
        both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
        chk = F.assert_true(both, F.lit("zip_lines: a line is missing on one side"))
        return j.filter(chk.isNull()).drop("_in_a", "_in_b")

    def padded(c: str, flag: str, kind: str):
        return F.when(F.col(flag).isNull(), F.lit("")).otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c)

    cols = [padded(c, flag, kind) for side, flag in ((a, "_in_a"), (b, "_in_b")) for c, kind in side.dtypes if c != key]
    return j.select(key, *cols)


def guarded_join(pos: DataFrame, neg: DataFrame, key: str = "line_no", guard: str = "n_words") -> DataFrame:
    """Join two cross-entropy tables on the id and the word count.

    Rows whose word counts disagree are dropped (the reference passes them through
    corrupted); `guarded_mismatches` counts them.
    """
    p = pos.select(key, guard, F.col("xent").alias("xent_pos"), F.col("n_oov").alias("n_oov_pos"))
    n = neg.select(key, guard, F.col("xent").alias("xent_neg"), F.col("n_oov").alias("n_oov_neg"))
    return p.join(n, [key, guard], "inner")


def guarded_mismatches(pos: DataFrame, neg: DataFrame, key: str = "line_no", guard: str = "n_words") -> DataFrame:
    """J2 report: one row `n_mismatch` = rows of `pos` without a (key, guard) partner."""
    miss = pos.select(key, guard).join(neg.select(key, guard), [key, guard], "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("n_mismatch"))


def attach_references(hyps: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Hypothesis with its references as an array ordered by `ref_no` (1 or 4 per segment)."""
    per_seg = refs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ref_no", "ref"))).alias("_r"))
    per_seg = per_seg.select(*keys, F.transform("_r", lambda s: s["ref"]).alias("refs"))
    return hyps.join(per_seg, keys, "inner")


def attach_alignment(pairs: DataFrame, alignments: DataFrame, key: str = "pair_id") -> DataFrame:
    """Each pair with its alignment block (array of spans; empty when none is given)."""
    spans = alignments.groupBy(key).agg(
        F.collect_list(F.struct("start1", "len1", "start2", "len2")).alias("spans")
    )
    empty = F.array().cast("array<struct<start1:int,len1:int,start2:int,len2:int>>")
    return pairs.join(spans, key, "left").withColumn("spans", F.coalesce("spans", empty))


def pair_outputs(outputs: DataFrame, keys: list[str], style: str = "style", text: str = "text",
                 first: str = "formal", second: str = "informal") -> DataFrame:
    """The `first` and `second` style output of the same input, side by side."""
    a = outputs.filter(F.col(style) == first).select(*keys, F.col(text).alias("text1"))
    b = outputs.filter(F.col(style) == second).select(*keys, F.col(text).alias("text2"))
    return a.join(b, keys, "inner")


def overlay_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert - the new row wins where its key exists (even with null values),
    the old row is kept otherwise, new keys are added.  Columns of both sides are kept
    by name; a column missing on one side is null there."""
    new_cols = [c for c in new.columns if c != key]
    old_cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new_cols], F.lit(True).alias("_in_new"))
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old_cols])
    j = o.join(n, key, "full_outer")
    in_new = F.coalesce(F.col("_in_new"), F.lit(False))
    out = [key]
    for c in dict.fromkeys(old_cols + new_cols):
        nv = F.col(f"_n_{c}") if c in new_cols else F.lit(None)
        ov = F.col(f"_o_{c}") if c in old_cols else F.lit(None)
        out.append(F.when(in_new, nv).otherwise(ov).alias(c))
    return j.select(*out, in_new.alias("from_new"))


def rekey_vectors(new_vocab: DataFrame, old_vectors: DataFrame, key: str) -> DataFrame:
    """Carry rows of an old table over to a new key set; unmatched keys get `is_new`."""
    o = old_vectors.withColumn("_hit", F.lit(True))
    j = new_vocab.select(key).join(o, key, "left")
    return j.withColumn("is_new", F.col("_hit").isNull()).drop("_hit")


def pair_with_references(src: DataFrame, refs: DataFrame, key: str = "line_no") -> DataFrame:
    """A dev source and each of its references: one row per (key, ref_no)."""
    return src.join(refs, key, "inner")


def interleave_references(refs: DataFrame, n_refs: int = 4, key: str = "line_no", ref_no: str = "ref_no") -> DataFrame:
    """ref0..ref3 of line 1, then of line 2 ... as a new position (no shuffle)."""
    pos = (F.col(key) - F.lit(1)) * F.lit(n_refs) + F.col(ref_no) + F.lit(1)
    return refs.withColumn("interleaved_no", pos.cast("bigint"))
