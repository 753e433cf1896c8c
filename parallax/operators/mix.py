"""Training mixtures: unions, replication, direction swap, tagged unions.

The reference appends files in order; here every part keeps an explicit `part` ordinal
(and a `copy` number for replicas) so that the order is data, not an accident of
partitioning.  All operators are projections + `unionByName` (no shuffle), except
`combine_domains` (one small offset aggregate) and `distinct_rows`.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import factor_stream, tag_prefix


def concat_corpora(dfs: list[DataFrame], part: str = "part") -> DataFrame:
    """Append corpora in order; `part` = 1-based ordinal of the input."""
    tagged = [d.withColumn(part, F.lit(i + 1)) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def replicate(df: DataFrame, n: int, copy: str = "copy") -> DataFrame:
    """N copies of every row (`copy` = 1..n); a generator, no shuffle."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(n))))


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Unique whole rows (or unique `cols`), as `sort -u`; partial aggregation map-side."""
    return df.select(*cols).distinct() if cols else df.distinct()


def bidirectional(
    bitext: DataFrame, tag1: str, tag2: str, mode: str = "tag", a: str = "a", b: str = "b", key: str = "line_no"
) -> DataFrame:
    """A->B rows (part 1) followed by B->A rows (part 2).

    The source is tagged with the wanted (target) style for `tag*` modes, the target too
    for `tag`; `*factor*` / `*decoder*` / `block*` modes put a factor stream beside the source.
    Output: (part, key, src, tgt[, factor]).
    """
    factor = "factor" in mode or "decoder" in mode or mode.startswith("block")

    def side(part, s, t, s_tag, t_tag):
        cols = {"part": F.lit(part), key: F.col(key)}
        cols["src"] = tag_prefix(s, s_tag) if mode.startswith("tag") else F.col(s)
        cols["tgt"] = tag_prefix(t, t_tag) if mode == "tag" else F.col(t)
        if factor:
            cols["factor"] = factor_stream(s, s_tag)
        return bitext.select(*[v.alias(k) for k, v in cols.items()])

    return side(1, a, b, tag2, tag1).unionByName(side(2, b, a, tag1, tag2))


def identity_pairs(bitext: DataFrame, a: str = "a", b: str = "b", key: str = "line_no") -> DataFrame:
    """U4: A->A (part 1) and B->B (part 2) rows."""
    one = bitext.select(F.lit(1).alias("part"), key, F.col(a).alias("src"), F.col(a).alias("tgt"))
    two = bitext.select(F.lit(2).alias("part"), key, F.col(b).alias("src"), F.col(b).alias("tgt"))
    return one.unionByName(two)


def multitask_mix(
    transfer: DataFrame, bitext: DataFrame, upsampling: int, tag1: str, tag2: str,
    a: str = "a", b: str = "b", key: str = "line_no", src: str = "src", tgt: str = "tgt",
) -> DataFrame:
    """`upsampling` copies of the tagged transfer rows (both directions, both sides tagged)
    followed by the bitext with `<2unk> ` on both sides.  Output (part, copy, key, src, tgt)."""
    tr = replicate(bidirectional(transfer, tag1, tag2, "tag", a, b, key), upsampling)
    bt = bitext.select(
        F.lit(3).alias("part"), F.lit(1).alias("copy"), key,
        tag_prefix(src, "unk").alias("src"), tag_prefix(tgt, "unk").alias("tgt"),
    )
    return tr.select("part", "copy", key, "src", "tgt").unionByName(bt)


def style_mix(
    st: DataFrame, ad: DataFrame, tag1: str, tag2: str, ad_tag: str | None = None,
    a: str = "a", b: str = "b", key: str = "line_no", src: str = "src", tgt: str = "tgt",
) -> DataFrame:
    """Style-transfer rows (both directions, source tagged) and the selected bitext,
    tagged `<2ad_tag> ` on the source or left bare.  Output (part, key, src, tgt)."""
    st_rows = bidirectional(st, tag1, tag2, "tag-src", a, b, key).select("part", key, "src", "tgt")
    s = tag_prefix(src, ad_tag) if ad_tag else F.col(src)
    ad_rows = ad.select(F.lit(3).alias("part"), key, s.alias("src"), F.col(tgt).alias("tgt"))
    return st_rows.unionByName(ad_rows)


def combine_domains(df: DataFrame, group: list[str], domain: str = "domain", key: str = "line_no") -> DataFrame:
    """Concatenate the domains of each group (e.g. split/style/ref) in domain order.

    New position = rows of the earlier domains of the group + own position.  The offsets
    come from one aggregate with one row per (group, domain); no task sees a whole group.
    """
    sizes = df.groupBy(*group, domain).agg(F.max(key).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(domain).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return df.join(sizes, [*group, domain]).withColumn("combined_no", (F.col("_off") + F.col(key)).cast("bigint")).drop("_off")
