"""Row filters and routing over bitext frames.

All are projections and filters of built-in expressions: Catalyst pushes the plain ones
into the scan and keeps the rest in whole-stage codegen.  Write them before any
`dropDuplicates`, which Catalyst does not push filters through.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import factor_stream, n_tokens, tag_prefix, tokens


def project_fields(df: DataFrame, cols: list) -> DataFrame:
    """Keep the named fields (`cut -f`)."""
    return df.select(*cols)


def drop_matching(df: DataFrame, cols: list[str], pattern: str) -> DataFrame:
    """Delete rows where any of `cols` contains `pattern` (a regex, e.g. `_x`)."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in cols])
    return df.filter(~hit)


def drop_empty(df: DataFrame, col: str = "text") -> DataFrame:
    """Delete rows whose text is exactly '' (white space is kept)."""
    return df.filter(F.col(col) != "")


def max_lengths(style_model: str, base: int = 50) -> tuple[int, int]:
    """Token limits (source, target): +1 on each side that carries a style tag."""
    src = base + (1 if style_model in ("tag", "tag-src") else 0)
    tgt = base + (1 if style_model == "tag" else 0)
    return src, tgt


def max_length_filter(df: DataFrame, style_model: str, base: int = 50, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Drop pairs longer than the limits of `max_lengths` ([H]: over-length pairs are dropped)."""
    a, b = max_lengths(style_model, base)
    return df.filter((n_tokens(src) <= a) & (n_tokens(tgt) <= b))


def ratio_clean(
    df: DataFrame, ratio: float = 3, lo: int = 1, hi: int = 1000, src: str = "src", tgt: str = "tgt"
) -> DataFrame:
    """Keep pairs with lo..hi tokens a side and a token-count ratio <= `ratio` both ways."""
    n1, n2 = n_tokens(src), n_tokens(tgt)
    return df.filter(
        n1.between(lo, hi) & n2.between(lo, hi) & (n1 <= F.lit(ratio) * n2) & (n2 <= F.lit(ratio) * n1)
    )


PUNCT_TOKEN = r"^[\p{P}\p{S}]+$"  # a token made only of punctuation / symbols


def word_set(col) -> Column:
    """Distinct lower-cased tokens that are not pure punctuation."""
    return F.array_distinct(F.filter(tokens(F.lower(col if isinstance(col, Column) else F.col(col))),
                                     lambda t: ~t.rlike(PUNCT_TOKEN)))


def overlap(src: str = "src", tgt: str = "tgt") -> Column:
    """Share of distinct words in common, over the smaller word set (null if a side has none)."""
    a, b = word_set(src), word_set(tgt)
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small)


def near_identical_filter(df: DataFrame, t: float = 0.5, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """P13 [H]: drop pairs whose sides are near copies (word overlap >= t)."""
    return df.filter(F.coalesce(overlap(src, tgt) < F.lit(t), F.lit(True)))


def bitext_clean(
    df: DataFrame, ratio: float | None = 2.0, unique: bool = True, src: str = "src", tgt: str = "tgt"
) -> DataFrame:
    """P14 [H]: drop pairs with an empty side or a token ratio above `ratio` (None = no ratio test);
    `unique` keeps one row per (src, tgt)."""
    n1, n2 = n_tokens(src), n_tokens(tgt)
    cond = (n1 > 0) & (n2 > 0)
    if ratio is not None:
        cond = cond & (F.greatest(n1, n2) <= F.lit(ratio) * F.least(n1, n2))
    out = df.filter(cond)
    return out.dropDuplicates([src, tgt]) if unique else out


def tag_sources(
    df: DataFrame, style_model: str, tag: str, unk_tag: bool = False, col: str = "src", factor_col: str = "factor"
) -> DataFrame:
    """Route a test source by style model.

    `tag*` models prefix `<2tag> ` (an `unk` test stays bare unless the model has an unk
    tag); `*factor*`, `*decoder*` and `block*` models get a factor stream beside the text.
    """
    out = df
    if "factor" in style_model or "decoder" in style_model or style_model.startswith("block"):
        out = out.withColumn(factor_col, factor_stream(col, tag))  # from the untagged text
    if style_model.startswith("tag") and not (tag == "unk" and not unk_tag):
        out = out.withColumn(col, tag_prefix(col, tag))
    return out
