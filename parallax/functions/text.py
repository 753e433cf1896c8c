"""Scalar text functions.

All of them are built-in Column expressions, so they stay inside whole-stage
codegen, carry no global state and work on batch and streaming DataFrames alike.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import PUNCT_RULES_COMMON, PUNCT_RULES_EN, PUNCT_RULES_OTHER, DETOKENIZE_RULES, guarded, tokenize_rules


def materialize(df, cols: dict):
    """Evaluate `cols` once per row and expose them as plain columns.

    Spark inlines a projected expression into every later reference, and a reference
    inside a lambda (`transform`, `filter`, `aggregate`) is evaluated once per array
    element.  A one-element `inline` is a Generate node that projections are not merged
    through, so array work above it reads the stored value instead of recomputing it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def explode_ngrams(df, arr: str, ns, keep: list, name: str = "_g"):
    """One row per n-gram (n in `ns`) of the token array column `arr`: `name` =
    struct(n, g) with g the space-joined tokens.

    Positions come from `posexplode` and each n-gram is a plain `slice` per row, so the
    work stays in generated code (a `transform` lambda per n-gram would be interpreted).
    """
    p = df.select(*keep, arr, F.posexplode(arr).alias("_gi", "_gw"))

    def gram(n):
        return F.when(
            F.col("_gi") + n <= F.size(arr),
            F.struct(F.lit(n).alias("n"), F.array_join(F.slice(arr, F.col("_gi") + 1, n), " ").alias("g")),
        )

    g = p.select(*keep, F.explode(F.array(*[gram(n) for n in ns])).alias(name))
    return g.filter(F.col(name).isNotNull())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tag_token(tag: str) -> str:
    return f"<2{tag}>"


def tag_prefix(col, tag: str) -> Column:
    """Prepend `<2tag> ` (an empty line becomes `<2tag> `)."""
    return F.concat(F.lit(tag_token(tag) + " "), _c(col))


def factor_stream(col, tag: str) -> Column:
    """P5: every maximal run of non-space characters becomes `<2tag>`; spaces are kept."""
    return F.regexp_replace(_c(col), "[^ ]+", tag_token(tag))


def strip_tags(col) -> Column:
    """Remove every `<2xxx> ` tag."""
    return F.regexp_replace(_c(col), "<2[a-z]+> ", "")


def undo_subword(col) -> Column:
    """Remove subword continuation marks `@@ ` and a trailing `@@`."""
    return F.regexp_replace(_c(col), "(@@ )|(@@ ?$)", "")


def strip_ws(col) -> Column:
    """Trim white space (`\\s`) at both ends."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def normalize_all_caps(col) -> Column:
    """Trim; an all-upper-case line becomes lower case with a capital first letter."""
    t = strip_ws(col)
    low = F.lower(t)
    is_upper = (F.upper(t) == t) & (low != t)
    return F.when(is_upper, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))).otherwise(t)


def lowercase(col) -> Column:
    """P9."""
    return F.lower(_c(col))


def tokens(col) -> Column:
    """P10: split on white space, no empty tokens (an empty line has zero tokens)."""
    return F.array_remove(F.split(_c(col), r"\s+"), "")


def n_tokens(col) -> Column:
    """P10: token count as INT."""
    return F.size(tokens(col))


def has_tokens(col) -> Column:
    """If `n_tokens` is above 0 (null for a null text), without making the tokens."""
    return _c(col).rlike(r"\S")


def strip_nonprinting(col) -> Column:
    """Control / format / unassigned / private characters become a space."""
    return F.regexp_replace(_c(col), r"\p{C}", " ")


def _apply_rules(col, rules) -> Column:
    """The rules one after the other; a text without a trace of a stretch of rules passes it by."""
    def stretch(text, own):
        for pattern, repl in own:
            text = F.regexp_replace(text, pattern, repl)
        return text

    out = _c(col)
    for trace, own in guarded(rules):
        if trace is None:
            out = stretch(out, own)
        else:  # a lambda's variable: the text so far is evaluated once
            out = F.get(F.transform(F.array(out), lambda x: F.when(x.rlike(trace), stretch(x, own)).otherwise(x)), F.lit(0))
    return out


def normalize_punctuation(col, lang: str = "en") -> Column:
    """Map typographic punctuation and spacing to plain ASCII (fixed rule table)."""
    rules = PUNCT_RULES_COMMON + (PUNCT_RULES_EN if lang == "en" else PUNCT_RULES_OTHER)
    return _apply_rules(col, rules)


def tokenize(col, lang: str = "en") -> Column:
    """Separate punctuation from words, split hyphens as ` @-@ `, no escaping; apostrophes by the
    rules of the language."""
    return _apply_rules(col, tokenize_rules(lang))


def detokenize(col) -> Column:
    """Inverse of `tokenize` for the common cases."""
    return _apply_rules(col, DETOKENIZE_RULES)


def detruecase(col) -> Column:
    """Upper-case the sentence-initial letter."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def postprocess(col, tag: str, is_transfer: bool) -> Column:
    """P20: strip tags -> undo subwords -> detruecase (not for informal transfer output) -> detokenize."""
    out = undo_subword(strip_tags(col))
    if not (is_transfer and tag == "informal"):
        out = detruecase(out)
    return detokenize(out)
