"""Composite pipelines: the user-level entry points of SURVEY §2.8.

Each composes the operators; no stage collects data to the driver.  Reused intermediate
frames are marked where a caller should persist them (one scoring pass feeding two
selections, a model feeding several scorings).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..caches import keep, stage
from ..functions import text as X
from ..operators import bleu as B
from ..operators import filters as FL
from ..operators import lepod as L
from ..operators import lm as LM
from ..operators import mix as M
from ..operators import sequence as S
from ..operators import subword as SW
from ..operators import vocab as V
from ..sources import io as IO


def truecased(df: DataFrame, casing: DataFrame, col: str = "text", key: str = "line_no") -> DataFrame:
    """J7 on one column of a corpus."""
    return V.truecase_apply(df, casing, col, key)


def ced_selection(pool: DataFrame, pos: DataFrame, neg: DataFrame, n: int, order: int = 5, col: str = "text",
                  key: str = "line_no", truecase: bool = True) -> tuple[DataFrame, DataFrame]:
    """C4: truecase all three corpora (model from both in-domain corpora), train both LMs, score the
    pool once, return the n most pos-like and n most neg-like rows of the pool as given."""
    p, q, r = (x.select(key, col) for x in (pos, neg, pool))
    if truecase:
        casing = V.train_truecaser(p.unionByName(q), col)
        p, q, r = (truecased(x, casing, col, key) for x in (p, q, r))
    scored = LM.ced(r, LM.train_ngram_lm(p, col, order), LM.train_ngram_lm(q, col, order), col, key, order)
    scored = keep(scored.join(pool, key))  # read by both selections
    return S.select_lowest(scored, n, "ced", key), S.select_highest(scored, n, "ced", key)


def first_clean(bitext: DataFrame, pattern: str = "_x", seed: int = 0, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """First cleaning pass of a corpus: unique pairs -> seeded shuffle order -> drop lines that match
    `pattern` -> drop pairs with an empty side (no ratio test).  Output (src, tgt, shuffled_no)."""
    t = _shuffled(M.distinct_rows(bitext.select(src, tgt)), seed, src, tgt)
    t = FL.drop_matching(t, [src, tgt], pattern)
    return FL.bitext_clean(t, None, unique=False, src=src, tgt=tgt)


def _shuffled(t: DataFrame, seed: int, src: str, tgt: str) -> DataFrame:
    t = t.withColumn("_k", F.md5(F.concat_ws("\t", src, tgt)))
    return S.with_position(t, "shuffled_no", order_by=[S.shuffle_key(seed, "_k"), "_k"]).drop("_k")


def prepare_bitext(bitext: DataFrame, seed: int = 0, lang: str = "en", src: str = "src", tgt: str = "tgt",
                   near_identical: float = 0.5, ratio: float | None = 2.0, tgt_lang: str | None = None) -> DataFrame:
    """Strip non-printing -> normalise punctuation -> tokenize (each side by the rules of its
    language: `lang`, `tgt_lang`) -> unique pairs -> seeded shuffle order -> drop near-identical
    pairs -> ratio/unique cleaning.

    Output (src, tgt, shuffled_no): the shuffle position is a column, assigned before the
    last two filters (as the reference shuffles before them)."""
    def clean(c, code):
        return X.tokenize(X.normalize_punctuation(X.strip_nonprinting(c), code), code)

    t = bitext.select(clean(src, lang).alias(src), clean(tgt, tgt_lang or lang).alias(tgt))
    t = _shuffled(M.distinct_rows(t), seed, src, tgt)
    t = FL.near_identical_filter(t, near_identical, src, tgt)
    return FL.bitext_clean(t, ratio, unique=False, src=src, tgt=tgt)


def write_ced(scored: DataFrame, path: str, score: str = "ced", tgt: str = "tgt", src: str = "src", key: str = "line_no", digits: int = 6) -> None:
    """The selection pool in score order, as lines `score<TAB>target<TAB>source` (ties by `key`; rows without a
    score are left out): what `ced_to_tag` reads in the reference.  Part files follow each other."""
    text = lambda c: F.regexp_replace(F.col(c), "[\\r\\n\\t]", " ")
    row = F.concat_ws("\t", F.format_string(f"%.{digits}f", F.col(score)), text(tgt), text(src))
    IO.write_columns(scored.filter(F.col(score).isNotNull()).withColumn("_row", row), {"_row": path}, [score, key])


def lepod_files(pairs: DataFrame, prefix: str, alignments: DataFrame | None = None, key: str = "pair_id", text1: str = "text1",
                text2: str = "text2", digits: int = 3, **kw) -> DataFrame:
    """C7 and S7 in one run: `<prefix>.led` and `<prefix>.pod` (score, key and both texts of each valid pair) and
    `<prefix>.txt` (MAT and SUB tokens of both sides), written by one job in key order; returns the report (C8)."""
    scored = stage(L.lepod(pairs, alignments, key, text1, text2, detail=True, **kw).join(pairs.select(key, text1, text2), key), "lepod")
    raw = [F.trim(F.regexp_replace(F.col(c), "[\\r\\n\\t]", " ")) for c in (text1, text2)]
    line = lambda c: F.format_string(f"%.{digits}f\t%s\t%s\t%s", F.col(c), F.col(key).cast("string"), *raw)
    detail = F.concat_ws("\t", F.col(key).cast("string"), *[F.concat(f"mat{k}", F.lit(" | "), f"sub{k}") for k in (1, 2)])
    made = {"_led": line("led"), "_pod": line("pod"), "_detail": detail}
    IO.write_columns(scored.filter("valid"), {"_led": f"{prefix}.led", "_pod": f"{prefix}.pod", "_detail": f"{prefix}.txt"}, [key], made=made)
    return L.lepod_report(scored)


def evaluate_outputs(hyps: DataFrame, refs: DataFrame, keys: list[str], tag: str, is_transfer: bool,
                     stat_keys: list[str] | None = None, hyp: str = "hyp", lower: bool | None = None,
                     ref: str = "ref", lang: str = "en"):
    """Post-process outputs (P20), tokenize outputs and references (P17) -> BLEU per grid group
    (A17) -> statistics over runs (A6).

    BLEU is lower-cased for translation and cased for transfer, as in the reference.
    Returns (bleu per group, statistics)."""
    post = hyps.withColumn(hyp, X.tokenize(X.postprocess(hyp, tag, is_transfer), lang))
    split = over_distinct(refs, ref, lambda c: X.tokenize(c, lang))  # a line is a reference of several segments
    lc = (not is_transfer) if lower is None else lower
    scores = B.evaluation_grid(post, split, keys, hyp=hyp, ref=ref, lower=lc)
    stats = B.run_statistics(scores, stat_keys or [], "bleu") if stat_keys is not None else None
    return scores, stats


def over_distinct(df: DataFrame, col: str, f) -> DataFrame:
    """df with `col` replaced by f(col), which runs once for each distinct text."""
    out = df.select(col).distinct().select(F.col(col).alias("_given"), f(F.col(col)).alias("_made"))
    return df.join(out, F.col(col).eqNullSafe(F.col("_given")), "left").withColumn(col, F.col("_made")).drop("_given", "_made")


def prepare_training(bitext: DataFrame, casing_corpus: DataFrame, n_merges: int, tag1: str, tag2: str,
                     mode: str = "tag", a: str = "a", b: str = "b", key: str = "line_no") -> DataFrame:
    """C11: truecase (model from `casing_corpus`) -> learn and apply subwords on both sides
    jointly -> tagged bidirectional training rows.

    What several later steps read is staged: the casing model, the truecased and the segmented rows."""
    cased_model = stage(V.train_truecaser(casing_corpus, "text"), "casing")
    t = V.truecase_apply(bitext, cased_model, a, key)
    t = stage(V.truecase_apply(t, cased_model, b, key), "truecased")
    merges = SW.learn_subwords(t, [a, b], n_merges)
    t = SW.subword_apply(t, merges, a, key)
    t = stage(SW.subword_apply(t, merges, b, key), "subwords")
    return M.bidirectional(t, tag1, tag2, mode, a, b, key)
