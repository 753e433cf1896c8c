"""Abbreviations learned from a corpus, and tokenisation that knows them.

`tokenize` splits the last period of a line off its word and leaves the others: a period inside a
line may end a sentence or an abbreviation.  Which words are abbreviations is learned from the
corpus itself (Kiss & Strunk 2006, "Unsupervised multilingual sentence boundary detection"): a
word that is followed by a period far more often than chance, by the log-likelihood ratio

    log lambda = -2 log (P(k; n, p0) / P(k; n, 0.99)),

with n occurrences of the word, k of them with a period, and p0 the share of all words with one; weighed
by exp(-letters) (abbreviations are short), 1 + inner periods, and letters ** -(occurrences without a
period).  One aggregate over the corpus counts (language, word); the totals are one row per language.

Lines are then tokenised as before, and coded in packs: only the distinct words of a pack meet the
abbreviation table, in a join, and a word with a final period that is no abbreviation is split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokens
from .packs import recoded

THRESHOLD = 0.3  # of the weighed score, as published
SURE = 0.99  # chance of a period behind an abbreviation
LEAST_PERIODS = 2  # occurrences with a period

#: a word that may take a period: letters, also with inner periods (z.B, i.e), no digits; hyphens and apostrophes inside
_WORD = r"^\p{L}[\p{L}.'\-]*$"


def _stem(token: Column) -> Column:
    """Lower-cased word without its final period."""
    return F.lower(F.regexp_replace(token, r"\.$", ""))


def _log_binomial(k: Column, n: Column, p: Column) -> Column:
    """log of p**k (1 - p)**(n - k); 0 * log 0 is 0."""
    part = lambda c, q: F.when(c == 0, F.lit(0.0)).otherwise(c * F.log(q))
    return part(k, p) + part(n - k, F.lit(1.0) - p)


def learn_abbreviations(corpus: DataFrame, col: str = "text", lang: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """(lang, word, n_period, n_plain, score): words that are abbreviations in a language, lower-cased and without
    the final period.  The last token of a line is left out: its period may end the line."""
    occ = corpus.select(F.col(lang).alias("lang"), tokens(col).alias("_t"))
    occ = occ.select("lang", F.explode(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0)))).alias("_w"))
    period = F.col("_w").endswith(".") & ~F.col("_w").endswith("..")
    words = occ.select("lang", _stem(F.col("_w")).alias("word"), period.alias("_p")).filter(F.col("word").rlike(_WORD))
    counts = words.groupBy("lang", "word").agg(F.count_if("_p").alias("n_period"), F.count_if(~F.col("_p")).alias("n_plain"))
    totals = counts.groupBy("lang").agg((F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).alias("_p0"))
    totals = totals.withColumnRenamed("lang", "_l")
    k, n = F.col("n_period").cast("double"), (F.col("n_period") + F.col("n_plain")).cast("double")
    ratio = F.lit(2.0) * (_log_binomial(k, n, F.lit(SURE)) - _log_binomial(k, n, F.col("_p0")))
    letters = F.length(F.regexp_replace("word", r"\.", "")).cast("double")
    inner = (F.length("word") - letters + 1.0).cast("double")
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.col("n_plain").cast("double"))
    scored = counts.filter(F.col("n_period") >= LEAST_PERIODS).join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("_l")))  # a row for each language
    return scored.withColumn("score", score).filter(F.col("score") >= threshold).select("lang", "word", "n_period", "n_plain", "score")


def split_periods(words: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(word, seg) for words of tokenised lines: the final period is split off, unless the word is an abbreviation."""
    known = abbreviations.select(F.col("word").alias("_a")).distinct().withColumn("_known", F.lit(True))
    w = F.col("word")
    both = words.withColumn("_stem", _stem(w)).join(known, F.col("_stem") == F.col("_a"), "left")
    single = F.length("_stem") == 1  # an initial keeps its period
    splits = w.endswith(".") & ~w.endswith("..") & F.col("_stem").rlike(_WORD) & ~single & F.col("_known").isNull()
    return both.select("word", F.when(splits, F.concat(F.regexp_replace(w, r"\.$", ""), F.lit(" ."))).otherwise(w).alias("seg"))


def tokenize_corpus(df: DataFrame, abbreviations: DataFrame, col: str = "text", lang: str = "en") -> DataFrame:
    """P17 with learned abbreviations: `tokenize`, then periods inside a line are split off words that are no
    abbreviations of the language."""
    own = abbreviations.filter(F.col("lang") == lang) if "lang" in abbreviations.columns else abbreviations
    return recoded(df.withColumn(col, tokenize(col, lang)), col, lambda words: split_periods(words, own))
