"""Operator 10: quality rules with Jensen-Shannon divergence (DataFrame operations only).

Base rules count word characters, symbols, repeated lines and words in repeated windows of a text.
The method compares two histograms of a document, over character classes and over common words,
with the reference of its language by Jensen-Shannon divergence.  A reference is the sum of the
histograms of all documents of the language that pass the base rules and have few symbols; there
is one for each language that has a list of common words, so the table of references is bounded.  A document is
kept unless a base rule fails or a divergence passes its limit.  Guards: character classes are
compared from MIN_CHARS characters on, common words from MIN_WORDS words on; a document in a
language without reference, or with a null language, is compared with the nearest reference.

Null and empty texts have no words, so they fail the base rules.  Repeated rows are judged one by
one.  Columns besides doc_id, text and lang are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

WINDOW = 8
MIN_CHARS, MIN_WORDS = 100, 50
REFERENCE_SYMBOLS = 10  # a document of the references has this many words for each symbol
MOST_CHARS, MOST_WORDS = 0.035, 0.1  # limits of the divergences, in bits (0 to 1)

#: Frequent words of the languages that have references.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "für", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
CLASSES = {  # characters of each class; what is left are small letters and others
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ",
    "digit": "0123456789",
    "mark": ".,;:!?'\"()-",
}


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def n_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(without(text, characters))).cast("long")


def repeated_words(hashes: str) -> Column:
    """Words in windows whose hash stands twice or more; `hashes` is a column of window hashes."""
    return F.expr(f"""aggregate(
        array_sort(transform(filter(sorted, (e, i) -> (i > 0 AND sorted[i - 1].h = e.h) OR (i < size(sorted) - 1 AND sorted[i + 1].h = e.h)), e -> e.i)),
        named_struct('at', -{WINDOW}, 'n', 0L),
        (x, p) -> named_struct('at', p, 'n', x.n + least({WINDOW}, p - x.at)), x -> x.n)""".replace("sorted", hashes))


def stored(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row: a generator is not merged with what
    reads it, so a lambda does not compute them again for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    chars, common): the last two are histograms."""
    text = F.col("text")
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df = stored(
        df, words=F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""),
        lines=F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACE)) > 0),
        n_chars=F.length(text).cast("long"), word_chars=F.length(without(text, SPACE)).cast("long"), n_symbols=n_of(text, SYMBOLS),
        **{c: n_of(text, x) for c, x in CLASSES.items()},
    )
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW)))
    hits = F.filter("words", lambda w: F.lower(w).isin(WORDS))
    df = stored(
        df.drop("text"), n_words=n.cast("long"), hashes=F.when(n > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        hits=F.concat(F.lit("|"), F.lower(F.array_join(hits, "||")), F.lit("|")), n_hits=F.size(hits).cast("long"),
    ).drop("words", "lines")
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = stored(df, pairs=F.when(again, pairs).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))).drop("hashes")
    df = df.withColumn("n_repeat_words", repeated_words("pairs"))
    count = lambda w: ((F.length("hits") - F.length(F.replace("hits", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("long")
    space = F.col("n_chars") - F.col("word_chars")
    known = sum((F.col(c) for c in CLASSES), F.col("n_symbols") + space)
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.array(space, F.col("n_symbols"), *[F.col(c) for c in CLASSES], F.col("n_chars") - known).alias("chars"),
        F.array(*[count(w) for w in WORDS], F.col("n_words") - F.col("n_hits")).alias("common"),
    )


def divergence(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of the array counts / total from the array reference."""

    def half(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(counts, reference, lambda c, q: half(c / total, q) + half(q, c / total))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def references(rules: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Distributions over character classes and common words by language."""
    sums = [F.sum(F.col(c)[k].cast("double")).alias(f"{c}{k}") for c, m in (("chars", len(CLASSES) + 3), ("common", len(WORDS) + 1)) for k in range(m)]
    plain = ~F.col("base_failed") & (F.col("n_symbols") * REFERENCE_SYMBOLS <= F.col("n_words"))
    rows = rules.filter(F.col("lang").isin(list(COMMON)) & plain).groupBy("lang").agg(*sums).collect()  # as many as COMMON
    found = {}
    for r in rows:
        parts = [[r[f"{c}{k}"] for k in range(m)] for c, m in (("chars", len(CLASSES) + 3), ("common", len(WORDS) + 1))]
        found[r.lang] = tuple([x / max(sum(p), 1.0) for x in p] for p in parts)
    return found


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_divergence, word_divergence, kept)."""
    rules = shared_table(base_rules(docs), "rules")
    by_language = references(rules)

    def against(column: str, total: str, which: int) -> Column:
        if not by_language:
            return F.lit(0.0)
        as_array = lambda x: F.array(*[F.lit(float(v)) for v in x])
        own = F.array(*[as_array(ref[which]) for ref in by_language.values()])  # for other languages: the nearest
        for lang, ref in by_language.items():
            own = F.when(F.col("lang") == lang, F.array(as_array(ref[which]))).otherwise(own)
        return F.array_min(F.transform(own, lambda r: divergence(F.col(column), F.col(total), r)))

    df = rules.withColumn("char_divergence", F.when(F.col("n_chars") >= MIN_CHARS, against("chars", "n_chars", 0)))
    df = df.withColumn("word_divergence", F.when(F.col("n_words") >= MIN_WORDS, against("common", "n_words", 1)))
    odd = (F.coalesce("char_divergence", F.lit(0.0)) > MOST_CHARS) | (F.coalesce("word_divergence", F.lit(0.0)) > MOST_WORDS)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     "char_divergence", "word_divergence", (~F.col("base_failed") & ~odd).alias("kept"))
