"""Learned abbreviations against the published score, and tokenisation with them."""
import math

from parallax.operators import abbreviations as A

LINES = ["Dr. Smith met Mr. Jones at noon . They spoke", "The dog saw Dr. Lee today", "He saw the dog. The dog ran off", "Mr. Day and Dr. Ray left",
         "We saw the dog and ran", "the dog is the dog", "e.g. this or e.g. that works", "A. B. Smith ran"] * 4


def test_scores_are_those_of_the_formula(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(LINES)], "line_no long, text string, lang string")
    got = {r.word: r for r in A.learn_abbreviations(df).collect()}
    assert {"dr", "mr", "e.g"} <= set(got) and not {"dog", "the", "ran"} & set(got)
    occ = [w for t in LINES for w in t.split()[:-1] if w.replace(".", "").isalpha()]
    p0 = sum(w.endswith(".") for w in occ) / len(occ)
    for word, inner in (("dr", 0), ("e.g", 1)):
        k = n = sum(w.lower() == word + "." for w in occ)
        ratio = 2 * (k * math.log(0.99) - k * math.log(p0))
        letters = len(word) - inner
        assert math.isclose(got[word].score, ratio * math.exp(-letters) * (1 + inner), rel_tol=1e-12)
        assert (got[word].n_period, got[word].n_plain) == (n, 0)


def test_periods_inside_a_line(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(LINES)], "line_no long, text string, lang string")
    known = A.learn_abbreviations(df)
    lines = spark.createDataFrame([(1, "He saw Dr. Lee. Mr. Day saw the dog. It ran..."), (2, None), (3, ""), (4, "J. Lee paid 3. and left e.g. now."), (5, "the end. ")],
                                  "line_no long, text string")
    got = {r.line_no: r.text for r in A.tokenize_corpus(lines, known).collect()}
    assert got == {1: "He saw Dr. Lee . Mr. Day saw the dog . It ran ...", 2: "", 3: "", 4: "J. Lee paid 3. and left e.g. now .", 5: "the end ."}
    assert A.tokenize_corpus(lines.limit(0), known).count() == 0
    assert {r.text for r in A.tokenize_corpus(lines, known, lang="de").filter("line_no = 1").collect()} == {"He saw Dr . Lee . Mr . Day saw the dog . It ran ..."}
    assert A.learn_abbreviations(df.limit(0)).count() == 0
