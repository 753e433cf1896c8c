import math
import random
import re
from collections import Counter

from parallax.llm.quality_rules import COMMON, WORDS, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(wins)
    covered = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def check(rows, got):
    want = {i: brute(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)


def test_base_rules_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = [rng.choice(("the", "of", "é", "日本", "🙂", "a#b", "$5")) + rng.choice(("", str(rng.randrange(40)))) for _ in range(rng.randrange(0, 70))]
        if w and rng.random() < 0.5:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(3, 30)] * rng.choice((1, 2))
        text = "".join(x + rng.choice((" ", "\n", "\t", "  ", "\r\n", "\x0b")) for x in w)
        rows.append((i, text + rng.choice(("", "\nsame line\n", "\nsame line\nsame line"))))
    rows += [(900, None), (901, ""), (902, " \n\n "), (903, "  x"), (904, rows[0][1])]
    check(rows, quality_rules(docs_of(rows, 4)).collect())


def test_sf_tables_and_labels(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    kept = {r.doc_id: r.kept for r in got}
    failed = {r.doc_id: r.base_failed for r in got}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept and not failed[i]]
    bad = [kept[i] for i, q in labels.items() if q == 0 and i in kept]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_divergence_by_definition(spark, docs_of):
    rng = random.Random(5)
    texts = {lang: [" ".join(rng.choice(ws if rng.random() < 0.5 else ("xyz", "Abc", "123.")) for _ in range(80)) for _ in range(6)] for lang, ws in COMMON.items()}
    rows, langs = [], {}
    for lang, ts in texts.items():
        for t in ts:
            langs[len(rows)] = lang
            rows.append((len(rows), t))
    df = docs_of(rows).drop("lang").join(spark.createDataFrame(list(langs.items()), "doc_id long, lang string"), "doc_id")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    hist = lambda t: Counter(w if w in WORDS else "" for w in t.lower().split())
    reference = {lang: sum((hist(t) for i, t in rows if langs[i] == lang and not got[i].base_failed), Counter()) for lang in COMMON}
    for i, t in rows:
        p, q = hist(t), reference[langs[i]]
        n, m = sum(p.values()), sum(q.values())
        d = 0.0
        for k in set(p) | set(q):
            a, b = p[k] / n, q[k] / m
            d += (a * math.log2(2 * a / (a + b)) if a else 0) / 2 + (b * math.log2(2 * b / (a + b)) if b else 0) / 2
        assert math.isclose(got[i].word_divergence, d, abs_tol=1e-9)


def test_odd_tables(spark, docs_of):
    assert quality_rules(docs_of([(1, "a")]).limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(50_000))
    got = {r.doc_id: r for r in quality_rules(docs_of([(1, long), (2, "z " * 50_000), (None, "a b"), (3, "y" * 200_000)])).collect()}
    assert got[1].n_repeat_words == 0 and got[2].n_repeat_words == 50_000 and got[2].base_failed and got[None].base_failed and got[3].n_words == 1
