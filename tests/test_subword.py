"""Subword learning against one-at-a-time learning on a fixture; apply/undo round trip."""
import random
from collections import Counter

from pyspark.sql import functions as F

from parallax.functions.text import undo_subword
from parallax.operators import subword as SW

TEXT = [
    "low lower lowest newer newest wider widest",
    "the lower the newer , the wider the better",
    "aaaa aa a aaa banana bandana ananas",
    "low low low newest newest wider",
]


def one_at_a_time(lines, n):
    words = Counter(w for line in lines for w in line.split())
    vocab = {tuple(list(w[:-1]) + [w[-1] + SW.EOW]): c for w, c in words.items()}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for syms, c in vocab.items():
            for a, b in zip(syms, syms[1:]):
                pairs[(a, b)] += c
        if not pairs:
            break
        (a, b), _ = min(pairs.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        merges.append((a, b))
        nv = {}
        for syms, c in vocab.items():
            out, i = [], 0
            while i < len(syms):
                if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            nv[tuple(out)] = nv.get(tuple(out), 0) + c
        vocab = nv
    return merges


def test_batched_learning_equals_sequential(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT)], "line_no long, text string")
    got = [(r["left"], r["right"]) for r in SW.learn_subwords(df, ["text"], 25).orderBy("rank").collect()]
    assert got == one_at_a_time(TEXT, 25)


def test_apply_then_undo_is_identity(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT)], "line_no long, text string")
    merges = SW.learn_subwords(df, ["text"], 12)
    seg = SW.subword_apply(df, merges, "text", "line_no")
    back = {r["line_no"]: r["t"] for r in seg.select("line_no", undo_subword("text").alias("t")).collect()}
    assert back == {i: " ".join(t.split()) for i, t in enumerate(TEXT)}
    assert any("@@ " in r["text"] for r in seg.collect())


def test_thousands_of_merges_equal_sequential(spark):
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(8)) for _ in range(60)] + ["aaaaaaa aaaa abababab </w> a</w>"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no long, text string")
    got = [(r["left"], r["right"]) for r in SW.learn_subwords(df, ["text"], 100_000).orderBy("rank").collect()]
    assert len(got) > 500 and got == one_at_a_time(lines, 100_000)
    letters = [chr(0x3B1 + i) for i in range(60)]
    words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(600)]
    assert len({p for w in words for p in zip(w, w[1:])}) > 2000  # different pairs of one pass
    pieces = [([*w[:-1], w[-1] + SW.EOW], 1) for w in words]
    assert SW.learn_merges(pieces, 300) == one_at_a_time([" ".join(words)], 300)
    assert len(SW.learn_merges(pieces, 100_000)) > 2000


def test_rounds_equal_sequential(spark, monkeypatch):
    """Tables far smaller than the words, so that merges come from many rounds of cut words."""
    rng = random.Random(6)
    rounds = []
    learn = SW._learn
    monkeypatch.setattr(SW, "_learn", lambda *a: rounds.append(a[1]) or learn(*a))
    for letters, longest, most, first in (("ab", 12, 40, 3), ("abc", 9, 60, 6), ("abcdefghij", 7, 150, 40)):
        lines = []
        for _ in range(80):
            stem = "".join(rng.choice(letters) for _ in range(3))
            lines.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) + rng.choice(("", stem)) for _ in range(7)))
        df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no long, text string")
        rounds.clear()
        got = SW.learn_subwords(df, ["text"], 120, most_pieces=most, first_open=first).orderBy("rank").collect()
        assert [(r["left"], r["right"]) for r in got] == one_at_a_time(lines, 120)
        assert len(rounds) > 2 and rounds[0] > 1


def test_names_that_two_merges_make():
    """(ab, c) and (a, bc) both make abc: pairs across cuts may add up, so the round ends earlier."""
    ends = SW._Ends({"abc"})
    ends.merged("ab", "c")
    assert ends.product > 1
    ends = SW._Ends(frozenset())
    ends.merged("a", "b")
    ends.merged("ab", "c")
    assert ends.product == 1
    ends.merged("x", "</w>")
    assert ends.product > 1


def test_coded_rows(spark):
    """Nulls, empty texts, every white space, long rows and clashing columns come through the packs."""
    rows = [(1, None, 5, "k"), (2, "", 6, "k"), (3, " a\tb \n c\x0bA ", 7, "k"), (4, "b " * 200_000, 8, "k"), (5, "a\u00a0b", 9, "k"), (5, "c", 9, None)]
    df = spark.createDataFrame(rows, "line_no long, text string, _codes int, word string").repartition(2)
    table = spark.createDataFrame([("a", "X"), ("b", "YY"), ("nothing", "Z")], "lower string, best string")
    from parallax.operators import vocab as V

    got = {(r.line_no, r.text if len(r.text or "") < 50 else len(r.text), r._codes, r.word) for r in V.truecase_apply(df, table).collect()}
    assert got == {(1, "", 5, "k"), (2, "", 6, "k"), (3, "X YY c X", 7, "k"), (4, 599_999, 8, "k"), (5, "a\u00a0b", 9, "k"), (5, "c", 9, None)}
    counts = {(r.line_no, r.n_tokens, r.n_oov) for r in V.oov_count(df.filter("line_no < 5"), table.withColumnRenamed("lower", "token")).collect()}
    assert counts == {(1, 0, 0), (2, 0, 0), (3, 4, 2), (4, 200_000, 0)}
    assert V.truecase_apply(df.limit(0), table).count() == 0 and V.truecase_apply(df, table.limit(0)).count() == 6


def test_registered_merge_count():
    from parallax.plans import registry

    assert registry.N_MERGES == 32_000  # scripts/preprocess-transfer.sh, SURVEY A11
