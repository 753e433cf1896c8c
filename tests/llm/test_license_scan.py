import random
import re

from parallax.llm.license_scan import NOTICES, PHRASES, license_scan, license_spans, words_of


def brute(text):
    w, places = words_of(text or ""), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def check(rows, got):
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_base_against_brute_force(spark, docs_of):
    rng = random.Random(2)
    words = "cc by cc by general public license all rights reserved CC-BY x é the".split()
    rows = [(i, rng.choice((" ", "-", ", ", "\n")).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, rows[4][1]), (503, "all rights reserved " * 30_000), (504, "CC BY")]
    check(rows, license_scan(docs_of(rows)).collect())


def test_sf_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = license_scan(docs).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        for line, label in (("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version", "apache"), ("Licensed under CC BY-NC", "cc-by-nc")):
            if line in t:
                assert label in by[i].labels.split(","), (i, line)
        if not re.search("licen|rights|copyright|cc by", t, re.I):
            assert by[i].labels == "" and by[i].score == 0


def test_notices_with_changes(spark, docs_of):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    rows, want = [], {}
    for i, (label, text) in enumerate(NOTICES):
        w = text.split()
        rows.append((i, f"{filler(30)} {text}. {filler(20)}"))
        if len(w) > 12:  # a word more and a word less
            w = w[:4] + ["really"] + w[4:9] + w[10:]
            rows.append((100 + i, f"{filler(7)} {' '.join(w).upper()}"))
            want[100 + i] = label
            rows.append((200 + i, " ".join(w[: len(w) // 2])))  # half a notice is none
            want[200 + i] = None
        want[i] = label
    spans = license_spans(docs_of(rows)).collect()
    found = {}
    for s in spans:
        found.setdefault(s.doc_id, set()).add(s.label)
        if s.doc_id < 100 and s.label == want[s.doc_id] and s.score == 1.0 and not s.exact:
            assert s.begin >= 30
    for i, label in want.items():
        assert label in found[i] if label else not found.get(i, set()) & {NOTICES[i - 200][0]}, i


def test_repeated_rows_and_empty_table(spark, docs_of):
    rows = [(1, "cc by"), (1, "cc by"), (1, "other"), (None, "All rights reserved.")]
    got = license_scan(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.base_labels) for r in got) == [(0, 1, "reserved"), (1, 0, ""), (1, 1, "cc-by"), (1, 1, "cc-by")]
    assert license_scan(docs_of(rows).limit(0)).count() == 0


def covered(notice, text, begin):
    """The share of the notice's word pairs that stand in the text, a word or less from their place."""
    pairs = lambda w: list(zip(w, w[1:]))
    wanted, there = pairs(words_of(notice)), pairs(words_of(text))
    return sum(p in there[begin + max(k - 1, -begin) : begin + k + 2] for k, p in enumerate(wanted)) / len(wanted)


def test_one_word_more_or_less_at_every_place(spark, docs_of):
    rows, want = [], {}
    for label, text in NOTICES:
        w = text.split()
        changed = [w[:i] + [x] + w[i:] for i in range(len(w) + 1) for x in ("also", w[0], w[i // 2])] + [w[:i] + w[i + 1 :] for i in range(len(w))]
        for c in changed:
            i = len(rows)
            rows.append((i, f"aa bb {' '.join(c)} cc dd"))
            want[i] = (label, covered(text, rows[-1][1], 2))
    assert sum(share >= 0.75 for _, share in want.values()) > 500
    got = {r.doc_id: r for r in license_scan(docs_of(rows)).collect()}
    lost = [rows[i][1] for i, (label, share) in want.items() if share >= 0.75 and label not in got[i].labels.split(",")]
    assert not lost, (len(lost), lost[:3])
    assert all(got[i].score >= share - 1e-9 for i, (_, share) in want.items() if share >= 0.75)


def test_copies_close_together(spark, docs_of):
    label, text = NOTICES[1]
    n = len(words_of(text))
    rows = [(0, " ".join([text] * 3)), (1, f"{text} x y {text}"), (2, f"the license you may {text} you may the license the license"), (3, f"{text} " * 2000)]
    spans = {}
    for s in license_spans(docs_of(rows)).filter(f"label = '{label}' AND score = 1").collect():
        spans.setdefault(s.doc_id, []).append((s.begin, s.end))
    assert sorted(spans[0]) == [(k * n, (k + 1) * n) for k in range(3)]
    assert sorted(spans[1]) == [(0, n), (n + 2, 2 * n + 2)]
    assert spans[2] == [(4, n + 4)]
    assert len(spans[3]) == 2000
