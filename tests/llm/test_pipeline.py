"""Each stage of the pipeline against a brute-force version on its own input."""
import re

import pytest

import corpus_pipeline as P
from parallax.llm.common import shared_path

from .test_decontaminate import brute as brute_leaks
from .test_jaccard_join import brute as brute_groups
from .test_substring_dedup import brute as brute_repeats

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf):
    """(documents, then each stage's result), written and read again as the pipeline does."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        path = shared_path(spark, "step")
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "mixing sources"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and [t for _, t in df.dtypes] == [t for _, t in steps[0].dtypes]


def test_quality_stage_keeps_clean_documents(spark, sf, steps):
    kept = texts(steps[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i in kept for i, q in labels.items() if q == 1]  # what it rejects is tested on more labels, in test_byte_cnn
    assert sum(good) > 0.9 * len(good)


def test_near_duplicate_stage(steps):
    rows = list(texts(steps[1]).items())
    assert texts(steps[2]) == {i: dict(rows)[i] for i, _, root in brute_groups(rows) if root == i}


def test_repeated_passage_stage(steps):
    rows = list(texts(steps[2]).items())
    got = {r.doc_id: r for r in steps[3].collect()}
    for i, (n, gone, kept, _) in brute_repeats(rows, 20).items():
        if n and gone == n:
            assert i not in got
        else:
            assert SPACED.findall(got[i].text) == kept.split(" ") if kept else not SPACED.findall(got[i].text)
            assert gone or got[i].text == dict(rows)[i]
            assert not gone or got[i].n_chars == len(got[i].text)


def test_benchmark_stage(spark, sf, steps):
    rows = list(texts(steps[3]).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = texts(steps[4])
    for i, (n, hit, _, _) in brute_leaks(rows, items).items():
        assert (i in got) == (hit < n or n == 0)
        if i in got and not hit:
            assert got[i] == dict(rows)[i]
    assert all(not leak[1] or leak[1] < leak[0] for leak in brute_leaks(list(got.items()), items).values())


def test_mixture_stage(steps):
    words, taken = {}, {}
    size = lambda t: len(SPACED.findall(t or ""))
    for r in steps[4].collect():
        words[r.source] = words.get(r.source, 0) + size(r.text)
    copies = {}
    for r in steps[5].collect():
        copies.setdefault(r.doc_id, []).append(r.copy)
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        assert r.text == texts_of(steps)[r.doc_id]
    assert all(sorted(c) == list(range(len(c))) and len(c) <= 2 for c in copies.values())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())


_KNOWN: dict = {}


def texts_of(steps):
    if not _KNOWN:
        _KNOWN.update(texts(steps[4]))
    return _KNOWN


def test_run_on_nulls_and_repeated_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", None, 0), (None, "a b c d e f g", "en", "src1", 13), (10_003, "x " * 50_000, "en", "src1", 100_000)], docs.schema)
    docs = docs.limit(60).unionByName(odd).unionByName(docs.limit(5))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = P.run(spark, str(tmp_path)).collect()
    ids = [(r.doc_id, r.copy) for r in rows if r.doc_id is not None]
    assert rows and len(ids) == len(set(ids))
