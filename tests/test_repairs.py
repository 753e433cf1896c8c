"""Cases that earlier versions got wrong: references, layouts, several files, zips, reserved tokens, long pairs."""
import os

import pytest
from pyspark.sql import functions as F

from parallax.operators import bleu as B
from parallax.operators import joins as J
from parallax.operators import lepod as L
from parallax.operators import lm as LM
from parallax.sources import io as IO
from parallax.sources import tables as T


@pytest.mark.parametrize("ref_no", [0, 3, 4, 17, -2])
def test_bleu_counts_every_reference(spark, ref_no):
    h = spark.createDataFrame([("s", 1, "a b c d e")], "system string, seg_id long, hyp string")
    refs = [("s", 1, 1, "x y"), ("s", 1, ref_no, "a b c d e")]
    r = B.corpus_bleu(h, spark.createDataFrame(refs, "system string, seg_id long, ref_no int, ref string"), ["system"]).first()
    assert r.bleu == 100.0 and r.n_unscored == 0


def test_bleu_leaves_unreferenced_segments_out_of_both_counts(spark):
    h = spark.createDataFrame([("s", 1, "a b c d e f"), ("s", 2, "q q q q q q"), ("t", 3, "a b")], "system string, seg_id long, hyp string")
    refs = spark.createDataFrame([("s", 1, 0, "a b c d e f")], "system string, seg_id long, ref_no int, ref string")
    got = {r.system: r for r in B.corpus_bleu(h, refs, ["system"]).collect()}
    assert (got["s"].c, got["s"].den1, got["s"].bleu, got["s"].n_unscored) == (6, 6, 100.0, 1)
    assert (got["t"].c, got["t"].bleu, got["t"].n_unscored) == (0, 0.0, 1)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_layout_at_any_depth(spark, tmp_path):
    for domain in ("EM", "FR"):
        for name in ("train/formal", "test/formal.ref0", "test/formal.ref3"):
            write(f"{tmp_path}/{domain}/{name}", f"{domain} {name}\nsecond\n")
    write(f"{tmp_path}/README", "not a corpus\n")
    df = IO.read_layout(spark, str(tmp_path), r"(EM|FR)/(train|tune|test)/(formal|informal)(?:\.ref(\d))?$", ["domain", "split", "style", "ref"])
    got = sorted((r.domain, r.split, r.style, r.ref, r.line_no) for r in df.collect())
    assert len(got) == 12 and got[0] == ("EM", "test", "formal", "0", 1) and ("FR", "train", "formal", "", 2) in got


def test_several_files_keep_their_own_numbers(spark, tmp_path):
    for k in range(3):
        write(f"{tmp_path}/t/f{k}", f"a{k}\tb\nc{k}\td\n")
    got = IO.read_bitext_tsv(spark, f"{tmp_path}/t").collect()
    assert len({(r.file, r.line_no) for r in got}) == 6 and {r.src for r in got if r.line_no == 2} == {"c0", "c1", "c2"}


def test_alignment_blocks(spark, tmp_path):
    rows = "".join(f"{i}:1 {i}:1\n" for i in range(50))
    write(f"{tmp_path}/a", f"h\nh\nh\nh\n{rows}\nh\nh\nh\nh\n2:1 0:3\n\n")
    got = IO.read_alignments(spark, f"{tmp_path}/a").collect()
    assert len(got) == 51 and [(r.pair_id, r.start1, r.len1, r.start2) for r in got if r.pair_id == 2] == [(2, 0, 3, 2)]
    write(f"{tmp_path}/b", "h\nh\nh\nh\n1:1 1:1\n\nlone\n\nh\nh\nh\nh\n")
    with pytest.raises(Exception, match="block 2 of .*no alignment row: 'h'"):  # lone, a blank line, h, h are its header
        IO.read_alignments(spark, f"{tmp_path}/b").collect()


def test_written_columns_line_up(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("t" * 50), "id").alias("tgt")).repartition(7)
    IO.write_columns(df, {"src": f"{tmp_path}/src", "tgt": f"{tmp_path}/tgt"}, ["id"], partitions=6)
    parts = [sorted(f for f in os.listdir(f"{tmp_path}/{c}") if f.startswith("part-")) for c in ("src", "tgt")]
    assert len(parts[0]) == len(parts[1]) == 6
    for a, b in zip(*parts):
        s, t = open(f"{tmp_path}/src/{a}").read().split(), open(f"{tmp_path}/tgt/{b}").read().split()
        assert [x[1:] for x in s] == [x[50:] for x in t]


def test_zip_modes(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "line_no long, src string, n int")
    b = spark.createDataFrame([(1, "y", 7), (3, "z", 8)], "line_no long, tgt string, m int")
    got = {r.line_no: tuple(r)[1:] for r in J.zip_lines(a, b, "pad").collect()}
    assert got == {1: ("x", 5, "y", 7), 2: (None, 6, "", None), 3: ("", None, "z", 8)}
    assert dict(J.zip_lines(a, b, "pad").dtypes)["n"] == "int"
    with pytest.raises(Exception, match="missing on one side"):
        J.zip_lines(a, b, "strict").collect()  # two rows on each side, but other keys


def test_keys_fail_loudly_instead_of_colliding(spark):
    docs = spark.createDataFrame([(1, "en", "s", "\n" * 100_000)], "doc_id long, lang string, source string, text string")
    with pytest.raises(Exception, match="lines of a document"):
        T.lines(docs).select("line_id").collect()


def test_language_model_sums_to_one_and_marks_reserved_tokens(spark):
    corpus = spark.createDataFrame([("a b a c",), ("b a b",), ("c",), ("<unk> a </s> b",)], "text string")
    model = LM.train_ngram_lm(corpus, "text", 3)
    m = {r.ngram: r for r in model.collect()}
    words = [g for g, r in m.items() if r.n == 1 and r.log_p is not None]

    def p(h, w):
        for j in range(len(h) + 1):
            g = " ".join([*h[j:], w])
            if g in m and m[g].log_p is not None:
                return 10 ** (m[g].log_p + sum(m[" ".join(h[i:])].log_b or 0 for i in range(j) if " ".join(h[i:]) in m))
        raise AssertionError(w)

    for h in ([], ["a"], ["<s>"], ["<s>", "a"], ["b", "a"], ["zz", "a"]):
        assert sum(p(h, w) for w in words) == pytest.approx(1.0, abs=1e-12)
    seg = spark.createDataFrame([(1, "a <unk>"), (2, "a zz"), (3, ""), (4, "<s> a")], "line_no long, text string")
    got = {r.line_no: r for r in LM.cross_entropy(seg, model, order=3).collect()}
    assert got[2].n_oov == 1 and got[4].n_oov == 1 and got[3].xent is None and got[3].n_words == 0


def test_lepod_of_a_long_pair(spark):
    n = 5000
    t1 = " ".join(f"w{i}" for i in range(n))
    t2 = " ".join(f"w{i}" for i in reversed(range(n)))
    df = spark.createDataFrame([(1, t1, t2), (2, t1, t1), (3, "a a b", "a b a a")], "pair_id long, text1 string, text2 string")
    got = {r.pair_id: r for r in L.lepod(df).collect()}
    assert got[1].led == 0 and got[1].pod > 0.9 and (got[2].led, got[2].pod) == (0, 0) and got[3].led == pytest.approx(0.125)
