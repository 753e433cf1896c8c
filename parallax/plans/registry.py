"""

Every query reads the driver tables at `sf_dir` through the derived views of
FIXTURES.md §3, so its work grows with the tables.  Doubles are rounded to 6 places on
both sides; counts are BIGINT, token positions INT.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..caches import keep
from ..operators import ced as C
from ..sources import tables as T
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: list[str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views or [], sql)
        return fn

    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- CED tagging

_CED_STATS = """m AS (SELECT avg(abs(ced)) AS mean_abs FROM v_score),
t AS (SELECT (SELECT mean_abs FROM m) AS mean_abs,
             CAST(count_if(ced < -(SELECT mean_abs FROM m)) AS BIGINT) AS n_low,
             CAST(count_if(ced > (SELECT mean_abs FROM m)) AS BIGINT) AS n_high FROM v_score),
tk AS (SELECT mean_abs, n_low, n_high, least(n_low, n_high) AS k FROM t),
r AS (SELECT ced, row_number() OVER (ORDER BY ced) AS rn FROM v_score),
th AS (SELECT (SELECT k FROM tk) AS k,
              CASE WHEN (SELECT k FROM tk) > 0 THEN (SELECT ced FROM r WHERE rn = (SELECT k FROM tk)) END AS low_threshold,
              CASE WHEN (SELECT k FROM tk) > 0 THEN (SELECT ced FROM r
                   WHERE rn = (SELECT count(*) FROM v_score) - (SELECT k FROM tk) + 1) END AS high_threshold)
"""


@register("ced_mean_abs", "SELECT round(avg(abs(ced)), 6) AS mean_abs FROM v_score", ["v_score"])
def q_ced_mean_abs(spark, d):
    return C.mean_abs(T.v_score(spark, d)).select(r6("mean_abs").alias("mean_abs"))


@register("ced_tail_counts", "WITH " + _CED_STATS +
          "SELECT round(mean_abs, 6) AS mean_abs, n_low, n_high, k FROM tk", ["v_score"])
def q_ced_tail_counts(spark, d):
    return C.tail_counts(T.v_score(spark, d)).withColumn("mean_abs", r6("mean_abs"))


@register("ced_kth_thresholds", "WITH " + _CED_STATS + "SELECT k, low_threshold, high_threshold FROM th", ["v_score"])
def q_ced_kth_thresholds(spark, d):
    s = T.v_score(spark, d)
    return C.kth_thresholds(s, C.tail_counts(s))


@register("ced_to_tag", "WITH " + _CED_STATS + """
SELECT line_id, ced,
  CASE WHEN ced <= (SELECT low_threshold FROM th) THEN '<2formal>'
       WHEN ced >= (SELECT high_threshold FROM th) THEN '<2informal>' ELSE '<2unk>' END AS src_tag,
  CASE WHEN ced <= (SELECT low_threshold FROM th) THEN '<2informal>'
       WHEN ced >= (SELECT high_threshold FROM th) THEN '<2formal>' ELSE '<2unk>' END AS tgt_tag
FROM v_score""", ["v_score"])
def q_ced_to_tag(spark, d):
    return C.ced_to_tag(T.v_score(spark, d), pos="formal", neg="informal").select("line_id", "ced", "src_tag", "tgt_tag")


# ---------------------------------------------------------------- scalar text functions

from ..functions import rules as R  # noqa: E402
from ..functions import text as X  # noqa: E402
from ..operators import filters as FL  # noqa: E402
from ..operators import joins as J  # noqa: E402
from ..operators import lepod as L  # noqa: E402
from ..operators import mix as M  # noqa: E402
from ..operators import sequence as S  # noqa: E402
from .oracle_views import nt, toks  # noqa: E402


def _text(spark, d):
    return T.v_text(spark, d)


@register("tag_prefix", "SELECT pair_id, '<2formal> ' || src AS src, '<2informal> ' || tgt AS tgt FROM v_bitext",
          ["v_bitext"])
def q_tag_prefix(spark, d):
    b = T.v_bitext(spark, d)
    return b.select("pair_id", X.tag_prefix("src", "formal").alias("src"), X.tag_prefix("tgt", "informal").alias("tgt"))


@register("factor_stream", "SELECT pair_id, regexp_replace(src, '[^ ]+', '<2informal>', 'g') AS factor FROM v_bitext",
          ["v_bitext"])
def q_factor_stream(spark, d):
    return T.v_bitext(spark, d).select("pair_id", X.factor_stream("src", "informal").alias("factor"))


@register("strip_tags", """SELECT line_id, regexp_replace('<2formal> ' || text || ' <2unk> end', '<2[a-z]+> ', '', 'g') AS text
FROM v_text""", ["v_text"])
def q_strip_tags(spark, d):
    e = _text(spark, d)
    tagged = F.concat(F.lit("<2formal> "), F.col("text"), F.lit(" <2unk> end"))
    return e.select("line_id", X.strip_tags(tagged).alias("text"))


@register("undo_subword", """SELECT line_id, regexp_replace(regexp_replace(text, 'e', 'e@@ ', 'g'), '(@@ )|(@@ ?$)', '', 'g') AS text
FROM v_text""", ["v_text"])
def q_undo_subword(spark, d):
    e = _text(spark, d)
    return e.select("line_id", X.undo_subword(F.regexp_replace("text", "e", "e@@ ")).alias("text"))


@register("normalize_all_caps", """SELECT line_id, CASE WHEN upper(t) = t AND lower(t) <> t
  THEN upper(substr(lower(t), 1, 1)) || substr(lower(t), 2) ELSE t END AS text
FROM (SELECT line_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM v_text)""", ["v_text"])
def q_normalize_all_caps(spark, d):
    return _text(spark, d).select("line_id", X.normalize_all_caps("text").alias("text"))


@register("tokens_lower", f"SELECT line_id, lower(text) AS lower_text, {nt('text')} AS n_tokens FROM v_text", ["v_text"])
def q_tokens_lower(spark, d):
    return _text(spark, d).select("line_id", X.lowercase("text").alias("lower_text"), X.n_tokens("text").alias("n_tokens"))


@register("strip_nonprinting", "SELECT line_id, regexp_replace(text, '\\p{C}', ' ', 'g') AS text FROM v_lines",
          ["v_lines"])
def q_strip_nonprinting(spark, d):
    return T.v_lines(spark, d).select("line_id", X.strip_nonprinting("text").alias("text"))


@register("normalize_punctuation",
          "SELECT line_id, " + R.duckdb_chain("text", R.PUNCT_RULES_COMMON + R.PUNCT_RULES_EN) + " AS text FROM v_text",
          ["v_text"])
def q_normalize_punctuation(spark, d):
    return _text(spark, d).select("line_id", X.normalize_punctuation("text", "en").alias("text"))


@register("tokenize", "SELECT line_id, " + R.duckdb_chain("text", R.TOKENIZE_RULES) + " AS text FROM v_text", ["v_text"])
def q_tokenize(spark, d):
    return _text(spark, d).select("line_id", X.tokenize("text").alias("text"))


@register("normalize_punctuation_other",
          "SELECT line_id, " + R.duckdb_chain("text", R.PUNCT_RULES_COMMON + R.PUNCT_RULES_OTHER) + " AS text FROM v_text", ["v_text"])
def q_normalize_punctuation_other(spark, d):
    return _text(spark, d).select("line_id", X.normalize_punctuation("text", "fr").alias("text"))


def _apostrophes(x: str) -> str:
    """Lines of the tables with apostrophes in places where languages differ."""
    return f"regexp_replace(regexp_replace({x}, 'e ', 'e' || chr(39), 'g'), ' (a|o)', ' ' || chr(39) || '\\1', 'g')"


@register("tokenize_fr", "SELECT line_id, " + R.duckdb_chain(_apostrophes("text"), R.tokenize_rules("fr")) + " AS fr, "
          + R.duckdb_chain(_apostrophes("text"), R.tokenize_rules("de")) + " AS de FROM v_text", ["v_text"])
def q_tokenize_fr(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", "e ", "e'"), " (a|o)", " '$1")
    return _text(spark, d).select("line_id", X.tokenize(t, "fr").alias("fr"), X.tokenize(t, "de").alias("de"))


@register("detokenize",
          "SELECT line_id, " + R.duckdb_chain(R.duckdb_chain("text", R.TOKENIZE_RULES), R.DETOKENIZE_RULES) + " AS text FROM v_text",
          ["v_text"])
def q_detokenize(spark, d):
    return _text(spark, d).select("line_id", X.detokenize(X.tokenize("text")).alias("text"))


@register("detruecase", "SELECT line_id, upper(substr(text, 1, 1)) || substr(text, 2) AS text FROM v_text", ["v_text"])
def q_detruecase(spark, d):
    return _text(spark, d).select("line_id", X.detruecase("text").alias("text"))


def _post_sql(x: str, detrue: bool) -> str:
    s = f"regexp_replace(regexp_replace({x}, '<2[a-z]+> ', '', 'g'), '(@@ )|(@@ ?$)', '', 'g')"
    if detrue:
        s = f"upper(substr({s}, 1, 1)) || substr({s}, 2)"
    return R.duckdb_chain(s, R.DETOKENIZE_RULES)


@register("postprocess_outputs", f"""SELECT seg_id,
  {_post_sql("'<2formal> ' || regexp_replace(hyp, 'a', 'a@@ ', 'g')", True)} AS formal_out,
  {_post_sql("'<2informal> ' || regexp_replace(hyp, 'a', 'a@@ ', 'g')", False)} AS informal_out
FROM v_hyps""", ["v_hyps"])
def q_postprocess_outputs(spark, d):
    h, _ = T.v_hyps_refs(spark, d)
    raw = F.regexp_replace("hyp", "a", "a@@ ")
    return h.select(
        "seg_id",
        X.postprocess(F.concat(F.lit("<2formal> "), raw), "formal", True).alias("formal_out"),
        X.postprocess(F.concat(F.lit("<2informal> "), raw), "informal", True).alias("informal_out"),
    )


@register("tag_sources", """SELECT seg_id, '<2formal> ' || hyp AS src, regexp_replace(hyp, '[^ ]+', '<2formal>', 'g') AS factor,
  hyp AS unk_src FROM v_hyps""", ["v_hyps"])
def q_tag_sources(spark, d):
    h, _ = T.v_hyps_refs(spark, d)
    a = FL.tag_sources(h.select("seg_id", F.col("hyp").alias("src")), "tag-src", "formal")
    b = FL.tag_sources(h.select("seg_id", F.col("hyp").alias("src")), "factor-concat", "formal")
    c = FL.tag_sources(h.select("seg_id", F.col("hyp").alias("unk_src")), "tag", "unk", col="unk_src")
    return a.join(b.select("seg_id", "factor"), "seg_id").join(c, "seg_id")


# ---------------------------------------------------------------- sources and filters

@register("markup_lines", """SELECT page_id, line_no, text FROM (
  SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10))) AS text,
         CAST(unnest(range(1, len(string_split(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10))) + 1)) AS INTEGER) AS line_no
  FROM pages) WHERE text <> ''""")
def q_markup_lines(spark, d):
    from ..sources import io as IO

    return IO.markup_lines(T.table(spark, d, "pages"), "html", key="page_id")


@register("project_fields", "SELECT pair_id, tgt FROM v_bitext", ["v_bitext"])
def q_project_fields(spark, d):
    return FL.project_fields(T.v_bitext(spark, d), ["pair_id", "tgt"])


@register("drop_matching", "SELECT pair_id, src, tgt FROM v_bitext WHERE NOT (regexp_matches(src, 'q') OR regexp_matches(tgt, 'q'))",
          ["v_bitext"])
def q_drop_matching(spark, d):
    return FL.drop_matching(T.v_bitext(spark, d), ["src", "tgt"], "q")


@register("drop_empty", "SELECT line_id, text FROM v_lines WHERE text <> ''", ["v_lines"])
def q_drop_empty(spark, d):
    return FL.drop_empty(T.v_lines(spark, d).select("line_id", "text"))


@register("max_length_filter", f"SELECT pair_id, src, tgt FROM v_bitext WHERE {nt('src')} <= 51 AND {nt('tgt')} <= 50",
          ["v_bitext"])
def q_max_length_filter(spark, d):
    return FL.max_length_filter(T.v_bitext(spark, d), "tag-src", 50)


@register("ratio_clean", f"""SELECT pair_id, src, tgt FROM (SELECT *, {nt('src')} AS n1, {nt('tgt')} AS n2 FROM v_bitext)
WHERE n1 BETWEEN 1 AND 1000 AND n2 BETWEEN 1 AND 1000 AND n1 <= 3 * n2 AND n2 <= 3 * n1""", ["v_bitext"])
def q_ratio_clean(spark, d):
    return FL.ratio_clean(T.v_bitext(spark, d), 3, 1, 1000)


def _wordset_sql(x: str) -> str:
    return f"list_distinct(list_filter({toks('lower(' + x + ')')}, lambda w: NOT regexp_full_match(w, '[\\p{{P}}\\p{{S}}]+')))"


@register("near_identical_filter", f"""SELECT pair_id, src, tgt FROM (
  SELECT *, {_wordset_sql('src')} AS a, {_wordset_sql('tgt')} AS b FROM v_bitext)
WHERE least(len(a), len(b)) = 0 OR len(list_intersect(a, b)) / least(len(a), len(b)) < 0.5""", ["v_bitext"])
def q_near_identical_filter(spark, d):
    return FL.near_identical_filter(T.v_bitext(spark, d), 0.5)


@register("bitext_clean", f"""SELECT DISTINCT src, tgt FROM (SELECT *, {nt('src')} AS n1, {nt('tgt')} AS n2 FROM v_bitext)
WHERE n1 > 0 AND n2 > 0 AND greatest(n1, n2) <= 2.0 * least(n1, n2)""", ["v_bitext"])
def q_bitext_clean(spark, d):
    return FL.bitext_clean(T.v_bitext(spark, d).select("src", "tgt"), 2.0, unique=True)


@register("distinct_rows", "SELECT DISTINCT lang, text FROM v_lines", ["v_lines"])
def q_distinct_rows(spark, d):
    return M.distinct_rows(T.v_lines(spark, d), ["lang", "text"])


# ---------------------------------------------------------------- mixtures

@register("concat_corpora", """SELECT line_id, text, 1 AS part FROM v_pos UNION ALL SELECT line_id, text, 2 AS part FROM v_neg
UNION ALL SELECT line_id, text, 3 AS part FROM v_pool""", ["v_pos", "v_neg", "v_pool"])
def q_concat_corpora(spark, d):
    parts = [f(spark, d).select("line_id", "text") for f in (T.v_pos, T.v_neg, T.v_pool)]
    return M.concat_corpora(parts)


@register("replicate", "SELECT pair_id, src, tgt, CAST(c AS INTEGER) AS copy FROM v_bitext, range(1, 11) r(c)", ["v_bitext"])
def q_replicate(spark, d):
    return M.replicate(T.v_bitext(spark, d), 10)


_BIDI_SQL = """SELECT 1 AS part, pair_id, '<2informal> ' || src AS src, '<2formal> ' || tgt AS tgt FROM v_bitext
UNION ALL SELECT 2 AS part, pair_id, '<2formal> ' || tgt AS src, '<2informal> ' || src AS tgt FROM v_bitext"""


@register("bidirectional", _BIDI_SQL, ["v_bitext"])
def q_bidirectional(spark, d):
    return M.bidirectional(T.v_bitext(spark, d), "formal", "informal", "tag", a="src", b="tgt", key="pair_id")


@register("bidirectional_factor", """SELECT 1 AS part, pair_id, src, tgt, regexp_replace(src, '[^ ]+', '<2informal>', 'g') AS factor
FROM v_bitext UNION ALL
SELECT 2 AS part, pair_id, tgt AS src, src AS tgt, regexp_replace(tgt, '[^ ]+', '<2formal>', 'g') AS factor FROM v_bitext""",
          ["v_bitext"])
def q_bidirectional_factor(spark, d):
    return M.bidirectional(T.v_bitext(spark, d), "formal", "informal", "factor-concat", a="src", b="tgt", key="pair_id")


@register("identity_pairs", """SELECT 1 AS part, pair_id, src, src AS tgt FROM v_bitext
UNION ALL SELECT 2 AS part, pair_id, tgt AS src, tgt FROM v_bitext""", ["v_bitext"])
def q_identity_pairs(spark, d):
    return M.identity_pairs(T.v_bitext(spark, d), a="src", b="tgt", key="pair_id")


@register("multitask_mix", """SELECT part, CAST(c AS INTEGER) AS copy, pair_id, src, tgt FROM (""" + _BIDI_SQL + """) x, range(1, 4) r(c)
UNION ALL SELECT 3 AS part, 1 AS copy, line_id AS pair_id, '<2unk> ' || text AS src, '<2unk> ' || text AS tgt FROM v_pool""",
          ["v_bitext", "v_pool"])
def q_multitask_mix(spark, d):
    pool = T.v_pool(spark, d).select(F.col("line_id").alias("pair_id"), F.col("text").alias("src"), F.col("text").alias("tgt"))
    return M.multitask_mix(T.v_bitext(spark, d), pool, 3, "formal", "informal", a="src", b="tgt", key="pair_id")


@register("style_mix", """SELECT 1 AS part, pair_id, '<2informal> ' || src AS src, tgt FROM v_bitext
UNION ALL SELECT 2 AS part, pair_id, '<2formal> ' || tgt AS src, src AS tgt FROM v_bitext
UNION ALL SELECT 3 AS part, line_id AS pair_id, '<2formal> ' || text AS src, text AS tgt FROM v_pos""", ["v_bitext", "v_pos"])
def q_style_mix(spark, d):
    ad = T.v_pos(spark, d).select(F.col("line_id").alias("pair_id"), F.col("text").alias("src"), F.col("text").alias("tgt"))
    return M.style_mix(T.v_bitext(spark, d), ad, "formal", "informal", ad_tag="formal", a="src", b="tgt", key="pair_id")


@register("combine_domains", """SELECT line_id, lang, source,
  row_number() OVER (PARTITION BY lang ORDER BY source, line_id) AS combined_no FROM v_lines""", ["v_lines"])
def q_combine_domains(spark, d):
    ln = T.v_lines(spark, d).select("line_id", "lang", "source")
    numbered = S.with_position(ln, "pos", order_by=["line_id"], partition_by=["lang", "source"])
    return M.combine_domains(numbered, ["lang"], domain="source", key="pos").select("line_id", "lang", "source", "combined_no")


# ---------------------------------------------------------------- joins

def _zip_inputs(spark, d):
    """User turns and assistant turns, keyed by the assistant's place: some of each have no partner."""
    c = T.table(spark, d, "conversations")
    key = lambda more: (F.col("conv_id") * 2 * T.TURN_STRIDE + T._below(F.col("turn"), T.TURN_STRIDE, "turns of a conversation") + more).alias("pair_id")
    a = c.filter("role = 'user'").select(key(1), F.col("text").alias("src"))
    return a, c.filter("role = 'assistant'").select(key(0), F.col("text").alias("tgt"), F.col("turn").cast("int").alias("number"))


_ZIP_A = "(SELECT conv_id * 2000 + turn + 1 AS pair_id, text AS src FROM conversations WHERE role = 'user')"
_ZIP_B = "(SELECT conv_id * 2000 + turn AS pair_id, text AS tgt, CAST(turn AS INTEGER) AS number FROM conversations WHERE role = 'assistant')"


@register("zip_lines_pad", f"""SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.src, '') AS src, coalesce(b.tgt, '') AS tgt, b.number
FROM {_ZIP_A} a FULL OUTER JOIN {_ZIP_B} b ON a.pair_id = b.pair_id""")
def q_zip_lines_pad(spark, d):
    a, b = _zip_inputs(spark, d)
    return J.zip_lines(a, b, "pad", key="pair_id")


@register("zip_lines_truncate", f"""SELECT a.pair_id, a.src, b.tgt, b.number
FROM {_ZIP_A} a JOIN {_ZIP_B} b ON a.pair_id = b.pair_id""")
def q_zip_lines_truncate(spark, d):
    a, b = _zip_inputs(spark, d)
    return J.zip_lines(a, b, "truncate", key="pair_id")


@register("zip_lines_strict", "SELECT doc_id, lang, n_chars, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents")
def q_zip_lines_strict(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    n = T.v_lines(spark, d).groupBy("doc_id").agg(F.max("line_no").alias("n_lines"))
    return J.zip_lines(docs, n, "strict", key="doc_id")


@register("attach_references", """SELECT h.system, h.seg_id, h.hyp,
  array_to_string(list(r.ref ORDER BY r.ref_no), ' ||| ') AS refs
FROM v_hyps h JOIN v_refs r ON r.system = h.system AND r.seg_id = h.seg_id GROUP BY h.system, h.seg_id, h.hyp""",
          ["v_hyps", "v_refs"])
def q_attach_references(spark, d):
    h, r = T.v_hyps_refs(spark, d)
    j = J.attach_references(h, r, ["system", "seg_id"])
    return j.select("system", "seg_id", "hyp", F.array_join("refs", " ||| ").alias("refs"))


@register("pair_outputs", """SELECT a.system, a.seg_id, a.ref AS text1, b.ref AS text2 FROM v_refs a
JOIN v_refs b ON b.system = a.system AND b.seg_id = a.seg_id AND b.ref_no = 1 WHERE a.ref_no = 0""", ["v_refs"])
def q_pair_outputs(spark, d):
    """Four texts for each segment, of which two styles are put side by side."""
    _, refs = T.v_hyps_refs(spark, d)
    style = F.element_at(F.array(*[F.lit(x) for x in ("formal", "informal", "other", "other")]), F.col("ref_no") + 1)
    return J.pair_outputs(refs.select("system", "seg_id", style.alias("style"), F.col("ref").alias("text")), ["system", "seg_id"])


@register("overlay_merge", """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id,
  CASE WHEN l.doc_id IS NOT NULL THEN NULL ELSE d.n_chars END AS n_chars,
  CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE NULL END AS quality,
  l.doc_id IS NOT NULL AS from_new
FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""")
def q_overlay_merge(spark, d):
    old = T.table(spark, d, "documents").select("doc_id", "n_chars")
    new = T.table(spark, d, "labels").select("doc_id", "quality")
    return J.overlay_merge(old, new, "doc_id")


@register("rekey_vectors", """SELECT d.doc_id, e.label, CAST(len(e.embedding) AS INTEGER) AS n_dims, e.vec_id IS NULL AS is_new
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_rekey_vectors(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id")
    vec = T.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    j = J.rekey_vectors(docs, vec, "doc_id")
    return j.select("doc_id", "label", F.size("embedding").cast("int").alias("n_dims"), "is_new").withColumn(
        "n_dims", F.when(F.col("is_new"), F.lit(None).cast("int")).otherwise(F.col("n_dims")))


@register("pair_with_references", """SELECT h.seg_id, h.hyp AS src, r.ref_no, r.ref AS tgt
FROM v_hyps h JOIN v_refs r ON r.seg_id = h.seg_id""", ["v_hyps", "v_refs"])
def q_pair_with_references(spark, d):
    h, r = T.v_hyps_refs(spark, d)
    return J.pair_with_references(h.select("seg_id", F.col("hyp").alias("src")),
                                  r.select("seg_id", "ref_no", F.col("ref").alias("tgt")), key="seg_id")


@register("interleave_references", """SELECT r.seg_id, r.ref_no, r.ref,
  (n.line_no - 1) * 4 + r.ref_no + 1 AS interleaved_no
FROM v_refs r JOIN (SELECT seg_id, row_number() OVER (ORDER BY seg_id) AS line_no FROM v_hyps) n ON n.seg_id = r.seg_id""",
          ["v_hyps", "v_refs"])
def q_interleave_references(spark, d):
    h, r = T.v_hyps_refs(spark, d)
    n = S.with_position(h.select("seg_id"), "line_no", order_by=["seg_id"])
    return J.interleave_references(r.join(n, "seg_id"), 4).select("seg_id", "ref_no", "ref", "interleaved_no")


# ---------------------------------------------------------------- positions, sorts, selection

@register("line_number", "SELECT line_id, row_number() OVER (ORDER BY line_id) AS line_no FROM v_text", ["v_text"])
def q_line_number(spark, d):
    return S.line_number(_text(spark, d).select("line_id").orderBy("line_id"))


@register("rank_by_score", "SELECT line_id, ced, row_number() OVER (ORDER BY ced, line_id) AS rank FROM v_score",
          ["v_score"])
def q_rank_by_score(spark, d):
    return S.rank_by_score(T.v_score(spark, d).select("line_id", "ced"), "ced", "line_id")


@register("sort_by_score", "SELECT line_id, ced FROM v_score", ["v_score"])
def q_sort_by_score(spark, d):
    return S.sort_by_score(T.v_score(spark, d).select("line_id", "ced"), "ced", "line_id")


@register("balanced_chunks", """SELECT line_id, CAST(least(7, floor(coalesce(sum(b) OVER (ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8
  / (SELECT sum(strlen(text) + 1) FROM v_text))) AS INTEGER) AS chunk
FROM (SELECT line_id, strlen(text) + 1 AS b FROM v_text)""", ["v_text"])
def q_balanced_chunks(spark, d):
    return S.balanced_chunks(_text(spark, d).select("line_id", "text"), 8, key="line_id").select("line_id", "chunk")


@register("ordered_concat", "SELECT line_id, row_number() OVER (ORDER BY line_id) AS out_line_no FROM v_text", ["v_text"])
def q_ordered_concat(spark, d):
    ch = S.balanced_chunks(_text(spark, d).select("line_id", "text"), 8, key="line_id")
    return S.ordered_concat(ch, key="line_id").select("line_id", "out_line_no")


@register("select_lowest", "SELECT line_id, ced FROM v_score ORDER BY ced, line_id LIMIT 100", ["v_score"])
def q_select_lowest(spark, d):
    return S.select_lowest(T.v_score(spark, d).select("line_id", "ced"), 100, "ced", "line_id")


@register("select_highest", "SELECT line_id, ced FROM v_score ORDER BY ced DESC, line_id DESC LIMIT 100", ["v_score"])
def q_select_highest(spark, d):
    return S.select_highest(T.v_score(spark, d).select("line_id", "ced"), 100, "ced", "line_id")


@register("select_lowest_large", "SELECT line_id, ced FROM v_score ORDER BY ced, line_id LIMIT 2000", ["v_score"])
def q_select_lowest_large(spark, d):
    # max_take below n: the numbered range-sorted path used for large selections
    return S.select_lowest(T.v_score(spark, d).select("line_id", "ced"), 2000, "ced", "line_id", max_take=1000)


@register("head_n", "SELECT line_id, text FROM (SELECT line_id, text, row_number() OVER (ORDER BY line_id) AS p FROM v_pool) WHERE p <= 500",
          ["v_pool"])
def q_head_n(spark, d):
    pool = S.with_position(T.v_pool(spark, d).select("line_id", "text"), "p", order_by=["line_id"])
    return S.head_n(pool, 500, key="p").select("line_id", "text")


@register("seeded_shuffle", """SELECT line_id, row_number() OVER (ORDER BY md5('7|' || CAST(line_id AS VARCHAR)), line_id) AS shuffled_no
FROM v_text""", ["v_text"])
def q_seeded_shuffle(spark, d):
    return S.seeded_shuffle(_text(spark, d).select("line_id"), 7, key="line_id")


@register("row_parity", """SELECT (SELECT count(*) FROM v_pos) AS n_a, (SELECT count(*) FROM v_neg) AS n_b,
  (SELECT count(*) FROM v_pos) = (SELECT count(*) FROM v_neg) AS same""", ["v_pos", "v_neg"])
def q_row_parity(spark, d):
    return S.row_parity(T.v_pos(spark, d), T.v_neg(spark, d))


@register("selection_budget", "SELECT CAST(count(*) * 12 AS BIGINT) AS budget FROM v_neg", ["v_neg"])
def q_selection_budget(spark, d):
    return C.selection_budget(T.v_neg(spark, d), 12)


@register("plain_select", """SELECT line_id, text FROM (SELECT line_id, text, row_number() OVER (ORDER BY line_id) AS p FROM v_pool)
WHERE p <= (SELECT 2 * 2 * count(*) FROM v_neg)""", ["v_pool", "v_neg"])
def q_plain_select(spark, d):
    pool = S.with_position(T.v_pool(spark, d).select("line_id", "text"), "p", order_by=["line_id"])
    return C.plain_select(pool, T.v_neg(spark, d), 2, key="p").select("line_id", "text")


# ---------------------------------------------------------------- LePoD

_LEPOD_SQL = f"""p AS (SELECT pair_id, {toks('text1')} AS t1, {toks('text2')} AS t2 FROM v_pairs),
a AS (SELECT pair_id, pos1, tok, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos1) AS occ
      FROM (SELECT pair_id, unnest(t1) AS tok, unnest(range(len(t1))) AS pos1 FROM p)),
b AS (SELECT pair_id, pos2, tok, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos2) AS occ
      FROM (SELECT pair_id, unnest(t2) AS tok, unnest(range(len(t2))) AS pos2 FROM p)),
l AS (SELECT a.pair_id, a.pos1, b.pos2 FROM a JOIN b ON a.pair_id = b.pair_id AND a.tok = b.tok AND a.occ = b.occ),
lr AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pos1) - 1 AS c,
              row_number() OVER (PARTITION BY pair_id ORDER BY pos2) - 1 AS r2 FROM l),
cs AS (SELECT pair_id, c, r2 - c AS d, sum(r2 - c) OVER (PARTITION BY pair_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS cum FROM lr),
sg AS (SELECT *, coalesce(sum(CASE WHEN cum = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY c
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM cs),
segs AS (SELECT pair_id, seg, max(abs(d)) AS mx, bool_or(cum = 0) AS closed FROM sg GROUP BY pair_id, seg),
pod AS (SELECT pair_id, sum(CASE WHEN closed THEN mx ELSE 0 END) AS tot FROM segs GROUP BY pair_id),
nl AS (SELECT pair_id, count(*) AS n FROM l GROUP BY pair_id),
scored AS (SELECT p.pair_id,
  ((len(t1) - coalesce(n, 0)) / len(t1) + (len(t2) - coalesce(n, 0)) / len(t2)) / 2.0 AS led,
  CASE WHEN coalesce(n, 0) > 0 THEN tot / n ELSE 0.0 END AS pod, true AS valid, false AS skipped
  FROM p LEFT JOIN nl ON nl.pair_id = p.pair_id LEFT JOIN pod ON pod.pair_id = p.pair_id)
"""


@register("lepod", "WITH " + _LEPOD_SQL + "SELECT pair_id, round(led, 6) AS led, round(pod, 6) AS pod, valid, skipped FROM scored",
          ["v_pairs"])
def q_lepod(spark, d):
    s = L.lepod(T.v_pairs(spark, d))
    return s.withColumns({"led": r6("led"), "pod": r6("pod")})


@register("lepod_report", "WITH " + _LEPOD_SQL + """SELECT count(*) AS n_pairs, 0 AS n_skipped, 0 AS n_invalid,
  round(avg(led), 6) AS led_mean, round(min(led), 6) AS led_min, round(max(led), 6) AS led_max,
  round(avg(pod), 6) AS pod_mean, round(min(pod), 6) AS pod_min, round(max(pod), 6) AS pod_max,
  count_if(led > 0) AS n_nonzero_led, count_if(pod > 0) AS n_nonzero_pod, count_if(led = 0 AND pod = 0) AS n_all_zero,
  round(count_if(led > 0) * 100.0 / count(*), 2) AS pct_nonzero_led, round(count_if(pod > 0) * 100.0 / count(*), 2) AS pct_nonzero_pod,
  round(count_if(led = 0 AND pod = 0) * 100.0 / count(*), 2) AS pct_all_zero FROM scored""", ["v_pairs"])
def q_lepod_report(spark, d):
    r = L.lepod_report(L.lepod(T.v_pairs(spark, d)))
    return r.withColumns({c: r6(c) for c in ["led_mean", "led_min", "led_max", "pod_mean", "pod_min", "pod_max"]})


@register("lepod_score_summary", "WITH " + _LEPOD_SQL + """SELECT round(avg(led), 6) AS led_mean, round(min(led), 6) AS led_min,
  round(max(led), 6) AS led_max, round(avg(pod), 6) AS pod_mean, round(min(pod), 6) AS pod_min, round(max(pod), 6) AS pod_max
FROM scored""", ["v_pairs"])
def q_lepod_score_summary(spark, d):
    r = L.score_summary(L.lepod(T.v_pairs(spark, d)))
    return r.select(*[r6(c).alias(c) for c in r.columns])


@register("lepod_nonzero_summary", "WITH " + _LEPOD_SQL + """SELECT count(*) AS n_pairs,
  count_if(led > 0) AS n_nonzero_led, count_if(pod > 0) AS n_nonzero_pod, count_if(led = 0 AND pod = 0) AS n_all_zero,
  round(count_if(led > 0) * 100.0 / count(*), 2) AS pct_nonzero_led, round(count_if(pod > 0) * 100.0 / count(*), 2) AS pct_nonzero_pod,
  round(count_if(led = 0 AND pod = 0) * 100.0 / count(*), 2) AS pct_all_zero FROM scored""", ["v_pairs"])
def q_lepod_nonzero_summary(spark, d):
    return L.nonzero_summary(L.lepod(T.v_pairs(spark, d)))


@register("exact_align", """SELECT a.pair_id, CAST(a.pos1 AS INTEGER) AS start1, 1 AS len1, CAST(b.pos2 AS INTEGER) AS start2, 1 AS len2
FROM (SELECT pair_id, pos1, tok, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos1) AS occ
      FROM (SELECT pair_id, unnest(t1) AS tok, unnest(range(len(t1))) AS pos1 FROM (SELECT pair_id, """ + toks("text1") + """ AS t1 FROM v_pairs))) a
JOIN (SELECT pair_id, pos2, tok, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos2) AS occ
      FROM (SELECT pair_id, unnest(t2) AS tok, unnest(range(len(t2))) AS pos2 FROM (SELECT pair_id, """ + toks("text2") + """ AS t2 FROM v_pairs))) b
ON a.pair_id = b.pair_id AND a.tok = b.tok AND a.occ = b.occ""", ["v_pairs"])
def q_exact_align(spark, d):
    return L.exact_align(L.prepare_pairs(T.v_pairs(spark, d)))


@register("exact_align_chunks")
def q_exact_align_chunks(spark, d):
    return L.exact_align(L.prepare_pairs(T.v_pairs(spark, d)), method="chunks")


@register("lepod_report_chunks")
def q_lepod_report_chunks(spark, d):
    r = L.lepod_report(L.lepod(T.v_pairs(spark, d), method="chunks"))
    return r.withColumns({c: r6(c) for c in ["led_mean", "led_min", "led_max", "pod_mean", "pod_min", "pod_max"]})


@register("lepod_detail", "WITH " + _LEPOD_SQL + """,
m1 AS (SELECT a.pair_id, string_agg(a.tok, ' ' ORDER BY a.pos1) FILTER (l.pos1 IS NOT NULL) AS mat1,
              string_agg(a.tok, ' ' ORDER BY a.pos1) FILTER (l.pos1 IS NULL) AS sub1
       FROM a LEFT JOIN l ON l.pair_id = a.pair_id AND l.pos1 = a.pos1 GROUP BY a.pair_id),
m2 AS (SELECT b.pair_id, string_agg(b.tok, ' ' ORDER BY b.pos2) FILTER (l.pos2 IS NOT NULL) AS mat2,
              string_agg(b.tok, ' ' ORDER BY b.pos2) FILTER (l.pos2 IS NULL) AS sub2
       FROM b LEFT JOIN l ON l.pair_id = b.pair_id AND l.pos2 = b.pos2 GROUP BY b.pair_id)
SELECT s.pair_id, round(led, 6) AS led, round(pod, 6) AS pod, valid, skipped, coalesce(mat1, '') AS mat1, coalesce(sub1, '') AS sub1,
  coalesce(mat2, '') AS mat2, coalesce(sub2, '') AS sub2 FROM scored s JOIN m1 ON m1.pair_id = s.pair_id JOIN m2 ON m2.pair_id = s.pair_id""",
          ["v_pairs"])
def q_lepod_detail(spark, d):
    return L.lepod_detail(T.v_pairs(spark, d)).withColumns({"led": r6("led"), "pod": r6("pod")})


@register("attach_alignment", "WITH " + _LEPOD_SQL + """, sp AS (
  SELECT pair_id, string_agg(pos1 || '-' || pos2, ' ' ORDER BY pos1) AS spans FROM l GROUP BY pair_id)
SELECT p.pair_id, coalesce(spans, '') AS spans FROM p LEFT JOIN sp ON sp.pair_id = p.pair_id""", ["v_pairs"])
def q_attach_alignment(spark, d):
    p = L.prepare_pairs(T.v_pairs(spark, d))
    j = J.attach_alignment(p.select("pair_id"), L.exact_align(p))
    spans = F.transform(F.array_sort("spans"), lambda x: F.concat_ws("-", x["start1"], x["start2"]))
    return j.select("pair_id", F.array_join(spans, " ").alias("spans"))


@register("expand_spans", "WITH " + _LEPOD_SQL + """
SELECT a.pair_id, 1 AS side, CAST(a.pos1 AS INTEGER) AS pos, a.tok AS token, CAST(l.pos2 AS INTEGER) AS align, l.pos2 IS NOT NULL AS exact
FROM a LEFT JOIN l ON l.pair_id = a.pair_id AND l.pos1 = a.pos1
UNION ALL SELECT b.pair_id, 2, CAST(b.pos2 AS INTEGER), b.tok, CAST(l.pos1 AS INTEGER), l.pos1 IS NOT NULL
FROM b LEFT JOIN l ON l.pair_id = b.pair_id AND l.pos2 = b.pos2""", ["v_pairs"])
def q_expand_spans(spark, d):
    return L.expand_spans(L.align_tokens(T.v_pairs(spark, d)))


@register("reindex_aligned", "WITH " + _LEPOD_SQL + """
SELECT pair_id, 1 AS side, CAST(pos1 AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY pos1) - 1 AS INTEGER) AS idx FROM l
UNION ALL SELECT pair_id, 2, CAST(pos2 AS INTEGER), CAST(row_number() OVER (PARTITION BY pair_id ORDER BY pos2) - 1 AS INTEGER) FROM l""", ["v_pairs"])
def q_reindex_aligned(spark, d):
    t = L.align_tokens(T.v_pairs(spark, d), with_tokens=False)
    t = L.reindex_aligned(t.select("pair_id", "a1", "a2"), {"i1": "a1", "i2": "a2"})
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"i{k}").alias("i")) for k in (1, 2)])  # one alignment for both
    both = t.select("pair_id", F.inline(sides)).select("pair_id", "side", F.posexplode("i").alias("pos", "idx"))
    return both.filter("idx IS NOT NULL")


@register("distortion", "WITH " + _LEPOD_SQL + "SELECT pair_id, CAST(c AS INTEGER) AS head, CAST(d AS INTEGER) AS d FROM cs", ["v_pairs"])
def q_distortion(spark, d):
    t = L.align_tokens(T.v_pairs(spark, d), with_tokens=False)
    return t.select("pair_id", F.posexplode(L.distortion(F.col("a1"), F.col("x1"), F.col("x2"))).alias("head", "d"))


@register("led_score", "WITH " + _LEPOD_SQL + "SELECT pair_id, round(led, 6) AS led FROM scored", ["v_pairs"])
def q_led_score(spark, d):
    return L.align_tokens(T.v_pairs(spark, d), with_tokens=False).select("pair_id", r6(L.led_score(F.col("e1"), F.col("e2"))).alias("led"))


@register("pod_score", "WITH " + _LEPOD_SQL + "SELECT pair_id, round(pod, 6) AS pod FROM scored", ["v_pairs"])
def q_pod_score(spark, d):
    return L.align_tokens(T.v_pairs(spark, d), with_tokens=False).select("pair_id", r6(L.pod_score(F.col("dist"))).alias("pod"))


# ---------------------------------------------------------------- files: round trips through a shared folder

from ..session import shared_folder  # noqa: E402
from ..sources import io as IO  # noqa: E402

_PLAIN = "regexp_replace(text, '[\\r\\t]', ' ', 'g')"  # a line break or tab inside a line would be another line or field


def _plain_lines(spark, d, *more):
    return T.v_lines(spark, d).select("line_id", F.regexp_replace("text", "[\r\t]", " ").alias("text"), *more)


def _part(df):
    return df.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1))


@register("read_lines", f"SELECT line_id, {_PLAIN} AS text FROM v_lines", ["v_lines"])
def q_read_lines(spark, d):
    """S6 writes two columns, S1 reads both back; they line up by part file and line number."""
    root = shared_folder(spark, "lines")
    IO.write_columns(_plain_lines(spark, d), {"line_id": root + "/id", "text": root + "/text"}, ["line_id"])
    a, b = (_part(IO.read_lines(spark, f"{root}/{x}")) for x in ("id", "text"))
    j = J.zip_lines(a.select(F.concat_ws("|", "part", "line_no").alias("k"), F.col("text").cast("bigint").alias("line_id")),
                    b.select(F.concat_ws("|", "part", "line_no").alias("k"), "text"), "strict", key="k")
    return j.select("line_id", "text")


@register("read_layout", f"""SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, {_PLAIN} AS text FROM v_lines""", ["v_lines"])
def q_read_layout(spark, d):
    root = shared_folder(spark, "layout")
    df = _plain_lines(spark, d, "lang", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    df.select("lang", "split", "text").write.partitionBy("lang", "split").text(root)
    return IO.read_layout(spark, root, r"lang=(\w+)/split=(\w+)/", ["lang", "split"]).select("lang", "split", "text")


@register("read_bitext_tsv", f"SELECT line_id, {_PLAIN} AS text FROM v_lines", ["v_lines"])
def q_read_bitext_tsv(spark, d):
    root = shared_folder(spark, "tsv")
    _plain_lines(spark, d).select(F.concat_ws("\t", "line_id", "text").alias("value")).write.option("compression", "gzip").text(root)
    return IO.read_bitext_tsv(spark, root, "line_id", "text").select(F.col("line_id").cast("bigint").alias("line_id"), "text")


@register("read_alignments", "WITH " + _LEPOD_SQL + """
SELECT pair_id, CAST(pos1 AS INTEGER) AS start1, 1 AS len1, CAST(pos2 AS INTEGER) AS start2, 1 AS len2 FROM l""", ["v_pairs"])
def q_read_alignments(spark, d):
    root = shared_folder(spark, "alignments")
    p = L.prepare_pairs(T.v_pairs(spark, d))
    j = J.attach_alignment(p.select("pair_id"), L.exact_align(p))
    spans = F.transform("spans", lambda x: F.concat(x["start2"], F.lit(":"), x["len2"], F.lit(" "), x["start1"], F.lit(":"), x["len1"]))
    block = F.concat(F.array_join(F.concat(F.array(*[F.lit(f"header {k}") for k in range(4)]), spans), "\n"), F.lit("\n"))
    IO.write_columns(j.select("pair_id", block.alias("block")), {"pair_id": root + "/id", "block": root + "/block"}, ["pair_id"])
    ids = _part(IO.read_lines(spark, root + "/id")).select("part", F.col("line_no").alias("block_no"), F.col("text").cast("bigint").alias("pair_id"))
    return _part(IO.read_alignments(spark, root + "/block", "block_no")).join(ids, ["part", "block_no"]).select(
        "pair_id", "start1", "len1", "start2", "len2")


@register("write_scored", "WITH " + _LEPOD_SQL + """
SELECT printf('%.9f', led) || chr(9) || s.pair_id || chr(9) || trim(regexp_replace(v.text1, '[\\r\\t]', ' ', 'g'), ' ') || chr(9)
  || trim(regexp_replace(v.text2, '[\\r\\t]', ' ', 'g'), ' ') AS row
FROM scored s JOIN v_pairs v ON v.pair_id = s.pair_id""", ["v_pairs"])
def q_write_scored(spark, d):
    root = shared_folder(spark, "scored")
    plain = {c: F.regexp_replace(c, "[\r\t]", " ") for c in ("text1", "text2")}  # as in _PLAIN
    pairs = T.v_pairs(spark, d).withColumns(plain)
    IO.write_scored(L.lepod(pairs).join(pairs, "pair_id"), root, "led", digits=9)
    return IO.read_lines(spark, root).select(F.col("text").alias("row"))


@register("append_metrics", """SELECT CAST(run AS INTEGER) AS run, source, count(*) AS n FROM documents, range(1, 4) r(run) GROUP BY run, source""")
def q_append_metrics(spark, d):
    root = shared_folder(spark, "metrics")
    counts = T.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    for run in (1, 2, 3, 2):  # the second run is made again
        IO.append_metrics(counts.select(F.lit(run).alias("run"), "source", "n"), root, ["run"])
    return spark.read.parquet(root)


@register("materialize_once", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q_materialize_once(spark, d):
    root = shared_folder(spark, "stage")
    docs = T.table(spark, d, "documents")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    IO.materialize_once(spark, lambda: counts, root, [docs])
    return IO.materialize_once(spark, lambda: counts.filter("false"), root, [docs])  # is there already: not built again


@register("alias_dataset", "SELECT lang, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def q_alias_dataset(spark, d):
    IO.alias_dataset(T.table(spark, d, "documents").select("lang", "n_chars"), "corpus_alias")
    return spark.sql("SELECT lang, sum(n_chars) AS n_chars FROM corpus_alias GROUP BY lang")


# ---------------------------------------------------------------- language model, cross-entropy, CED

from ..operators import lm as LM  # noqa: E402


def _kn_sql(src: str, p: str, order: int = 2) -> str:
    """Interpolated modified Kneser-Ney in DuckDB: CTEs prefixed `p` over view `src`, model `{p}m`."""
    out = [f"{p}seg AS (SELECT list_concat(['<s>'], {toks('text')}, ['</s>']) AS p FROM {src})"]
    for k in range(1, order + 1):
        out.append(f"""{p}r{k} AS (SELECT g AS ngram, count(*) AS c FROM (
  SELECT unnest(list_transform(range(1, len(p) - {k} + 2), lambda i: array_to_string(p[i:i + {k - 1}], ' '))) AS g FROM {p}seg) GROUP BY g)""")
    for k in range(1, order + 1):
        if k < order:
            out.append(f"""{p}e{k} AS (SELECT substr(ngram, strpos(ngram, ' ') + 1) AS ngram, count(*) AS ext FROM {p}r{k + 1} GROUP BY 1),
{p}a{k} AS (SELECT u.ngram, CASE WHEN split_part(u.ngram, ' ', 1) = '<s>' THEN u.c ELSE coalesce(e.ext, 0) END AS a
  FROM {p}r{k} u LEFT JOIN {p}e{k} e ON e.ngram = u.ngram WHERE u.ngram <> '<s>')""")
        else:
            out.append(f"{p}a{k} AS (SELECT ngram, c AS a FROM {p}r{k} WHERE ngram <> '<s>')")
        ok = "coalesce(e1 BETWEEN 0 AND 1 AND e2 BETWEEN 0 AND 2 AND e3 BETWEEN 0 AND 3, false)"
        out.append(f"""{p}cc{k} AS (SELECT count_if(a = 1)::DOUBLE n1, count_if(a = 2)::DOUBLE n2, count_if(a = 3)::DOUBLE n3,
  count_if(a = 4)::DOUBLE n4 FROM {p}a{k}),
{p}dr{k} AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 THEN n1 / (n1 + 2 * n2) END AS y FROM {p}cc{k}),
{p}dd{k} AS (SELECT 1 - 2 * y * n2 / n1 AS e1, 2 - 3 * y * n3 / n2 AS e2, 3 - 4 * y * n4 / n3 AS e3 FROM {p}dr{k}),
{p}d{k} AS (SELECT CASE WHEN {ok} THEN e1 ELSE 0.5 END AS d1, CASE WHEN {ok} THEN e2 ELSE 1.0 END AS d2,
  CASE WHEN {ok} THEN e3 ELSE 1.5 END AS d3 FROM {p}dd{k}),
{p}g{k} AS (SELECT a.ngram, regexp_replace(a.ngram, ' [^ ]*$', '') AS h, substr(a.ngram, strpos(a.ngram, ' ') + 1) AS tail, a.a,
  CASE WHEN a.a = 1 THEN d.d1 WHEN a.a = 2 THEN d.d2 ELSE d.d3 END AS disc FROM {p}a{k} a, {p}d{k} d)""")
        if k == 1:
            out.append(f"""{p}c1 AS (SELECT sum(a) AS S, sum(disc) / sum(a) AS b, (SELECT count(*) + 1 FROM {p}a1)::DOUBLE AS V FROM {p}g1),
{p}p1 AS (SELECT g.ngram, greatest(g.a - g.disc, 0) / c.S + c.b / c.V AS p FROM {p}g1 g, {p}c1 c
  UNION ALL SELECT '<unk>' AS ngram, c.b / c.V AS p FROM {p}c1 c)""")
        else:
            out.append(f"""{p}c{k} AS (SELECT h, sum(a) AS S, sum(disc) / sum(a) AS b FROM {p}g{k} GROUP BY h),
{p}p{k} AS (SELECT g.ngram, greatest(g.a - g.disc, 0) / c.S + c.b * l.p AS p FROM {p}g{k} g JOIN {p}c{k} c ON c.h = g.h
  JOIN {p}p{k - 1} l ON l.ngram = g.tail)""")
    pt = " UNION ALL ".join(f"SELECT ngram, log10(p) AS log_p FROM {p}p{k}" for k in range(1, order + 1))
    bt = " UNION ALL ".join(f"SELECT h, log10(b) AS log_b FROM {p}c{k}" for k in range(2, order + 1))
    out.append(f"""{p}pt AS ({pt}), {p}bt AS ({bt}),
{p}m AS (SELECT coalesce(pt.ngram, c.h) AS ngram, CAST(len(string_split(coalesce(pt.ngram, c.h), ' ')) AS INTEGER) AS n,
  pt.log_p, c.log_b FROM {p}pt pt FULL OUTER JOIN {p}bt c ON c.h = pt.ngram)""")
    return ",\n".join(out)


def _score_sql(src: str, p: str, order: int = 2, key: str = "line_id") -> str:
    """Scoring of `src` with model CTE `{p}m` -> `{p}s(key, logprob, n_words, n_oov)`."""
    n_grams = ", ".join(f"CASE WHEN i >= {j} THEN array_to_string(raw[i - {j - 1}:i], ' ') END AS g{j}" for j in range(1, order + 1))
    contexts = "".join(f", CASE WHEN i > {j} THEN array_to_string(raw[i - {j}:i - 1], ' ') END AS h{j}" for j in range(1, order))
    joins = " ".join(f"LEFT JOIN {p}m m{j} ON m{j}.ngram = t.g{j}" for j in range(1, order + 1))
    joins += " " + " ".join(f"LEFT JOIN {p}m b{j} ON b{j}.ngram = t.h{j}" for j in range(1, order))
    rest = lambda m: "".join(f" + coalesce(b{j}.log_b, 0)" for j in range(max(m, 1), order))
    cases = " ".join(f"WHEN m{m}.log_p IS NOT NULL THEN m{m}.log_p{rest(m)}" for m in range(order, 0, -1))
    return f"""{p}tk AS (SELECT {key}, list_concat(['<s>'], {toks('text')}, ['</s>']) AS raw FROM {src}),
{p}tx AS (SELECT {key}, raw, unnest(range(2, len(raw) + 1)) AS i FROM {p}tk),
{p}tg AS (SELECT {key}, i, {n_grams}{contexts} FROM {p}tx),
{p}sc AS (SELECT t.{key}, CASE {cases} ELSE (SELECT log_p FROM {p}m WHERE ngram = '<unk>'){rest(0)} END AS lp,
  m1.log_p IS NULL AS oov FROM {p}tg t {joins}),
{p}s AS (SELECT {key}, sum(lp) AS logprob, CAST(count(*) - 1 AS INTEGER) AS n_words, CAST(count_if(oov) AS INTEGER) AS n_oov
  FROM {p}sc GROUP BY {key})"""


def _lm_rows(order: int, suffix: str = ""):
    """A10, J8 and C1 at one order."""
    model = "WITH " + _kn_sql("v_pos", "x", order)
    scored = model + ",\n" + _score_sql("v_pool_e", "x", order)

    def train(spark, d):
        m = LM.train_ngram_lm(T.v_pos(spark, d), "text", order)
        return m.withColumns({"log_p": r6("log_p"), "log_b": r6("log_b")})

    def score(spark, d):
        m = LM.train_ngram_lm(T.v_pos(spark, d), "text", order)
        return LM.lm_score(T.v_pool_e(spark, d), m, "text", "line_id", order).withColumn("logprob", r6("logprob"))

    def xent(spark, d):
        m = LM.train_ngram_lm(T.v_pos(spark, d), "text", order)
        return LM.cross_entropy(T.v_pool_e(spark, d), m, "text", "line_id", order).withColumn("xent", r6("xent"))

    register("train_ngram_lm" + suffix, model + "\nSELECT ngram, n, round(log_p, 6) AS log_p, round(log_b, 6) AS log_b FROM xm", ["v_pos"])(train)
    register("lm_score" + suffix, scored + "\nSELECT line_id, round(logprob, 6) AS logprob, n_words, n_oov FROM xs", ["v_pos", "v_pool_e"])(score)
    register("cross_entropy" + suffix, scored + """
SELECT line_id, round(CASE WHEN n_words > 0 THEN -logprob / n_words END, 6) AS xent, n_words, n_oov FROM xs""", ["v_pos", "v_pool_e"])(xent)


_lm_rows(2)
_lm_rows(3, "_3")
_lm_rows(5, "_5")


def _ced_sql(pos: str, neg: str, pool: str, order: int) -> str:
    """CTEs xp, yp (cross-entropies) and ced."""
    return (_kn_sql(pos, "x", order) + ",\n" + _score_sql(pool, "x", order) + ",\n" + _kn_sql(neg, "y", order) + ",\n"
            + _score_sql(pool, "y", order) + """,
xp AS (SELECT line_id, CASE WHEN n_words > 0 THEN -logprob / n_words END AS xent, n_words, n_oov FROM xs),
yp AS (SELECT line_id, CASE WHEN n_words > 0 THEN -logprob / n_words END AS xent, n_words, n_oov FROM ys),
cd AS (SELECT xp.line_id, xp.xent - yp.xent AS ced0, xp.n_words FROM xp JOIN yp ON yp.line_id = xp.line_id AND yp.n_words = xp.n_words),
ced AS (SELECT line_id, CASE WHEN abs(ced0) < 1e-4 THEN 0.0 ELSE ced0 END AS ced, n_words FROM cd)
""")


_CED_SQL = "WITH " + _ced_sql("v_pos", "v_neg", "v_pool_e", 2)


def _ced(spark, d, order):
    pos = LM.train_ngram_lm(T.v_pos(spark, d), "text", order)
    neg = LM.train_ngram_lm(T.v_neg(spark, d), "text", order)
    return LM.ced(T.v_pool_e(spark, d), pos, neg, "text", "line_id", order).withColumn("ced", r6("ced"))


@register("ced", _CED_SQL + "SELECT line_id, round(ced, 6) AS ced, n_words FROM ced", ["v_pos", "v_neg", "v_pool_e"])
def q_ced(spark, d):
    return _ced(spark, d, 2)


@register("ced_3", "WITH " + _ced_sql("v_pos", "v_neg", "v_pool_e", 3) + "SELECT line_id, round(ced, 6) AS ced, n_words FROM ced",
          ["v_pos", "v_neg", "v_pool_e"])
def q_ced_3(spark, d):
    return _ced(spark, d, 3)


@register("ced_to_tag_of_ced", _CED_SQL + """,
sc AS (SELECT line_id, round(ced, 6) AS ced FROM ced), m AS (SELECT avg(abs(ced)) AS m FROM sc),
k AS (SELECT least(count_if(ced < -m), count_if(ced > m)) AS k, count(ced) AS n FROM sc, m),
r AS (SELECT ced, row_number() OVER (ORDER BY ced) AS rn FROM sc WHERE ced IS NOT NULL),
th AS (SELECT (SELECT ced FROM r, k WHERE rn = k) AS lo, (SELECT ced FROM r, k WHERE rn = n - k + 1) AS hi)
SELECT line_id, ced, CASE WHEN ced <= lo THEN '<2formal>' WHEN ced >= hi THEN '<2informal>' ELSE '<2unk>' END AS src_tag,
  CASE WHEN ced <= lo THEN '<2informal>' WHEN ced >= hi THEN '<2formal>' ELSE '<2unk>' END AS tgt_tag FROM sc, th""",
          ["v_pos", "v_neg", "v_pool_e"])
def q_ced_to_tag_of_ced(spark, d):
    """C1 -> C2 -> C3 over a pool with empty lines, whose score is null."""
    return C.ced_to_tag(_ced(spark, d, 2).select("line_id", "ced"), pos="formal", neg="informal").select("line_id", "ced", "src_tag", "tgt_tag")


# ---------------------------------------------------------------- vocabulary, truecasing

from ..operators import vocab as V  # noqa: E402


def _tok_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT unnest({toks(c)}) AS token FROM {src}" for c in cols)


@register("build_vocab", f"""SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) AS INTEGER) AS rank FROM (
  SELECT token, count(*) AS count FROM ({_tok_sql('v_bitext', ['src', 'tgt'])}) GROUP BY token
  ORDER BY count DESC, token LIMIT 500)""", ["v_bitext"])
def q_build_vocab(spark, d):
    return V.build_vocab(T.v_bitext(spark, d), ["src", "tgt"], 500).withColumn("rank", F.col("rank").cast("int"))


@register("oov_count", f"""WITH voc AS (SELECT token FROM ({_tok_sql('v_pos', ['text'])}) GROUP BY token ORDER BY count(*) DESC, token LIMIT 2000),
occ AS (SELECT line_id, unnest({toks('text')}) AS w FROM v_pool)
SELECT p.line_id, CAST(count(o.w) AS BIGINT) AS n_tokens, CAST(count(o.w) - count(v.token) AS BIGINT) AS n_oov
FROM v_pool p LEFT JOIN occ o ON o.line_id = p.line_id LEFT JOIN voc v ON v.token = o.w GROUP BY p.line_id""",
          ["v_pos", "v_pool"])
def q_oov_count(spark, d):
    voc = V.build_vocab(T.v_pos(spark, d), ["text"], 2000)
    return V.oov_count(T.v_pool(spark, d), voc, "text", "line_id")


def _tc_train_sql(src: str) -> str:
    return f"""forms AS (SELECT form, count(*) AS n FROM (
    SELECT unnest(t) AS form, unnest(range(len(t))) AS i FROM (SELECT {toks('text')} AS t FROM {src})) WHERE i > 0 GROUP BY form),
tc AS (SELECT lower(form) AS lower, arg_min(form, (-n, form)) AS best, sum(n) AS count FROM forms GROUP BY lower(form))"""


def _tc_apply_sql(src: str, out: str) -> str:
    """`out(line_id, text)`: the lines of `src` truecased by `tc`."""
    return f"""{out}o AS (SELECT line_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT line_id, {toks('text')} AS t FROM {src})),
{out}c AS (SELECT o.line_id, string_agg(coalesce(tc.best, o.w), ' ' ORDER BY o.i) AS text FROM {out}o o
          LEFT JOIN tc ON tc.lower = lower(o.w) GROUP BY o.line_id),
{out} AS (SELECT p.line_id, coalesce(c.text, '') AS text FROM {src} p LEFT JOIN {out}c c ON c.line_id = p.line_id)"""


@register("train_truecaser", "WITH " + _tc_train_sql("v_pos") + "\nSELECT lower, best, CAST(count AS BIGINT) AS count FROM tc", ["v_pos"])
def q_train_truecaser(spark, d):
    return V.train_truecaser(T.v_pos(spark, d), "text")


@register("truecase_apply", "WITH " + _tc_train_sql("v_pos") + ",\n" + _tc_apply_sql("v_pool", "cased") + "\nSELECT line_id, text FROM cased",
          ["v_pos", "v_pool"])
def q_truecase_apply(spark, d):
    tc = V.train_truecaser(T.v_pos(spark, d), "text")
    return V.truecase_apply(T.v_pool(spark, d).select("line_id", "text"), tc, "text", "line_id")


# ---------------------------------------------------------------- abbreviations

from ..operators import abbreviations as AB  # noqa: E402

_ABBR_SQL = f"""o AS (SELECT lang, unnest(t[1:len(t) - 1]) AS w FROM (SELECT lang, {toks('text')} AS t FROM v_lines)),
w AS (SELECT lang, lower(regexp_replace(w, '\\.$', '')) AS word, w LIKE '%.' AND w NOT LIKE '%..' AS p FROM o),
c AS (SELECT lang, word, count_if(p) AS n_period, count_if(NOT p) AS n_plain FROM w WHERE regexp_matches(word, '^\\p{{L}}[\\p{{L}}.''\\-]*$') GROUP BY ALL),
z AS (SELECT lang, sum(n_period) / sum(n_period + n_plain) AS p0 FROM c GROUP BY lang),
l AS (SELECT c.*, length(replace(word, '.', ''))::DOUBLE AS letters, length(word)::DOUBLE AS size,
  2 * (n_period * ln(0.99) + CASE WHEN n_plain = 0 THEN 0 ELSE n_plain * ln(1 - 0.99) END
       - n_period * ln(p0) - CASE WHEN n_plain = 0 THEN 0 ELSE n_plain * ln(1 - p0) END) AS ratio FROM c JOIN z USING (lang) WHERE n_period >= 2),
ab AS (SELECT lang, word, n_period, n_plain, ratio * exp(-letters) * (size - letters + 1) * pow(letters, -n_plain) AS score FROM l),
abbr AS (SELECT * FROM ab WHERE score >= 0.3)
"""


@register("learn_abbreviations", "WITH " + _ABBR_SQL + "SELECT lang, word, n_period, n_plain, round(score, 6) AS score FROM abbr", ["v_lines"])
def q_learn_abbreviations(spark, d):
    return AB.learn_abbreviations(T.v_lines(spark, d)).withColumn("score", r6("score"))


def _tokenized_sql(lang: str) -> str:
    return "WITH " + _ABBR_SQL + f""", tk AS (SELECT line_id, {R.duckdb_chain('text', R.tokenize_rules(lang))} AS text FROM v_lines WHERE lang = '{lang}'),
tw AS (SELECT line_id, unnest({toks('text')}) AS w, unnest(range(len({toks('text')}))) AS i FROM tk),
ts AS (SELECT *, lower(regexp_replace(w, '\\.$', '')) AS stem FROM tw),
tx AS (SELECT line_id, i, CASE WHEN w LIKE '%.' AND w NOT LIKE '%..' AND regexp_matches(stem, '^\\p{{L}}[\\p{{L}}.''\\-]*$') AND length(stem) > 1
  AND stem NOT IN (SELECT word FROM abbr WHERE lang = '{lang}') THEN regexp_replace(w, '\\.$', '') || ' .' ELSE w END AS x FROM ts),
ty AS (SELECT line_id, string_agg(x, ' ' ORDER BY i) AS text FROM tx GROUP BY line_id)
SELECT tk.line_id, coalesce(ty.text, '') AS text FROM tk LEFT JOIN ty USING (line_id)"""


def _tokenized(lang: str):
    def q(spark, d):
        ln = T.v_lines(spark, d)
        return AB.tokenize_corpus(ln.filter(F.col("lang") == lang).select("line_id", "text"), AB.learn_abbreviations(ln), "text", lang)

    return q


for _lang in ("en", "de"):
    register(f"tokenize_corpus_{_lang}", _tokenized_sql(_lang), ["v_lines"])(_tokenized(_lang))


# ---------------------------------------------------------------- BLEU (A6, A7, A17), C9

from ..operators import bleu as B  # noqa: E402


def _ng_sql(src: str, keys: str, tcol: str) -> str:
    parts = []
    for n in range(1, 5):
        parts.append(f"""SELECT {keys}, {n} AS n, unnest(list_transform(range(1, len({tcol}) - {n - 1} + 1),
            lambda i: array_to_string({tcol}[i:i + {n - 1}], ' '))) AS g FROM {src}""")
    return " UNION ALL ".join(parts)


def _bleu_sql(lower: bool, hyps: str = "v_hyps", refs: str = "v_refs", grid: str = "", head: str = "WITH ") -> str:
    lo = (lambda x: f"lower({x})") if lower else (lambda x: x)
    body = f"""h AS (SELECT system{grid}, seg_id, {toks(lo('hyp'))} AS t FROM {hyps}
      JOIN (SELECT DISTINCT system{grid}, seg_id FROM {refs}) USING (system{grid}, seg_id)),
r AS (SELECT system{grid}, seg_id, ref_no, {toks(lo('ref'))} AS t FROM {refs}),
hg AS (SELECT system{grid}, seg_id, n, g, count(*) AS ch FROM ({_ng_sql('h', 'system' + grid + ', seg_id', 't')}) GROUP BY ALL),
rg0 AS (SELECT system{grid}, seg_id, ref_no, n, g, count(*) AS cr FROM ({_ng_sql('r', 'system' + grid + ', seg_id, ref_no', 't')}) GROUP BY ALL),
rg AS (SELECT system{grid}, seg_id, n, g, max(cr) AS cr FROM rg0 GROUP BY ALL),
cl AS (SELECT hg.system{grid.replace(', ', ', hg.')}, hg.n, hg.ch, least(hg.ch, coalesce(rg.cr, 0)) AS m FROM hg LEFT JOIN rg
       ON rg.system = hg.system AND rg.seg_id = hg.seg_id AND rg.n = hg.n AND rg.g = hg.g{_gj('rg', 'hg', grid)}),
pr AS (SELECT system{grid},
  sum(CASE WHEN n = 1 THEN m ELSE 0 END) AS num1, sum(CASE WHEN n = 1 THEN ch ELSE 0 END) AS den1,
  sum(CASE WHEN n = 2 THEN m ELSE 0 END) AS num2, sum(CASE WHEN n = 2 THEN ch ELSE 0 END) AS den2,
  sum(CASE WHEN n = 3 THEN m ELSE 0 END) AS num3, sum(CASE WHEN n = 3 THEN ch ELSE 0 END) AS den3,
  sum(CASE WHEN n = 4 THEN m ELSE 0 END) AS num4, sum(CASE WHEN n = 4 THEN ch ELSE 0 END) AS den4 FROM cl GROUP BY ALL),
bl AS (SELECT h.system{grid.replace(', ', ', h.')}, h.seg_id, len(h.t) AS hl, min({{'d': abs(len(r.t) - len(h.t)), 'rl': len(r.t)}}).rl AS rb
       FROM h JOIN r ON r.system = h.system AND r.seg_id = h.seg_id{_gj('r', 'h', grid)} GROUP BY ALL),
ln AS (SELECT system{grid}, sum(hl) AS c, sum(rb) AS r FROM bl GROUP BY ALL),
j AS (SELECT ln.system{grid.replace(', ', ', ln.')}, ln.c, ln.r, pr.num1, pr.den1, pr.num2, pr.den2, pr.num3, pr.den3, pr.num4, pr.den4,
  CASE WHEN ln.c >= ln.r THEN 1.0 WHEN ln.c > 0 THEN exp(1 - ln.r / ln.c) ELSE 0.0 END AS bp
  FROM ln LEFT JOIN pr ON pr.system = ln.system{_gj('pr', 'ln', grid)}),
bleu AS (SELECT system{grid}, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r,
  CAST(num1 AS BIGINT) AS num1, CAST(den1 AS BIGINT) AS den1, CAST(num2 AS BIGINT) AS num2, CAST(den2 AS BIGINT) AS den2,
  CAST(num3 AS BIGINT) AS num3, CAST(den3 AS BIGINT) AS den3, CAST(num4 AS BIGINT) AS num4, CAST(den4 AS BIGINT) AS den4,
  round(bp, 6) AS bp,
  round(CASE WHEN least(num1, num2, num3, num4) = 0 THEN 0.0
       ELSE 100 * bp * exp((ln(num1 / den1) + ln(num2 / den2) + ln(num3 / den3) + ln(num4 / den4)) / 4) END, 6) AS bleu
FROM j)
"""
    return head + body if head == "WITH " and not hyps.startswith("(") else head + body


def _gj(a: str, b: str, grid: str) -> str:
    return "".join(f" AND {a}.{g} = {b}.{g}" for g in grid.split(", ") if g)


def _bleu_q(spark, d, lower):
    h, r = T.v_hyps_refs(spark, d)
    b = B.corpus_bleu(h, r, ["system"], lower=lower)
    return b.select("system", "c", "r", *[f"{p}{n}" for n in range(1, 5) for p in ("num", "den")],
                    r6("bp").alias("bp"), r6("bleu_raw").alias("bleu"))


@register("corpus_bleu", _bleu_sql(False) + "SELECT * FROM bleu", ["v_hyps", "v_refs"])
def q_corpus_bleu(spark, d):
    return _bleu_q(spark, d, False)


@register("corpus_bleu_lc", _bleu_sql(True) + "SELECT * FROM bleu", ["v_hyps", "v_refs"])
def q_corpus_bleu_lc(spark, d):
    return _bleu_q(spark, d, True)


# a hypothesis for every line: those near the end of a document have fewer references, the last has none;
# references numbered from 1 with a gap, and a fifth one made of two lines
_REFS5 = """h5 AS (SELECT source AS system, line_id AS seg_id, text AS hyp, doc_id, line_no FROM v_text),
l5 AS (SELECT h.system, h.seg_id, CAST(b.line_no - h.line_no AS INTEGER) AS ref_no, b.text AS ref, h.hyp
  FROM h5 h JOIN v_text b ON b.doc_id = h.doc_id AND b.line_no BETWEEN h.line_no + 1 AND h.line_no + 4),
r5 AS (SELECT system, seg_id, ref_no, ref FROM l5 UNION ALL SELECT system, seg_id, 9, ref || ' ' || hyp FROM l5 WHERE ref_no = 1),
un AS (SELECT system, count(*) AS n_unscored FROM h5 WHERE seg_id NOT IN (SELECT seg_id FROM r5) GROUP BY system),
"""


@register("corpus_bleu_refs5", "WITH " + _REFS5 + _bleu_sql(False, "h5", "r5", head="") + """
SELECT bleu.*, coalesce(n_unscored, 0) AS n_unscored FROM bleu LEFT JOIN un ON un.system = bleu.system""", ["v_text"])
def q_corpus_bleu_refs5(spark, d):
    ln = T.v_text(spark, d).select("doc_id", "line_no", F.col("source").alias("system"), F.col("line_id").alias("seg_id"), F.col("text").alias("hyp"))
    near = ln.withColumn("ref_no", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("line_no", F.col("line_no") + F.col("ref_no"))
    refs = near.join(ln.select("doc_id", "line_no", F.col("hyp").alias("ref")), ["doc_id", "line_no"])
    fifth = refs.filter("ref_no = 1").select("system", "seg_id", F.lit(9).alias("ref_no"), F.concat_ws(" ", "ref", "hyp").alias("ref"))
    b = B.corpus_bleu(ln, refs.select("system", "seg_id", "ref_no", "ref").unionByName(fifth), ["system"])
    return b.select("system", "c", "r", *[f"{p}{n}" for n in range(1, 5) for p in ("num", "den")],
                    r6("bp").alias("bp"), r6("bleu_raw").alias("bleu"), "n_unscored")


# grid: every system x {4 references, first reference only}; one job (A17), then run statistics
_GRID_CTE = """gh AS (SELECT system, t.test_id, seg_id, hyp FROM v_hyps, (VALUES ('ref4'), ('ref1')) t(test_id)),
gr AS (SELECT system, 'ref4' AS test_id, seg_id, ref_no, ref FROM v_refs
       UNION ALL SELECT system, 'ref1' AS test_id, seg_id, ref_no, ref FROM v_refs WHERE ref_no = 0),
"""


_GRID_TESTS = {"ref4": (None, False), "ref1": ([0], False)}  # both test variants


def _grid(spark, d):
    h, r = T.v_hyps_refs(spark, d)
    return B.evaluation_grid(h, r, ["system"], _GRID_TESTS)


@register("evaluation_grid", "WITH " + _GRID_CTE + _bleu_sql(False, "gh", "gr", ", test_id", head="") + "SELECT * FROM bleu",
          ["v_hyps", "v_refs"])
def q_evaluation_grid(spark, d):
    return _grid(spark, d).select("system", "test_id", "c", "r", *[f"{p}{n}" for n in range(1, 5) for p in ("num", "den")],
                                  r6("bp").alias("bp"), r6("bleu_raw").alias("bleu"))


@register("run_statistics", "WITH " + _GRID_CTE + _bleu_sql(False, "gh", "gr", ", test_id", head="") + """
SELECT test_id, round(avg(round(bleu, 2)), 6) AS mean, round(stddev_samp(round(bleu, 2)), 6) AS std,
  round(min(round(bleu, 2)), 6) AS min, round(max(round(bleu, 2)), 6) AS max, count(*) AS runs FROM bleu GROUP BY test_id""",
          ["v_hyps", "v_refs"])
def q_run_statistics(spark, d):
    st = B.run_statistics(_grid(spark, d), ["test_id"], "bleu")
    return st.select("test_id", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")], "runs")


# ---------------------------------------------------------------- subwords (A11, J9), guarded join (J2), composites

from ..operators import subword as SW  # noqa: E402
from . import pipelines as PL  # noqa: E402

N_MERGES = 32_000  # the reference's merge count (SURVEY A11)


@register("learn_subwords")
def q_learn_subwords(spark, d):
    return SW.learn_subwords(T.v_bitext(spark, d), ["src", "tgt"], N_MERGES)


@register("subword_apply")
def q_subword_apply(spark, d):
    merges = SW.learn_subwords(T.v_pos(spark, d), ["text"], N_MERGES)
    return SW.subword_apply(T.v_pool(spark, d).select("line_id", "text"), merges, "text", "line_id")


_FIXED_MERGES = [("t", "h"), ("th", "e</w>"), ("i", "n"), ("e", "r"), ("o", "n"), ("er", "e"), ("t", "i"), ("ti", "on"), ("i", "on"), ("th", "in"), ("in", "g</w>"),
                 ("d", "e</w>"), ("e", "n"), ("en", "t"), ("a", "n"), ("an", "d</w>"), ("q", "u"), ("qu", "e</w>"), ("s", "s"), ("u", "e"), ("l", "l"), ("re", "s")]


def _fixed_sql(word: str) -> str:
    """A word's symbols, each between two marks, with the merges applied one after the other."""
    x = f"list_concat(list_transform(range(1, length({word})), lambda i: {word}[i]), [{word}[length({word})] || '</w>'])"
    x = f"chr(1) || array_to_string({x}, chr(2) || chr(1)) || chr(2)"
    for a, b in _FIXED_MERGES:
        x = f"replace({x}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a + b}' || chr(2))"
    return f"replace(replace(replace(left({x}, length({x}) - 5), chr(2) || chr(1), '@@ '), chr(1), ''), chr(2), '')"


@register("subword_apply_fixed", f"""WITH o AS (SELECT line_id, unnest({toks('text')}) AS w, unnest(range(len({toks('text')}))) AS i FROM v_pool),
s AS (SELECT w, {_fixed_sql('w')} AS seg FROM (SELECT DISTINCT w FROM o)),
j AS (SELECT line_id, string_agg(seg, ' ' ORDER BY i) AS text FROM o JOIN s USING (w) GROUP BY line_id)
SELECT p.line_id, coalesce(j.text, '') AS text FROM v_pool p LEFT JOIN j USING (line_id)""", ["v_pool"])
def q_subword_apply_fixed(spark, d):
    merges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_FIXED_MERGES, 1)], "rank int, left string, right string")
    return SW.subword_apply(T.v_pool(spark, d).select("line_id", "text"), merges, "text", "line_id")


@register("guarded_join", _CED_SQL + """,
gj AS (SELECT xp.line_id, xp.n_words, xp.xent AS xent_pos, yp.xent AS xent_neg FROM xp JOIN yp
       ON yp.line_id = xp.line_id AND yp.n_words = xp.n_words)
SELECT line_id, n_words, round(xent_pos, 6) AS xent_pos, round(xent_neg, 6) AS xent_neg FROM gj""", ["v_pos", "v_neg", "v_pool_e"])
def q_guarded_join(spark, d):
    pool = T.v_pool_e(spark, d)
    xp = LM.cross_entropy(pool, LM.train_ngram_lm(T.v_pos(spark, d), "text", 2), "text", "line_id", 2)
    xn = LM.cross_entropy(pool, LM.train_ngram_lm(T.v_neg(spark, d), "text", 2), "text", "line_id", 2)
    return J.guarded_join(xp, xn, "line_id", "n_words").select(
        "line_id", "n_words", r6("xent_pos").alias("xent_pos"), r6("xent_neg").alias("xent_neg"))


def _ced_sel(spark, d, low: bool):
    lo, hi = PL.ced_selection(T.v_pool_e(spark, d), T.v_pos(spark, d), T.v_neg(spark, d), 50, 3, "text", "line_id")
    return (lo if low else hi).select("line_id", r6("ced").alias("ced"))


# C4: all three corpora truecased by a model of both in-domain corpora, order 3
_CED_TC_SQL = "WITH " + _tc_train_sql("(SELECT text FROM v_pos UNION ALL SELECT text FROM v_neg)") + ",\n" + ",\n".join(
    _tc_apply_sql(v, v + "_tc") for v in ("v_pos", "v_neg", "v_pool_e")) + ",\n" + _ced_sql("v_pos_tc", "v_neg_tc", "v_pool_e_tc", 3)


@register("ced_select_low", _CED_TC_SQL + "SELECT line_id, round(ced, 6) AS ced FROM ced WHERE ced IS NOT NULL ORDER BY ced.ced, line_id LIMIT 50",
          ["v_pos", "v_neg", "v_pool_e"])
def q_ced_select_low(spark, d):
    return _ced_sel(spark, d, True)


@register("ced_select_high", _CED_TC_SQL + "SELECT line_id, round(ced, 6) AS ced FROM ced WHERE ced IS NOT NULL ORDER BY ced.ced DESC, line_id DESC LIMIT 50",
          ["v_pos", "v_neg", "v_pool_e"])
def q_ced_select_high(spark, d):
    return _ced_sel(spark, d, False)


def _clean_sql(x: str, lang: str = "en") -> str:
    s = f"regexp_replace({x}, '\\p{{C}}', ' ', 'g')"
    s = R.duckdb_chain(s, R.PUNCT_RULES_COMMON + (R.PUNCT_RULES_EN if lang == "en" else R.PUNCT_RULES_OTHER))
    return R.duckdb_chain(s, R.tokenize_rules(lang))


def _prepare_sql(lang: str, tgt_lang: str) -> str:
    return f"""WITH c AS (SELECT DISTINCT {_clean_sql('src', lang)} AS src, {_clean_sql('tgt', tgt_lang)} AS tgt FROM v_bitext),
k AS (SELECT src, tgt, md5(src || chr(9) || tgt) AS k FROM c),
s AS (SELECT src, tgt, row_number() OVER (ORDER BY md5('0|' || k), k) AS shuffled_no FROM k),
w AS (SELECT *, {_wordset_sql('src')} AS a, {_wordset_sql('tgt')} AS b, {nt('src')} AS n1, {nt('tgt')} AS n2 FROM s)
SELECT src, tgt, shuffled_no FROM w
WHERE (least(len(a), len(b)) = 0 OR len(list_intersect(a, b)) / least(len(a), len(b)) < 0.5)
  AND n1 > 0 AND n2 > 0 AND greatest(n1, n2) <= 2.0 * least(n1, n2)"""


@register("prepare_bitext", _prepare_sql("en", "en"), ["v_bitext"])
def q_prepare_bitext(spark, d):
    return PL.prepare_bitext(T.v_bitext(spark, d)).select("src", "tgt", "shuffled_no")


@register("prepare_bitext_fr_de", _prepare_sql("fr", "de"), ["v_bitext"])
def q_prepare_bitext_fr_de(spark, d):
    return PL.prepare_bitext(T.v_bitext(spark, d), lang="fr", tgt_lang="de").select("src", "tgt", "shuffled_no")


@register("first_clean", f"""WITH k AS (SELECT src, tgt, md5(src || chr(9) || tgt) AS k FROM (SELECT DISTINCT src, tgt FROM v_bitext)),
s AS (SELECT src, tgt, row_number() OVER (ORDER BY md5('0|' || k), k) AS shuffled_no FROM k)
SELECT * FROM s WHERE NOT (regexp_matches(src, 'q') OR regexp_matches(tgt, 'q')) AND {nt('src')} > 0 AND {nt('tgt')} > 0""", ["v_bitext"])
def q_first_clean(spark, d):
    return PL.first_clean(T.v_bitext(spark, d), "q").select("src", "tgt", "shuffled_no")


_EVAL_HYPS = f"""ph AS (SELECT system, seg_id, {R.duckdb_chain(_post_sql('hyp', True), R.TOKENIZE_RULES)} AS hyp FROM v_hyps),
pr_ AS (SELECT system, seg_id, ref_no, {R.duckdb_chain('ref', R.TOKENIZE_RULES)} AS ref FROM v_refs),
"""


@register("evaluate_outputs", "WITH " + _EVAL_HYPS + _bleu_sql(True, "ph", "pr_", "", head="") + """
SELECT count(*) AS runs, round(avg(round(bleu, 2)), 6) AS mean, round(stddev_samp(round(bleu, 2)), 6) AS std,
  round(min(round(bleu, 2)), 6) AS min, round(max(round(bleu, 2)), 6) AS max FROM bleu""", ["v_hyps", "v_refs"])
def q_evaluate_outputs(spark, d):
    h, r = T.v_hyps_refs(spark, d)
    _, stats = PL.evaluate_outputs(h, r, ["system"], "formal", False, stat_keys=[])
    return stats.select("runs", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@register("prepare_training")
def q_prepare_training(spark, d):
    b = T.v_bitext(spark, d)
    return PL.prepare_training(b, T.v_pos(spark, d), N_MERGES, "formal", "informal", "tag", a="src", b="tgt", key="pair_id")


@register("write_ced", "SELECT line_id, ced, position, row FROM (SELECT line_id, ced, CAST(row_number() OVER (ORDER BY ced, line_id) AS BIGINT) AS position, "
          "printf('%.6f', ced) || chr(9) || regexp_replace(text, '[\\r\\t]', ' ', 'g') || chr(9) || line_id AS row FROM v_score)", ["v_score"])
def q_write_ced(spark, d):
    """Written in score order, and read back: the position of a line is its rank."""
    root = shared_folder(spark, "ced")
    PL.write_ced(T.v_score(spark, d).withColumn("src", F.col("line_id").cast("string")), root, tgt="text", key="line_id")
    part = _part(IO.read_lines(spark, root)).select("part", "line_no", F.col("text").alias("row"))
    fields = F.split("row", "\t")
    out = S.with_position(part, "position", ["part", "line_no"])
    return out.select(fields[2].cast("bigint").alias("line_id"), fields[0].cast("double").alias("ced"), "position", "row")


@register("lepod_files", "WITH " + _LEPOD_SQL + """
SELECT printf('%.9f', led) || chr(9) || s.pair_id AS led, printf('%.9f', pod) || chr(9) || s.pair_id AS pod, s.pair_id AS detail FROM scored s""", ["v_pairs"])
def q_lepod_files(spark, d):
    """The three files of one run, line by line beside each other."""
    root = shared_folder(spark, "lepod-files")
    PL.lepod_files(T.v_pairs(spark, d), f"{root}/score", digits=9)
    first = {x: F.array_join(F.slice(F.split("text", "\t"), 1, 2), "\t") for x in ("led", "pod")}
    first["txt"] = F.split("text", "\t")[0].cast("bigint")  # cut before the join, which moves no whole lines
    files = [_part(IO.read_lines(spark, f"{root}/score.{x}")).select(F.concat_ws("|", "part", "line_no").alias("k"), c.alias(x)) for x, c in first.items()]
    both = J.zip_lines(J.zip_lines(files[0], files[1], "strict", key="k"), files[2], "strict", key="k")
    return both.select("led", "pod", F.col("txt").alias("detail"))
