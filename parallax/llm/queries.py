"""The registered queries of the operators and of the pipeline, with DuckDB SQL where it can say them.

Each query applies its operator, with production parameters, to the whole table and derives the
columns of the result from the operator's own output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import fold, score_quality, train_quality
from .conversation_repair import damaged, repaired_digest
from .decontaminate import decontaminate
from .html_crf import extract_text
from .jaccard_join import jaccard_join
from .license_scan import license_scan
from .maxent_lm import lm_scores
from .mix_sources import mix_sources
from .prefix_tokens import token_counts
from .quality_rules import quality_rules
from .ranked_search import ranked_search
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 5], ' ') AS x
       FROM d, unnest(range(greatest(len(w) - 4, 1))) AS t(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op1_jaccard_join", OP1_SQL)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM benchmark),
items AS (SELECT item_id, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS x, least(len(w), 10) AS m
          FROM b, unnest(range(greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
win AS (SELECT doc_id, s, m, array_to_string(w[s + 1 : s + m], ' ') AS x
        FROM d, (SELECT DISTINCT m FROM items), unnest(range(len(w) - m + 1)) AS t(s) WHERE len(w) >= m),
found AS (SELECT DISTINCT doc_id, s, win.m, item_id FROM win JOIN items USING (x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(s, s + m)) AS t(p) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
         FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED}))::BIGINT AS size,
           ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
               [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
filled AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / sum(weight) OVER after AS level
           FROM per WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           after AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goal AS (SELECT source, source_size, least(65536, greatest(1, docs // 64)) AS bins,
                least(2.0 * source_size, weight * (SELECT coalesce(max(level), 0) FROM filled))::DOUBLE AS target FROM per),
part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goal),
r AS (SELECT d.*, source_size, target, whole, round(target - whole * source_size)::BIGINT AS need, floor(u * bins)::BIGINT AS bin
      FROM d JOIN part ON d.source IS NOT DISTINCT FROM part.source),
b AS (SELECT source, bin, need, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin)::BIGINT AS upto, sum(size)::BIGINT AS words FROM r GROUP BY source, bin, need),
edge AS (SELECT r.source, r.doc_id, r.size, need - upto + words AS rest,
                row_number() OVER (PARTITION BY r.source ORDER BY r.size DESC, r.u, r.doc_id) AS k
         FROM (SELECT source, bin, upto, words, need FROM b WHERE upto > need AND need - upto + words > 0) e
         JOIN (SELECT source, bin, doc_id, u, size FROM r) r ON r.source IS NOT DISTINCT FROM e.source AND r.bin = e.bin WHERE size > 0),
pick(source, k, rest, doc_id, taken) AS (
    SELECT source, 0::BIGINT, any_value(rest), NULL::BIGINT, false FROM edge GROUP BY source
    UNION ALL
    SELECT e.source, e.k, CASE WHEN e.size <= p.rest THEN p.rest - e.size ELSE p.rest END, e.doc_id, e.size <= p.rest
    FROM pick p JOIN edge e ON e.source IS NOT DISTINCT FROM p.source AND e.k = p.k + 1)
SELECT r.doc_id, size, source_size, target,
       size * (whole + (upto <= b.need OR coalesce(pick.taken, false))::INT)::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.bin = b.bin
LEFT JOIN pick ON pick.doc_id = r.doc_id AND k > 0
"""


@query("op3_mix_sources", OP3_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_maxent_lm")
def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query("op5_byte_cnn")
def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; it is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_prefix_tokens")
def op7_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS x
        FROM d, unnest(range(len(w) - 19)) AS t(s) WHERE len(w) >= 20),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(s, s + 20)) AS t(p)),
word AS (SELECT doc_id, p, w[p + 1] AS x FROM d, unnest(range(len(w))) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring_dedup", OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"), k=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_html_crf")
def op9_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: crc32 by its eight shifts a byte; a forward program with the least (cost, audit) for each of the four states.
OP13_SQL = r"""
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
                 lambda i: list_concat([ascii(k[i])::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
               lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS kind FROM src),
bad AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM crc, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM bad),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM placed),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS px FROM seen),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS extra FROM f),
ends AS (SELECT conv_id, max(pos) AS n FROM r GROUP BY conv_id),
-- a state's value is [cost, audit, lines] as a struct; null if it can't be reached
dp(conv_id, pos, o, s, u, a) AS (
    SELECT conv_id, 0::BIGINT, {'c': 0, 'e': '', 'l': []::VARCHAR[]}, NULL::STRUCT(c INT, e VARCHAR, l VARCHAR[]),
           {'c': 2, 'e': 'I', 'l': ['user:']}, {'c': 4, 'e': 'II', 'l': ['user:', 'assistant:']} FROM ends
    UNION ALL
    SELECT conv_id, pos, o1, s1, u2, CASE WHEN u2 IS NULL THEN a1 ELSE least(coalesce(a1, {'c': u2.c + 2, 'e': u2.e || 'I', 'l': list_append(u2.l, 'assistant:')}),
                                                                           {'c': u2.c + 2, 'e': u2.e || 'I', 'l': list_append(u2.l, 'assistant:')}) END
    FROM (SELECT *, list_min(list_filter([u1, CASE WHEN o1 IS NOT NULL THEN {'c': o1.c + 2, 'e': o1.e || 'I', 'l': list_append(o1.l, 'user:')} END,
                                          CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'e': s1.e || 'I', 'l': list_append(s1.l, 'user:')} END,
                                          CASE WHEN a1 IS NOT NULL THEN {'c': a1.c + 2, 'e': a1.e || 'I', 'l': list_append(a1.l, 'user:')} END], lambda z: z IS NOT NULL)) AS u2
          FROM (SELECT dp.conv_id, r.pos, {'c': o.c + 3, 'e': o.e || 'D', 'l': o.l} AS o1,
                       list_min(list_filter([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'e': s.e || 'D', 'l': s.l} END,
                                CASE WHEN NOT gone AND x = 's' THEN {'c': o.c + extra, 'e': o.e || 'K', 'l': list_append(o.l, role || ':' || text)} END], lambda z: z IS NOT NULL)) AS s1,
                       list_min(list_filter([{'c': u.c + 3, 'e': u.e || 'D', 'l': u.l},
                                CASE WHEN NOT gone AND x = 'u' THEN {'c': o.c + extra, 'e': o.e || 'K', 'l': list_append(o.l, role || ':' || text)} END,
                                CASE WHEN NOT gone AND x = 'u' AND s IS NOT NULL THEN {'c': s.c + extra, 'e': s.e || 'K', 'l': list_append(s.l, role || ':' || text)} END,
                                CASE WHEN NOT gone AND x = 'u' THEN {'c': a.c + extra, 'e': a.e || 'K', 'l': list_append(a.l, role || ':' || text)} END,
                                CASE WHEN NOT gone THEN {'c': o.c + 2 + extra, 'e': o.e || 'R', 'l': list_append(o.l, 'user:' || text)} END,
                                CASE WHEN NOT gone AND s IS NOT NULL THEN {'c': s.c + 2 + extra, 'e': s.e || 'R', 'l': list_append(s.l, 'user:' || text)} END,
                                CASE WHEN NOT gone THEN {'c': a.c + 2 + extra, 'e': a.e || 'R', 'l': list_append(a.l, 'user:' || text)} END], lambda z: z IS NOT NULL)) AS u1,
                       list_min(list_filter([{'c': a.c + 3, 'e': a.e || 'D', 'l': a.l},
                                CASE WHEN NOT gone AND x = 'a' THEN {'c': u.c + extra, 'e': u.e || 'K', 'l': list_append(u.l, role || ':' || text)} END,
                                CASE WHEN NOT gone THEN {'c': u.c + 2 + extra, 'e': u.e || 'R', 'l': list_append(u.l, 'assistant:' || text)} END], lambda z: z IS NOT NULL)) AS a1
                FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1) step1) step2),
best AS (SELECT dp.conv_id, least(o, a) AS b FROM dp JOIN ends ON ends.conv_id IS NOT DISTINCT FROM dp.conv_id AND pos = n),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.e, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired_digest(rows, damaged(rows))


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, {_TERMS})) AS term FROM documents),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, {_TERMS})) AS term FROM benchmark) GROUP BY ALL),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


#: On the hex digits of the bytes, two for each.
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, s, hash(substr(x, (2 * s + 1)::INT, 800)) AS h FROM d, unnest(range(n - 399)) AS t(s) WHERE n >= 400),
rep AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
run AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER w + 400 THEN 0 ELSE 1 END AS new FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
span AS (SELECT doc_id, min(s) AS b, max(s) + 400 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM run) GROUP BY doc_id, g),
per AS (SELECT doc_id, count(*) AS spans, sum(e - b)::BIGINT AS gone, list(e ORDER BY b) AS es, list(b ORDER BY b) AS bs FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, spans + 1),
           lambda i: substr(x, (CASE WHEN i = 0 THEN 1 ELSE 2 * es[i] + 1 END)::INT,
                            (2 * (CASE WHEN i = spans THEN n ELSE bs[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE es[i] END))::INT)), '') END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""


@query("op12_suffix_dedup", OP12_SQL)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
