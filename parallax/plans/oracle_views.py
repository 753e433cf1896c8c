"""DuckDB text of the derived views (FIXTURES.md §3), used by the oracle SQL.

Each entry is one CTE; `with_views(names, body)` prepends the ones a query needs (with
their dependencies) so every oracle statement runs on the raw driver tables only.
"""
from __future__ import annotations


def nt(x: str) -> str:
    """Token count in DuckDB: split on white space, drop empty tokens."""
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')) AS INTEGER)"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


VIEWS: dict[str, tuple[list[str], str]] = {
    "v_lines": ([], """v_lines AS (
  SELECT doc_id * 100000 + line_no AS line_id, doc_id, line_no, lang, source, text FROM (
    SELECT doc_id, lang, source,
           unnest(string_split(text, chr(10))) AS text,
           CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_no
    FROM documents))"""),
    "v_text": (["v_lines"], f"""v_text AS (
  SELECT line_id, doc_id, line_no, source, text, {nt('text')} AS nt FROM v_lines)"""),
    "v_pos": (["v_lines"], """v_pos AS (
  SELECT line_id, doc_id, line_no, lang, source, text FROM v_lines
  WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""),
    "v_neg": (["v_lines"], """v_neg AS (
  SELECT line_id, doc_id, line_no, lang, source, text FROM v_lines
  WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"""),
    "v_pool": (["v_lines"], """v_pool AS (
  SELECT line_id, doc_id, line_no, lang, source, text FROM v_lines
  WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels))"""),
    "v_pool_e": (["v_pool"], """v_pool_e AS (
  SELECT line_id, text FROM v_pool UNION ALL SELECT DISTINCT -doc_id - 1, '' FROM v_pool)"""),
    "v_score": (["v_text"], """v_score AS (
  SELECT line_id, round(length(text) / nt - 6.0, 6) AS ced, text FROM v_text WHERE nt > 0)"""),
    "v_bitext": ([], """v_bitext AS (
  SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""),
    "v_pairs": (["v_text"], """v_pairs AS (
  SELECT a.line_id AS pair_id, a.text AS text1, b.text AS text2
  FROM v_text a JOIN v_text b ON b.doc_id = a.doc_id AND b.line_no = a.line_no + 1
  WHERE a.nt > 0 AND b.nt > 0)"""),
    "v_hyps": (["v_text"], """v_hyps AS (
  SELECT a.source AS system, a.line_id AS seg_id, a.text AS hyp, a.doc_id, a.line_no
  FROM v_text a WHERE EXISTS (SELECT 1 FROM v_text b WHERE b.doc_id = a.doc_id AND b.line_no = a.line_no + 4))"""),
    "v_refs": (["v_hyps", "v_text"], """v_refs AS (
  SELECT h.system, h.seg_id, CAST(b.line_no - h.line_no - 1 AS INTEGER) AS ref_no, b.text AS ref
  FROM v_hyps h JOIN v_text b ON b.doc_id = h.doc_id AND b.line_no BETWEEN h.line_no + 1 AND h.line_no + 4)"""),
}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(VIEWS[n][1] for n in order) + ",\n" + body.lstrip().removeprefix("WITH ").lstrip() \
        if body.lstrip().startswith("WITH ") else "WITH " + ",\n".join(VIEWS[n][1] for n in order) + "\n" + body
