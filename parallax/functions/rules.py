"""Fixed rule tables for punctuation normalisation and (de)tokenisation.

These are house definitions (SURVEY marks P16-P18 as [H]): the original tools are
external and not vendored, so we do not claim bit-compatibility.  Each rule is a
(Java regex, replacement) pair applied in order with `regexp_replace`.  Patterns use
only syntax shared by Java regex and RE2 (no look-around) so that the DuckDB oracle
can run the very same table (`to_duckdb_rules`).
"""
from __future__ import annotations

import re

# --- fixed values: punctuation normalisation, applied in this order -------------
PUNCT_RULES_COMMON = [
    ("\r", ""),
    (r"\(", " ("),
    (r"\)", ") "),
    (" +", " "),
    (r"\) ([.!:?;,])", ")$1"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"(\d) %", "$1%"),
    (" :", ":"),
    (" ;", ";"),
    ("„", '"'),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", " - "),
    (" +", " "),
    ("´", "'"),
    ("(?i)([a-z])‘([a-z])", "$1'$2"),
    ("(?i)([a-z])’([a-z])", "$1'$2"),
    ("‘", "'"),
    ("‚", "'"),
    ("’", "'"),
    ("''", '"'),
    ("´´", '"'),
    ("…", "..."),
    (" « ", ' "'),
    ("« ", '"'),
    ("«", '"'),
    (" » ", '" '),
    (" »", '"'),
    ("»", '"'),
    (" %", "%"),
    (r" \?", "?"),
    (" !", "!"),
    (" +", " "),
]
PUNCT_RULES_EN = [
    (r'"([,.]+)', '$1"'),
    (r"(\d) (\d)", "$1.$2"),
]
PUNCT_RULES_OTHER = [
    (',"', '",'),
    (r"(\d) (\d)", "$1,$2"),
]

# --- fixed values: tokenisation, applied in this order --------------------------
_BEFORE_APOSTROPHE = [
    (r"\s+", " "),
    (r"^ | $", ""),
    # every character that is not a letter, digit, space, period, apostrophe, backtick, comma or hyphen
    (r"([^\p{L}\p{N}\s.'`,\-])", " $1 "),
    # aggressive hyphen splitting between letters/digits (twice: matches do not overlap)
    (r"([\p{L}\p{N}])-([\p{L}\p{N}])", "$1 @-@ $2"),
    (r"([\p{L}\p{N}])-([\p{L}\p{N}])", "$1 @-@ $2"),
    # commas, unless inside a number
    (r"([^\p{N}]),", "$1 , "),
    (r",([^\p{N}])", " , $1"),
    (r"^,", " , "),
    (r",$", " , "),
]
_APOSTROPHE_EN = [  # contractions: split before the apostrophe between letters
    (r"([\p{L}])'([\p{L}])", "$1 '$2"),
    (r"([^\p{L}])'", "$1 ' "),
    (r"^'", " ' "),
]
_APOSTROPHE_FR = [  # elisions: split behind the apostrophe between letters
    (r"([\p{L}])'([\p{L}])", "$1' $2"),
    (r"([^\p{L}])'", "$1 ' "),
    (r"^'", " ' "),
]
_APOSTROPHE_OTHER = [(r"'", " ' ")]  # no contractions: the apostrophe stands alone
_BEHIND_APOSTROPHE = [
    # runs of periods, and a final period
    (r"\.\.+", " ... "),
    (r"([^.])\.\s*$", "$1 ."),
    (r"\s+", " "),
    (r"^ | $", ""),
]


def tokenize_rules(lang: str = "en"):
    """The tokenisation rules of a language."""
    own = {"en": _APOSTROPHE_EN, "fr": _APOSTROPHE_FR, "it": _APOSTROPHE_FR}.get(lang, _APOSTROPHE_OTHER)
    return _BEFORE_APOSTROPHE + own + _BEHIND_APOSTROPHE


TOKENIZE_RULES = tokenize_rules("en")

DETOKENIZE_RULES = [
    (" @-@ ", "-"),
    (r" ([.,!?:;%)\]}])", "$1"),
    (r"([(\[{$]) ", "$1"),
    (r"(\p{L}) '(\p{L})", "$1'$2"),
    (r"\s+", " "),
    (r"^ | $", ""),
]


# a text in which a trace is not found is left as it is by every rule beside it
_SPACES = " +"
_TRACES = [
    ("[\r()]|  ", {"\r", r"\(", r"\)", _SPACES, r"\) ([.!:?;,])", r"\( ", r" \)"}),
    ("[%:;]", {r"(\d) %", " :", " ;"}),
    ("[„“”–—´‘’‚…«»]|  |''", {"„", "“", "”", "–", "—", _SPACES, "´", "(?i)([a-z])‘([a-z])", "(?i)([a-z])’([a-z])", "‘", "‚", "’", "''", "´´", "…",
                              " « ", "« ", "«", " » ", " »", "»"}),
    ("[%?!]|  ", {" %", r" \?", " !", _SPACES}),
    ('"', {r'"([,.]+)', ',"'}),
    (r"  |[\t\n\x0B\f\r]|^ | $", {r"\s+", "^ | $"}),
    ("-", {r"([\p{L}\p{N}])-([\p{L}\p{N}])"}),
    (",", {r"([^\p{N}]),", r",([^\p{N}])", "^,", ",$"}),
    ("'", {r"([\p{L}])'([\p{L}])", r"([^\p{L}])'", "^'", "'"}),
    (r"\.", {r"\.\.+", r"([^.])\.\s*$"}),
]


def guarded(rules):
    """The rules in their order as stretches: (trace or None, rules)."""
    out = []
    for rule in rules:
        if out and out[-1][0] is not None and rule[0] in out[-1][1]:
            out[-1][2].append(rule)
        else:
            trace, known = next(((t, k) for t, k in _TRACES if rule[0] in k), (None, set()))
            out.append((trace, known, [rule]))
    return [(trace, own) for trace, _, own in out]


def to_duckdb_rules(rules):
    """Same rules with replacement group references in RE2 syntax (`\\1`)."""
    return [(p, re.sub(r"\$(\d)", r"\\\1", r)) for p, r in rules]


def duckdb_chain(expr: str, rules) -> str:
    """SQL text applying `rules` to `expr` in DuckDB (used by the oracle)."""
    out = expr
    for p, r in to_duckdb_rules(rules):
        out = f"regexp_replace({out}, {_q(p)}, {_q(r)}, 'g')"
    return out


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
