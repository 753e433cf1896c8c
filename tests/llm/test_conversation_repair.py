import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from parallax.llm import queries
from parallax.llm.conversation_repair import conversation_digest, damaged, repair_conversations, repaired_digest

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = WORD.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, lines) of a program that goes forward and holds whole audits and lines."""

    def step(initials, add):
        s = initials + add
        return s if re.fullmatch(r"s?(ua)*u?", s) else None

    def shrink(s):  # only the last initial counts further on
        return s[-1:]

    def inserts(now):
        for _ in range(3):
            for s, (c, a, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    if step({"": "", "s": "s", "u": "u", "a": "ua"}[s], role[0]):
                        new = (c + 2, a + "I", (*lines, f"{role}:"))
                        if role[0] not in now or new[:2] < now[role[0]][:2]:
                            now[role[0]] = new
        return now

    now = inserts({"": (0, "", ())})
    for (_, _, role, text), f in zip(rows, fault):
        nxt = {}

        def offer(s, value):
            if s not in nxt or value[:2] < nxt[s][:2]:
                nxt[s] = value

        for s, (c, a, lines) in now.items():
            offer(s, (c + 3, a + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            extra = f == "truncated"
            before = {"": "", "s": "s", "u": "u", "a": "ua"}[s]
            if role[:1] in ("s", "u", "a") and step(before, role[0]):
                offer(shrink(role[0]), (c + extra, a + "K", (*lines, f"{role}:{text}")))
            for r in ("user", "assistant"):
                if step(before, r[0]):
                    offer(r[0], (c + 2 + extra, a + "R", (*lines, f"{r}:{text}")))
        now = inserts(nxt)
    return min(v for s, v in now.items() if s in ("", "a"))


def brute(conversation, rows):
    out = {}
    for conv in {r[0] for r in conversation}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        f = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest(own, f)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[f.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(df, want):
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert got == want


def random_rows(seed, n=60, turns=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, turns)):
            rows.append((conv, rng.choice((turn, turn, turn, None, turn * 3)), rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "User")),
                         rng.choice(("Ja.", "Nein!", "no end", "so ?\n\t", " ", "", "é.", "a.b")) + rng.choice(("", "", " ", "x"))
                         if rng.random() < 0.9 else None))
    return rows + [(None, 1, "user", "Hm."), (None, None, None, None)]


@pytest.mark.parametrize("seed,block", [(1, None), (2, 3), (3, 2), (4, 1)])
def test_against_forward_program(spark, seed, block):
    """Blocks of one to three rows, so that most conversations go through both chains."""
    rows = random_rows(seed)
    table = spark.createDataFrame(rows, COLUMNS).repartition(4)
    hurt = damage(rows)
    check(repaired_digest(table, damaged(table), block_rows=block), brute(rows, hurt))


def test_long_conversation(spark):
    """The chains run over many blocks, and blocks have checkpoints inside."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(("user", "assistant", "system")), f"w{rng.randrange(150)}" + rng.choice((".", "!", "", ""))) for t in range(700)]
    rows += [(2, 0, "user", "One."), (2, 1, "assistant", "Two.")]
    table = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repaired_digest(table, table, block_rows=27).collect()}
    want = brute(rows, rows)
    assert got == want and got[2][5] == 0 and got[2][6] == "KK"


def test_every_script_of_short_conversations(spark):
    """All scripts of up to three rows, tried one by one."""
    kinds = [("system", "S."), ("user", "U."), ("assistant", "A."), ("tool", "T."), ("user", ""), ("assistant", "cut")]
    rows = []
    for i, combo in enumerate(product(kinds, repeat=3)):
        rows += [(i, t, r, x + f" {t}." if x == "S." else x) for t, (r, x) in enumerate(combo)]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)

    def scripts(own, f):
        best = None
        for cuts in product((0, 1, 2), repeat=len(own) + 1):
            for edits in product("KRD", repeat=len(own)):
                c, audit, lines, ok = 0, "", "", True
                for i in range(len(own) + 1):
                    for _ in range(cuts[i]):
                        lines += "u" if not lines or lines[-1] in "sa" else "a"
                        c, audit = c + 2, audit + "I"
                    if i == len(own):
                        break
                    e = edits[i]
                    if e != "D" and f[i] in ("blank", "duplicate"):
                        ok = False
                        break
                    c += {"K": 0, "R": 2, "D": 3}[e] + (e != "D" and f[i] == "truncated")
                    audit += e
                    lines += "" if e == "D" else own[i][2][0] if e == "K" else "u" if not lines or lines[-1] in "sa" else "a"
                if ok and LEGAL.fullmatch(lines) and (best is None or (c, audit) < best):
                    best = (c, audit)
        return best

    table = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = {r.conv_id: (r.cost, r.audit) for r in repaired_digest(table, table).collect()}
    assert got == {k: scripts(own, faults(own)) for k, own in by.items()}


def test_rows_and_lines(spark):
    rows = [(7, 0, "assistant", "Hi."), (7, 1, "user", "Who"), (7, 2, "user", "Who"), (7, 3, "assistant", " "), (8, 0, "user", "Hm.")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", pos string, edits int")
    got = [(r.edits, list(r.lines), r.fault) for r in repair_conversations(table).orderBy("conv_key", "pos").collect()]
    assert got == [("IK", ["user:", "assistant:Hi."], ""), ("D", [], "truncated"), ("D", [], "duplicate"), ("D", [], "blank"),
                   ("K", ["user:Hm."], ""), ("I", ["assistant:"], None)]


def test_empty_and_dropped(spark):
    table = spark.createDataFrame([], COLUMNS)
    assert repaired_digest(table, damaged(table)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], COLUMNS)
    assert [tuple(r) for r in repaired_digest(table, damaged(table)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_given_tables_and_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows, damage(rows))
    check(queries.QUERIES["op13_conversation_repair"](spark, sf), want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    got = con.execute(queries.ORACLE["op13_conversation_repair"]).fetchall()
    assert {r[0]: r[1:] for r in got} == want
