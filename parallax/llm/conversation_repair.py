"""Operator 13: conversation structure repair by a square-root checkpointed dynamic program.

The cheapest edits (Keep, Rerole, Delete, Insert) that turn the role initials of a conversation
into `(s?(ua)+)?`.  What has been written so far is one of four states: nothing, s, u or a.

1. Rows get a position in their conversation from Spark's range partitioning, so a conversation
   that holds a third of all rows is sorted by many tasks.  Faults are built-in expressions; the
   first of equal rows is a minimum combined before its shuffle.
2. A conversation is cut into blocks of at most the square root of all rows (`LEAST_BLOCK` at
   least); a block carries one small code per row, no text.
3. Where a conversation has several blocks, each block is summed up as a 4 x 4 table of least
   costs from state to state.  These are chained backward: the state-cost vectors are stored at
   block ends only.  Each block then finds where its tight walk ends from each of the four
   states, and these are chained forward to the state in which each block really starts.
4. Inside a block the same is done again: backward state-cost vectors are stored at checkpoints
   a square root of its length apart, and each stretch between two is computed again while the
   walk goes forward and takes the ASCII-least edit that is still cheapest.

A null role or text counts as one space; a null conv_id is a conversation of its own.  Rows are
taken by turn, nulls first; equal turns by role and the md5 of the text, so repeated rows are
neighbours.  An initial other than s, u and a is never kept.  Only conv_id, turn, role and text
are read, whatever other columns there are.  An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..caches import release
from ..operators.sequence import with_position
from .common import shared_table

LEAST_BLOCK = 512  # rows of the shortest block of a conversation that has several
NEVER = 1 << 40
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after an inserted (or changed) row: an assistant after a user, else a user.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ADDED = "uuau"
KEPT = {(0, START): AFTER_S, (1, START): AFTER_U, (1, AFTER_S): AFTER_U, (1, AFTER_A): AFTER_U, (2, AFTER_U): AFTER_A}
SYMBOLS, DELETE, TRUNCATED = 4, 4, 8  # a code is the initial (s u a other) + DELETE + TRUNCATED
SPACE = " \t\n\x0b\x0c\r"


def _with_inserts(c: tuple) -> tuple:
    """Least costs if rows may also be inserted first."""
    u, a = min(c[AFTER_U], 2 + c[AFTER_A]), min(c[AFTER_A], 2 + c[AFTER_U])
    return min(c[START], 2 + u), min(c[AFTER_S], 2 + u), u, a


#: Least costs behind the last row: nothing or an assistant may stand last.
FINAL = _with_inserts((0, NEVER, NEVER, 0))


@lru_cache(maxsize=None)
def _options(code: int) -> tuple:
    """By state: the edits of one row as (initial, cost, next state), in ASCII order."""
    symbol, extra, out = code % SYMBOLS, 1 if code & TRUNCATED else 0, []
    for state in range(4):
        own = [("D", 3, state)]
        if not code & DELETE:
            if (symbol, state) in KEPT:
                own.append(("K", extra, KEPT[symbol, state]))
            own.append(("R", 2 + extra, NEXT[state]))
        out.append(tuple(own))
    return tuple(out)


def _before(code: int, after: tuple) -> tuple:
    """The state-cost vector before a row, from the one behind it."""
    return _with_inserts(tuple(min(cost + after[to] for _, cost, to in own) for own in _options(code)))


def block_costs(codes: list[int]) -> list[int]:
    """16 least costs: from each state before the block to each behind it."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else NEVER for s in range(4))
        for code in reversed(codes):
            v = _before(code, v)
        columns.append(v)
    return [columns[end][s] for s in range(4) for end in range(4)]


def walk(codes: tuple[int, ...], after: tuple, state: int) -> tuple[int, list[tuple[str, str, str]]]:
    """(state at the end, a (edits, added initials, fate) for each row) of the ASCII-least cheapest edits.

    fate: '=' kept, 'u' or 'a' its new role, '-' deleted.  `after` is the state-cost vector behind the block."""
    n = len(codes)
    step = math.isqrt(n) + 1
    stops = list(range(0, n, step)) + [n]
    stored = {n: after}
    v = after
    for i in range(n - 1, -1, -1):
        v = _before(codes[i], v)
        if i % step == 0:
            stored[i] = v
    out = []
    for lo, hi in zip(stops[:-1], stops[1:]):
        vectors = [stored[hi]]  # computed again, from the checkpoint behind
        for i in range(hi - 1, lo, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.append(stored[lo])
        vectors.reverse()
        for i in range(lo, hi):
            here, behind = vectors[i - lo], vectors[i - lo + 1]
            edits, added = "", ""
            while True:
                rest = here[state]
                own = _options(codes[i])[state]
                if own[0][1] + behind[state] == rest:
                    took = own[0]
                elif 2 + here[NEXT[state]] == rest:
                    edits, added, state = edits + "I", added + ADDED[state], NEXT[state]
                    continue
                else:
                    took = next(o for o in own if o[1] + behind[o[2]] == rest)
                break
            kind, _, to = took
            fate = {"D": "-", "K": "=", "R": ADDED[state]}[kind]
            out.append((edits + kind, added, fate))
            state = to
    return state, out


@lru_cache(maxsize=4096)
def known_walk(codes: tuple[int, ...], after: tuple, state: int):
    """`walk` for short conversations, of which many are alike."""
    return walk(codes, after, state)


def last_inserts(state: int) -> str:
    """Initials of the rows that must follow the last one."""
    added = ""
    while state not in (START, AFTER_A):
        added, state = added + ADDED[state], NEXT[state]
    return added


def _run_column(f, schema: str):
    """mapInArrow over block rows: f gets the rows of a batch as dictionaries."""

    def run(batches):
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in f(row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


_KEY = [("conv_key", pa.string()), ("block", pa.int64())]
_COSTS = pa.schema([*_KEY, ("costs", pa.list_(pa.int64()))])
_AFTER = pa.schema([*_KEY, ("after", pa.list_(pa.int64()))])
_ENDS = pa.schema([*_KEY, ("ends", pa.list_(pa.int32()))])
_STARTS = pa.schema([*_KEY, ("state", pa.int32())])
_EDITS = pa.schema([("conv_key", pa.string()), ("pos", pa.int64()), ("edits", pa.string()), ("added", pa.string()), ("fate", pa.string())])


def _chain_backward(batches):
    """Blocks of a conversation from last to first -> the state-cost vector behind each."""
    key, v = None, FINAL
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["conv_key"] != key:
                key, v = row["conv_key"], FINAL
            rows.append({"conv_key": key, "block": row["block"], "after": list(v)})
            c = row["costs"]
            v = tuple(min(c[4 * s + e] + v[e] for e in range(4)) for s in range(4))
        yield pa.RecordBatch.from_pylist(rows, schema=_AFTER)


def _chain_forward(batches):
    """Blocks of a conversation from first to last -> the state in which each starts."""
    key, state = None, START
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["conv_key"] != key:
                key, state = row["conv_key"], START
            rows.append({"conv_key": key, "block": row["block"], "state": state})
            state = row["ends"][state]
        yield pa.RecordBatch.from_pylist(rows, schema=_STARTS)


def _ends(row: dict):
    codes, after = tuple(row["codes"]), tuple(row["after"])
    yield {"conv_key": row["conv_key"], "block": row["block"], "ends": [walk(codes, after, s)[0] for s in range(4)]}


def _emit(block_rows: int):
    def f(row: dict):
        best = known_walk if len(row["codes"]) <= 32 else walk
        end, edits = best(tuple(row["codes"]), tuple(row["after"]), row["state"])
        first = row["block"] * block_rows
        for i, (e, added, fate) in enumerate(edits):
            yield {"conv_key": row["conv_key"], "pos": first + i, "edits": e, "added": added, "fate": fate}
        if row["last"] and (added := last_inserts(end)):
            yield {"conv_key": row["conv_key"], "pos": first + len(edits), "edits": "I" * len(added), "added": added, "fate": "-"}

    return _run_column(f, _EDITS)


def _block_edits(blocks: DataFrame, block_rows: int) -> DataFrame:
    """(conv_key, pos, edits, added, fate) of every row, and one row more where inserts end a conversation."""
    several = blocks.filter("block > 0").select("conv_key").distinct()
    final = F.array(*[F.lit(x).cast("long") for x in FINAL])
    short = blocks.join(several, "conv_key", "left_anti").select(
        "conv_key", "block", "codes", final.alias("after"), F.lit(START).alias("state"), F.lit(True).alias("last"))
    long = blocks.join(several, "conv_key", "left_semi")
    costs = long.mapInArrow(_run_column(lambda r: [{"conv_key": r["conv_key"], "block": r["block"], "costs": block_costs(r["codes"])}], _COSTS),
                            "conv_key string, block long, costs array<long>")
    after = costs.repartition("conv_key").sortWithinPartitions("conv_key", F.desc("block")).mapInArrow(
        _chain_backward, "conv_key string, block long, after array<long>")
    long = long.join(after, ["conv_key", "block"]).select("conv_key", "block", "codes", "after")
    ends = long.mapInArrow(_run_column(_ends, _ENDS), "conv_key string, block long, ends array<int>")
    starts = ends.repartition("conv_key").sortWithinPartitions("conv_key", "block").mapInArrow(
        _chain_forward, "conv_key string, block long, state int")
    final_block = blocks.groupBy("conv_key").agg(F.max("block").alias("block")).withColumn("last", F.lit(True))
    long = long.join(starts, ["conv_key", "block"]).join(final_block, ["conv_key", "block"], "left").select(
        "conv_key", "block", "codes", "after", "state", F.coalesce("last", F.lit(False)).alias("last"))
    schema = "conv_key string, pos long, edits string, added string, fate string"
    return short.unionByName(long).mapInArrow(_emit(block_rows), schema)


def conv_key(conv_id: Column) -> Column:
    """The conversation as a string that no null shares with a value."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """(conv_key, conv_id, pos, turn, role, text, fault): positions from 0 and the first fault of each
    row ('blank', 'duplicate', 'truncated' or '')."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = rows.select(conv_key(F.col("conv_id")).alias("conv_key"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("text_md5", F.md5("text"))
    placed = with_position(rows, "pos", ["conv_key", "turn", "role", "text_md5"], base=0, partition_by=["conv_key"])
    numbered = shared_table(placed, "turns")
    release(rows.sparkSession)
    first = numbered.groupBy("conv_key", "role", "text_md5").agg(F.min("pos").alias("pos")).select("conv_key", "pos", F.lit(True).alias("new"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = (F.when(last == "", "blank").when(F.col("new").isNull(), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    out = numbered.join(first, ["conv_key", "pos"], "left")
    return out.select("conv_key", "conv_id", "pos", "turn", "role", "text", fault.alias("fault"))


def repair_conversations(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(conv_key, conv_id, pos, turn, role, text, fault, edits, added, fate, lines): each row with the edits
    made before and to it and the lines `role:text` that stand for it in the repaired conversation;
    rows inserted at the end come with a row of their own, whose conv_id to fault are null.
    `block_rows` is the length of a block (default: by the square root of all rows)."""
    faulty = shared_table(faulty_rows(rows), "faults")
    block_rows = block_rows or max(LEAST_BLOCK, math.isqrt(faulty.count()) + 1)
    symbol = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3))
    code = symbol + F.when(F.col("fault").isin("blank", "duplicate"), DELETE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    coded = faulty.select("conv_key", "pos", F.floor(F.col("pos") / block_rows).alias("block"), code.alias("code"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "code")))  # a block at most
    blocks = coded.groupBy("conv_key", "block").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))
    blocks = shared_table(blocks, "blocks")
    edits = _block_edits(blocks, block_rows)
    name = F.when(F.col("fate") == "u", "user").when(F.col("fate") == "a", "assistant").otherwise(F.col("role"))
    own = F.when(F.col("fate") == "-", F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit(":"), F.col("text"))))
    new = F.transform(F.filter(F.split("added", ""), lambda x: x != ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:"))
    return edits.join(faulty, ["conv_key", "pos"], "left").select(
        "conv_key", "conv_id", "pos", "turn", "role", "text", "fault", "edits", "added", "fate", F.concat(new, own).alias("lines"))


_DIGEST = pa.schema([("conv_key", pa.string()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}


class _Digest:
    """What is carried through the rows of one conversation: never its texts."""

    def __init__(self, key: str):
        self.key, self.turns, self.low, self.high, self.seen = key, 0, None, None, None
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.sha, self.lines, self.initial = [], hashlib.sha256(), 0, None

    def add(self, row: dict) -> None:
        if row["fault"] is not None:
            turn, initial = row["turn"], row["initial"]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.initial is not None:
                self.n["illegal"] += self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if row["fault"]:
                self.n[row["fault"]] += 1
        self.audit.append(row["edits"])
        self.n["cost"] += sum(_COST[e] for e in row["edits"]) + (row["fault"] == "truncated" and row["fate"] != "-")
        if row["n_lines"]:
            self.sha.update((b"\n" if self.lines else b"") + row["piece"].encode())
            self.lines += row["n_lines"]

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_key": self.key, "gaps": gaps, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _digest(batches):
    now = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is None or row["conv_key"] != now.key:
                if now:
                    done.append(now.row())
                now = _Digest(row["conv_key"])
            now.add(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema=_DIGEST)


def conversation_digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation that has rows: its faults, cost, audit and the hash of what is left.

    A hash runs through a whole conversation, so one task reads each conversation, row by row and
    in order; it holds the audit, but no texts."""
    rows = repaired.select("conv_key", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "edits", "fate",
                           F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("piece"))
    rows = rows.repartition("conv_key").sortWithinPartitions("conv_key", "pos")
    return rows.mapInArrow(_digest, "conv_key string, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                    "cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with the stated damage: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties
    its text, 2 takes out its [.!?], 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")
    ).drop("copy")


def repaired_digest(conversations: DataFrame, rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(conv_id, gaps, ..., repaired_sha256) for every conv_id of `conversations`, from `rows`, its rows after damage."""
    found = conversation_digest(repair_conversations(rows, block_rows))
    every = conversations.select("conv_id", conv_key(F.col("conv_id")).alias("conv_key")).distinct()
    zero = {n: F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, "conv_key", "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
