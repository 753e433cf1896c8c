"""Operator 4: language-model scoring with a hashed maximum-entropy model.

Output words lie in CLASSES classes of SLOTS slots: the OWN most frequent words have a slot each,
all other words are hashed to the remaining slots and share them.  So
    P(w | h) = P(class | h) * P(slot | class, h) * P(w | slot, word before),
a class-factored softmax.  The weights of the first two factors are hashed features of the history
h: the word before, the two words before, and the word two places before (a skip); their tables
have a fixed size, as every task reads them.  The last factor has one weight for every pair of
neighbouring words of the training part whose second word shares its slot, so it grows with the
corpus:  P(w | s, v) = q(w) exp(x[v, w]) / Z(v, s), where q is the smoothed share of w in the slot
by counts, x is 0 for pairs that training does not hold, and Z sums over all words of the slot.

Texts become packs of word numbers in the shared folder.  Word counts are gathered over the whole
training part and go back to the packs that hold the word.  Training runs in rounds: every task
takes gradient steps on its packs from the same weights, and the changes are averaged by how
often a task used a weight row.  Pairs are counted in the packs and summed by the hash of (v, s),
where their weights take scaled gradient steps on the penalised likelihood; what a pair adds to a
score goes back to the packs that hold it.  The weight table of the pairs is never in one place.
Pairs are named by 64 bits (s, 27 bits of v and s beside their bucket, 28 of w): pairs of one name
share a weight.  Scoring works on sparse numpy batches of one pack.

Null and empty texts are one token, the end.  Repeated rows train and are scored one by one; a
null doc_id is never held out.  An empty table, or one without training rows, gives scores of the
start weights.  Columns besides doc_id and text are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, Words, bucket_count, column, column_bytes, mix, pack, row_slices, shared_table, text_bytes, unpack

CLASSES, SLOTS, OWN = 32, 32, 512
ROW_BITS = 13
ROWS = 1 << ROW_BITS  # rows of each weight table
PACK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
PAIR_BUCKET_BYTES = 32 << 20
SLOT_BITS, WORD_BITS = 55, 28  # places of the slot, and bits of the word, in the name of a pair
PENALTY, PAIR_STEPS = 0.25, 12  # of the squared weights of pairs; gradient steps
ROUNDS, STEP, RATE = 1, 32768, 0.15
BLOCKS = 64  # parts of the weight tables, averaged apart
SMOOTH = 0.1
END = np.uint64(0x0E4D5EED0E4D5EED)
OUTPUTS = CLASSES * SLOTS


def held_out(doc_id, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def _packs(batches):
    """Texts -> (pack, payload, words): numbers of the words by falling count in the pack."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    waiting, size = [], 0

    def sent():
        h = np.concatenate([w[1] for w in waiting])
        ids = [i for w in waiting for i in w[0]]
        length = np.concatenate([w[2] for w in waiting])
        known, which, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        payload = pack(token=place[which])
        rows = pack(doc_id=pa.array(ids, pa.int64()), length=length.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([payload], pa.binary()), pa.array([rows], pa.binary()),
                                           pa.array([pack(h=known[order])], pa.binary())], names=["pack", "payload", "rows", "known"])

    for batch in batches:
        data, offs = column_bytes(batch.column(1))
        for lo, hi in row_slices(offs):
            words = Words(LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], SPACE_WORDS)
            length = words.n + 1
            h = np.full(int(length.sum()), END)
            inside = np.ones(len(h), bool)
            inside[np.cumsum(length) - 1] = False
            h[inside] = words.hashes()
            waiting.append((batch.column(0).slice(lo, hi - lo).to_pylist(), h, length))
            size += len(words.data)
            if size >= PACK_BYTES:
                yield sent()
                waiting, size, number = [], 0, number + 1
    if waiting:
        yield sent()


class Pack:
    """Tokens of some documents: `token` numbers into `known` word hashes."""

    def __init__(self, payload, rows, known):
        self.token = column(unpack(payload), "token")
        table = unpack(rows)
        self.ids = table.column("doc_id").to_pylist()
        self.length = column(table, "length").astype(np.int64)
        self.known = column(unpack(known), "h")
        self.held = np.array([held_out(i) for i in self.ids], bool)

    def count(self, docs: np.ndarray) -> np.ndarray:
        """Tokens of each known word in the documents of the mask."""
        return np.bincount(self.token[np.repeat(docs, self.length)], minlength=len(self.known))


def _requests(n_buckets: int):
    """Packs -> (bucket, pack, payload): words of a bucket and their training counts in the pack."""

    def run(batches):
        for batch in batches:
            for number, payload, rows, known in zip(*(c.to_pylist() for c in batch.columns)):
                p = Pack(payload, rows, known)
                count = p.count(~p.held)
                bucket = (p.known % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                parts = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if x < y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()),
                     pa.array([pack(h=p.known[i], count=count[i].astype(np.int64)) for _, i in parts], pa.binary())],
                    names=["bucket", "pack", "payload"])

    return run


COUNTS = "kind int, pack long, bucket int, payload binary, slot int, n long, words long"


def shared_slot(h: np.ndarray) -> np.ndarray:
    """The output that a word without a slot of its own shares."""
    return OWN + (mix(h + np.uint64(11)) % np.uint64(OUTPUTS - OWN)).astype(np.int64)


def _sum_counts(table: pa.Table) -> pa.Table:
    """A bucket -> kind 0: counts for each pack; kind 1: tokens and words by shared output; kind 2:
    its most frequent words (hash in `pack`)."""
    parts = [unpack(p) for p in table.column("payload")]
    h = np.concatenate([column(p, "h") for p in parts])
    known, which = np.unique(h, return_inverse=True)
    count = np.bincount(which, np.concatenate([column(p, "count") for p in parts]).astype(np.float64), len(known)).astype(np.int64)
    cut = np.cumsum([0] + [p.num_rows for p in parts])
    back = [pack(count=count[which[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    slot = shared_slot(known)
    n = np.bincount(slot, count.astype(np.float64), OUTPUTS).astype(np.int64)
    words = np.bincount(slot[count > 0], minlength=OUTPUTS)
    used = np.flatnonzero(words)
    top = np.argsort(-count, kind="stable")[:OWN]
    kinds = [len(parts), len(used), len(top)]
    none = lambda k, t: pa.nulls(k, t)
    chunk = lambda *xs, t: pa.chunked_array([pa.array(x, t) if not isinstance(x, pa.Array) else x for x in xs], t)
    return pa.table({
        "kind": pa.array(np.repeat([0, 1, 2], kinds), pa.int32()),
        "pack": chunk(table.column("pack").to_pylist(), none(kinds[1], pa.int64()), known[top].astype(np.int64), t=pa.int64()),
        "bucket": chunk(table.column("bucket").to_pylist(), none(kinds[1] + kinds[2], pa.int32()), t=pa.int32()),
        "payload": chunk(back, none(kinds[1] + kinds[2], pa.binary()), t=pa.binary()),
        "slot": chunk(none(kinds[0], pa.int32()), used, none(kinds[2], pa.int32()), t=pa.int32()),
        "n": chunk(none(kinds[0], pa.int64()), n[used], count[top], t=pa.int64()),
        "words": chunk(none(kinds[0], pa.int64()), words[used], none(kinds[2], pa.int64()), t=pa.int64()),
    })


class MaxEnt:
    """Two weight tables and the outputs of the most frequent words."""

    def __init__(self, own: np.ndarray, tables: list[np.ndarray] | None = None):
        self.order = np.argsort(own)
        self.own = own[self.order]
        self.tables = tables if tables is not None else [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32)]

    def outputs(self, known: np.ndarray) -> np.ndarray:
        out = shared_slot(known)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, known), len(self.own) - 1)
            found = self.own[at] == known
            out[found] = self.order[at[found]]
        return out

    @staticmethod
    def histories(token: np.ndarray, length: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
        """A hash of each feature for each token; documents begin with an empty history."""
        h = mix(known)[token]
        place = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
        back = []
        for d in (1, 2):
            x = np.zeros_like(h)
            x[d:] = h[:-d] if d < len(h) else 0
            back.append(np.where(place >= d, x, np.uint64(d)))
        with np.errstate(over="ignore"):
            return [mix(back[0] + np.uint64(1)), mix(back[0] * np.uint64(3) + back[1] * np.uint64(5) + np.uint64(2)), mix(back[1] + np.uint64(3))]

    @staticmethod
    def rows(features: list[np.ndarray], group: np.ndarray | None = None) -> list[np.ndarray]:
        """Weight rows of the features, for the class table or, by class, for the slot table."""
        mask = np.uint64(ROWS - 1)
        if group is None:
            return [(f & mask).astype(np.intp) for f in features]
        with np.errstate(over="ignore"):
            own = mix(group.astype(np.uint64) + np.uint64(77))
            return [(((f >> np.uint64(20)) + own) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ROW_BITS) & mask).astype(np.intp) for f in features]

    @staticmethod
    def softmax(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = np.take(table, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(table, r, axis=0)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def log10(self, token, length, known) -> np.ndarray:
        """log10 P(output | history) of each token."""
        out = self.outputs(known)[token]
        features = self.histories(token, length, known)
        total = np.empty(len(token))
        for a in range(0, len(token), STEP):
            own = out[a : a + STEP]
            part = [f[a : a + STEP] for f in features]
            at = np.arange(len(own))
            p = self.softmax(self.tables[0], self.rows(part))[at, own // SLOTS]
            q = self.softmax(self.tables[1], self.rows(part, own // SLOTS))[at, own % SLOTS]
            total[a : a + STEP] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30))
        return total

    def learn(self, token, length, known, squares: list[np.ndarray], used: list[np.ndarray]) -> None:
        """Gradient steps with a falling pace for each weight; `used` counts the uses of each row."""
        out = self.outputs(known)[token]
        features = self.histories(token, length, known)
        for a in range(0, len(token), STEP):
            own = out[a : a + STEP]
            part = [f[a : a + STEP] for f in features]
            at = np.arange(len(own))
            for k, target in enumerate((own // SLOTS, own % SLOTS)):
                table, rows = self.tables[k], self.rows(part, None if k == 0 else own // SLOTS)
                g = self.softmax(table, rows)
                g[at, target] -= 1
                every = np.concatenate(rows).astype(np.uint16)  # the rows of all features, below 2 ** 16
                order = np.argsort(every, kind="stable")
                row, begin = np.unique(every[order], return_index=True)
                step = np.add.reduceat(np.take(g, order % len(own), axis=0), begin, axis=0)
                used[k][row] += np.diff(np.append(begin, len(every))).astype(np.float32)
                squares[k][row] += step * step
                table[row] -= RATE * step / np.sqrt(squares[k][row] + 1e-6)


def _learn(model, round_: int, rounds: int):
    """Packs -> (block, change, used): changes of the weights, times the uses of their rows."""

    def run(batches):
        own, tables = model.value
        net = MaxEnt(own, [t.copy() for t in tables])
        squares, used = [np.zeros_like(t) for t in tables], [np.zeros(ROWS, np.float32) for _ in tables]
        for batch in batches:
            for _, payload, rows, known in zip(*(c.to_pylist() for c in batch.columns)):
                p = Pack(payload, rows, known)
                turn = mix(np.array([i or 0 for i in p.ids], np.int64).astype(np.uint64)) % np.uint64(rounds) == round_
                docs = turn & ~p.held
                if docs.any():
                    net.learn(p.token[np.repeat(docs, p.length)], p.length[docs], p.known, squares, used)
        if used[0].any():
            change = np.stack([(n - t) * u[:, None] for n, t, u in zip(net.tables, tables, used)], axis=1)
            uses = np.stack(used, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(change, BLOCKS)], pa.binary()),
                 pa.array([x.tobytes() for x in np.split(uses, BLOCKS)], pa.binary())], names=["block", "change", "used"])

    return run


def _add_up(batches):
    """(block, change, used) rows of a partition -> one row for each block."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            parts = [np.frombuffer(x, np.float32) for x in parts]
            total[block] = [a + b for a, b in zip(total[block], parts)] if block in total else parts
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), *[pa.array([x[k].astype(np.float32).tobytes() for x in total.values()], pa.binary()) for k in (0, 1)]],
            names=["block", "change", "used"])


def train(packs: DataFrame, own: np.ndarray, rounds: int = ROUNDS) -> MaxEnt:
    """One pass over all training documents, in rounds."""
    net, spark = MaxEnt(own), packs.sparkSession
    blocks = "block int, change binary, used binary"
    for r in range(rounds):
        given = spark.sparkContext.broadcast((own, net.tables))
        parts = packs.select("pack", "payload", "rows", "known").mapInArrow(_learn(given, r, rounds), blocks)
        for row in parts.repartition(BLOCKS, "block").mapInArrow(_add_up, blocks).collect():  # a model's size
            size = ROWS // BLOCKS
            change = np.frombuffer(row.change, np.float32).reshape(size, 2, -1)
            used = np.frombuffer(row.used, np.float32).reshape(size, 2)
            for k in range(2):
                net.tables[k][row.block * size : (row.block + 1) * size] += change[:, k] / np.maximum(used[:, k : k + 1], 1)
    return net


class Slots:
    """Tokens and words of the training part by shared output."""

    def __init__(self, n: np.ndarray, words: np.ndarray):
        self.n, self.words = n, words

    def share(self, count: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Share of a word of `count` tokens; the words that training does not hold share one more."""
        return (count + SMOOTH) / (self.n[slot] + SMOOTH * (self.words[slot] + 1))


class Pairs:
    """Distinct pairs (word before, word) of a pack whose word shares its slot, by bucket and name.

    `at`: tokens of the pack that end a pair; `which`: the pair of each; `cut`: bounds of the buckets.
    """

    def __init__(self, p: Pack, slot: np.ndarray, n_buckets: int):
        k = len(p.known)
        before = np.zeros(len(p.token), np.int64)
        before[1:] = p.token[:-1] + 1
        before[np.cumsum(p.length) - p.length] = 0  # a document begins
        self.at = np.flatnonzero(slot[p.token] >= OWN)
        code, which = np.unique(before[self.at] * k + p.token[self.at], return_inverse=True)
        word = code % k
        with np.errstate(over="ignore"):
            group = mix(mix(np.concatenate([[np.uint64(1)], p.known]))[code // k] * np.uint64(3) + slot[word].astype(np.uint64))
            bucket = (mix(group + np.uint64(5)) % np.uint64(n_buckets)).astype(np.int64)
        name = (slot[word] - OWN).astype(np.uint64) << np.uint64(SLOT_BITS)
        name |= group >> np.uint64(64 - SLOT_BITS + WORD_BITS) << np.uint64(WORD_BITS) | mix(p.known[word]) >> np.uint64(64 - WORD_BITS)
        order = np.lexsort((name, bucket))
        self.name, self.word = name[order], word[order]
        self.cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which = place[which]

    def parts(self):
        return [(b, slice(x, y)) for b, (x, y) in enumerate(zip(self.cut[:-1], self.cut[1:])) if x < y]


def _pack_counts(p: Pack, by_bucket: dict, n_buckets: int) -> np.ndarray:
    """Training count of each known word of a pack, from the parts that came back."""
    bucket = (p.known % np.uint64(n_buckets)).astype(np.int64)
    count = np.zeros(len(p.known), np.int64)
    count[np.argsort(bucket, kind="stable")] = np.concatenate([column(unpack(by_bucket[b]), "count") for b in np.unique(bucket)])
    return count


def _ask_pairs(own: np.ndarray, n_buckets: int, n_pairs: int):
    """A pack and its counts -> (bucket, pack, payload): names of pairs, their training counts, and
    the counts of their words."""

    def run(packs: pa.Table, counts: pa.Table) -> pa.Table:
        net, rows = MaxEnt(own, []), []
        by_bucket = dict(zip(counts.column("bucket").to_pylist(), counts.column("payload")))
        for number, payload, docs, known in zip(*(packs.column(c).to_pylist() for c in ("pack", "payload", "rows", "known"))):
            p = Pack(payload, docs, known)
            count, slot = _pack_counts(p, by_bucket, n_buckets), net.outputs(p.known)
            pairs = Pairs(p, slot, n_pairs)
            n = np.bincount(pairs.which, np.repeat(~p.held, p.length)[pairs.at], len(pairs.name)).astype(np.int64)
            for b, x in pairs.parts():
                name, word = pairs.name[x], pairs.word[x]
                rows.append((b, number, pack(high=(name >> np.uint64(48)).astype(np.uint16), middle=(name >> np.uint64(32)).astype(np.uint16),
                                             low=name.astype(np.uint32), n=narrow(n[x]), count=narrow(count[word]))))
        bucket, number, payload = zip(*rows) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "pack": pa.array(number, pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def fit_pairs(begin: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log P(w | s, v) - log q(w) of each pair; `begin` is the first pair of each group (v, s).

    The weights x of pairs with n > 0 climb sum(n * log P) - PENALTY / 2 * sum(x * x): the gradient is
    n - N * P - PENALTY * x, N the tokens of the group.  Its derivative is a diagonal D less N * P P',
    so each step solves for the whole group with two sums.
    """
    if not len(n):
        return np.zeros(0)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(n))))
    seen = np.flatnonzero(n)
    own, count, share = group[seen], n[seen], q[seen]
    total = np.bincount(own, count, len(begin))[own]
    x = np.zeros(len(seen))
    z = lambda: 1 + np.bincount(own, share * np.expm1(x), len(begin))
    for _ in range(PAIR_STEPS):
        p = share * np.exp(x) / z()[own]
        d = total * p + PENALTY
        slope = (count - total * p - PENALTY * x) / d
        along, left = np.bincount(own, p * slope, len(begin)), 1 - np.bincount(own, total * p * p / d, len(begin))
        x += np.clip(slope + total * p / d * (along / np.maximum(left, 1e-9))[own], -2, 2)
    gain = -np.log(z())[group]
    gain[seen] += x
    return gain


def _sum_pairs(slots):
    """The parts of a bucket -> gains (log10) of their pairs, for each pack."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload")]
        get = lambda c: np.concatenate([column(p, c) for p in parts])
        name = get("high").astype(np.uint64) << np.uint64(48) | get("middle").astype(np.uint64) << np.uint64(32) | get("low").astype(np.uint64)
        name, first, which = np.unique(name, return_index=True, return_inverse=True)
        n = np.bincount(which, get("n"), len(name))
        q = slots.value.share(get("count")[first], OWN + (name >> np.uint64(SLOT_BITS)).astype(np.int64))
        group = name >> np.uint64(WORD_BITS)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        gain = (fit_pairs(begin, n, q) / np.log(10)).astype(np.float32)
        cut = np.cumsum([0] + [p.num_rows for p in parts])
        return pa.table({"kind": pa.array([3] * len(parts), pa.int32()), "pack": table.column("pack"), "bucket": table.column("bucket"),
                         "payload": pa.array([pack(gain=gain[which[a:b]]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model, slots, n_buckets: int, n_pairs: int):
    def run(packs: pa.Table, back: pa.Table) -> pa.Table:
        own, tables, total, distinct = model.value
        net, out = MaxEnt(own, tables), []
        counts, gains = {}, {}
        for kind, bucket, payload in zip(back.column("kind").to_pylist(), back.column("bucket").to_pylist(), back.column("payload")):
            (gains if kind else counts)[bucket] = payload
        for payload, rows, known in zip(*(packs.column(c).to_pylist() for c in ("payload", "rows", "known"))):
            p = Pack(payload, rows, known)
            count = _pack_counts(p, counts, n_buckets)
            base = np.log10((count + SMOOTH) / (total + SMOOTH * (distinct + 1)))
            slot = net.outputs(p.known)
            share = np.where(slot < OWN, 0.0, np.log10(slots.value.share(count, slot)))
            begin = np.cumsum(p.length) - p.length
            sums = lambda x: np.add.reduceat(x, begin)
            score = net.log10(p.token, p.length, p.known) + share[p.token]
            pairs = Pairs(p, slot, n_pairs)
            if len(pairs.name):
                gain = np.concatenate([column(unpack(gains[b]), "gain") for b, _ in pairs.parts()])
                score[pairs.at] += gain[pairs.which]
            out.append(pa.table({
                "doc_id": pa.array(p.ids, pa.int64()), "held_out": pa.array(p.held), "n_tokens": pa.array(p.length),
                "n_known": pa.array(sums((count > 0).astype(np.int64)[p.token])), "train_tokens": pa.array(np.full(len(p.ids), total, np.int64)),
                "base_score": pa.array(sums(base[p.token])), "score": pa.array(sums(score)),
            }))
        return pa.concat_tables(out)

    return run


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; documents
    whose crc32(doc_id as text) mod 10 is 0 are held out, the others train the model."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packs = shared_table(docs.mapInArrow(_packs, "pack long, payload binary, rows binary, known binary"), "packs")
    n = bucket_count(spark, text_bytes(docs), BUCKET_BYTES)
    asked = packs.mapInArrow(_requests(n), "bucket int, pack long, payload binary")
    counts = shared_table(asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_sum_counts, COUNTS), "counts")

    top = counts.filter("kind = 2 AND n > 0").orderBy(F.desc("n"), "pack").limit(OWN).collect()  # bounded by OWN
    own = np.array([r.pack for r in top], np.int64).astype(np.uint64)
    slot_n, slot_words = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    for r in counts.filter("kind = 1").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():  # bounded by OUTPUTS
        slot_n[r.slot], slot_words[r.slot] = r.n, r.words
    total, distinct = int(slot_n.sum()), int(slot_words.sum())
    for h, r in zip(shared_slot(own), top):  # words with a slot of their own share no other
        slot_n[h] -= r.n
        slot_words[h] -= 1

    net = train(packs, own, rounds)
    model = spark.sparkContext.broadcast((own, net.tables, total, distinct))
    slots = spark.sparkContext.broadcast(Slots(slot_n, slot_words))
    n_pairs = bucket_count(spark, text_bytes(docs), PAIR_BUCKET_BYTES)
    back = counts.filter("kind = 0").select("kind", "pack", "bucket", "payload")
    asked = packs.groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(_ask_pairs(own, n, n_pairs), "bucket int, pack long, payload binary")
    gains = asked.repartition(n_pairs, "bucket").groupBy("bucket").applyInArrow(_sum_pairs(slots), "kind int, pack long, bucket int, payload binary")
    back = back.unionByName(gains)
    return packs.groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(_score(model, slots, n, n_pairs), SCORES)
