"""N-gram language model, segment scoring and cross-entropy difference (SURVEY §2.3 J2, J8;
§2.4 A10; §2.8 C1, C2, C4).

Model: interpolated modified Kneser-Ney (Chen & Goodman 1998), the estimate KenLM's
`lmplz` produces, as DataFrames.  A segment is `<s> t1 ... tn </s>`.

* Counting: a task codes its words as numbers and counts the n-grams of a block of segments in
  arrays; only those of the highest order (and shorter ones at <s>) are moved, those of lower orders are their ends.
* Adjusted counts of all orders: one pass over n-grams sorted from their last word to the first.
* Contexts: n-grams meet by context; own shares and back-off weights are made there.
* Interpolation: n-grams, contexts and words meet by the last two words.  Sorted from the last word to the first, an
  n-gram's tail stands before it, so all orders are made in one pass.

Rows are moved as parcels (`parcels.py`): four shuffles of compressed blocks, whatever the order, and a part is small.

The model is one table `(ngram STRING, n INT, log_p DOUBLE, log_b DOUBLE)` over all orders
(log10; `log_b` set for n-grams seen as a context), written once, bucketed by n-gram.  Train it
once and score any number of pools: the lookup does not shuffle it again.

Scoring: segments are coded in packs.  For more than two words, words and pairs are looked up first, and only
n-grams whose pairs are all known go on.  A pack's distinct n-grams of all orders meet the models in
one join (several models: one shuffle, as all are bucketed alike), so a frequent word or word
pair costs one row a pack and is no hot key; the found rows come back to the pack, one pack at a time, and
the segments read their probabilities and back-off weights by place.

`<s>`, `</s>` and `<unk>` are reserved: a token of a text that looks like one of them is marked,
so it is an ordinary (normally unknown) word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..caches import discard, stage, stage_bucketed
from .parcels import PARTS_OF, bucket_of, delivered, packed, part_of

BOS, EOS, UNK = "<s>", "</s>", "<unk>"
SEP = " "
FALLBACK_D = (0.5, 1.0, 1.5)  # discounts when the count-of-counts give no valid estimate
MARK = "\u2060"  # stands before a token that looks like a reserved one
BLOCK_TOKENS = 1 << 18  # of one block of counts
PACK_TOKENS = 1 << 16  # of one pack of segments; a longer segment is a pack of its own
_MARKED = {x.encode(): (MARK + x).encode() for x in (BOS, EOS, UNK)}


class Coded:
    """Segments as word numbers, and the distinct n-grams of each order up to `order`."""

    def __init__(self):
        self.words: dict[bytes, int] = {BOS.encode(): 0, EOS.encode(): 1}
        self.codes: list[int] = []
        self.first: list[int] = [0]  # where each segment begins

    def add(self, text: str | None) -> None:
        words = self.words
        self.codes.append(0)
        # bytes.split cuts at the six ASCII white-space characters, as `tokens` does
        self.codes += [words.setdefault(_MARKED.get(w, w), len(words)) for w in (text or "").encode().split()]
        self.codes.append(1)
        self.first.append(len(self.codes))

    def grams(self, order: int):
        """For each order: (the gram that ends at each position, -1 where there is none; the distinct grams; counts)."""
        word = np.array(self.codes, np.int64)
        first = np.array(self.first)
        place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))  # in its segment
        names = list(self.words)
        code, texts = word, names
        # every word is some gram of order 1: both reserved ones stand in every segment
        out = [(code, texts, np.bincount(code, minlength=len(names)))] if len(word) else [(code, [], np.zeros(0, np.int64))]
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 1)
            pair = code[at - 1] * len(names) + word[at]
            distinct, which, count = np.unique(pair, return_inverse=True, return_counts=True)
            code = np.full(len(word), -1, np.int64)
            code[at] = which
            heads, tails = (distinct // len(names)).tolist(), (distinct % len(names)).tolist()
            texts = [texts[a] + b" " + names[b] for a, b in zip(heads, tails)]
            out.append((code, texts, count))
        return out


COUNTS = "kind int, part int, parcel binary, word string, a long"  # kinds: parcels of n-grams, words by part, sums by order
GRAMS, WORDS, SUMS = range(3)
PARCEL = "part int, parcel binary"


def _last(grams: list[bytes]) -> list[bytes]:
    """The last two words of each n-gram: all n-grams with these are in one part."""
    return [b" ".join(g.rsplit(b" ", 2)[-2:]) for g in grams]


def _strings(grams: list[bytes]) -> pa.Array:
    return pa.array(grams, pa.binary()).cast(pa.string())


def _bytes(grams: pa.Array) -> list[bytes]:
    return grams.cast(pa.binary()).to_pylist()


def _sent(part: np.ndarray, names: pa.Array, *columns: np.ndarray):
    rows = list(packed(part, names, *columns))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "parcel"])


def _count(order: int, parts: int):
    """Segments -> parcels of (n-gram, count): of each place the n-gram of the highest order that ends there, which is
    shorter only where it begins with <s>.  All n-grams of lower orders end such a one."""

    def emit(block: Coded):
        grams = block.grams(order)
        text, c = [], []
        for n, (_, texts, count) in enumerate(grams, 1):
            own = range(len(texts)) if n == order else [i for i, g in enumerate(texts) if n > 1 and g.startswith(b"<s> ")]
            text += [texts[i] for i in own]
            c.append(count[list(own)])
        return _sent(part_of(_last(text), parts), _strings(text), np.concatenate(c).astype(np.int64))

    def run(batches):
        block = Coded()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                block.add(text)
                if len(block.codes) >= BLOCK_TOKENS:
                    yield emit(block)
                    block = Coded()
        if block.codes:
            yield emit(block)

    return run


def _from_the_last(grams: pa.Array, order: int):
    """n-grams -> (their words as numbers, the last in the last column and -1 where there is none; the words; the order
    from the last word to the first, a shorter one first)."""
    lists = pa.compute.split_pattern(grams, SEP)
    n = pa.compute.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    table = np.full((len(n), order), -1, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    table[np.repeat(np.arange(len(n)), n), np.repeat(order - n, n) + place] = coded.indices.to_numpy()
    return table, n, coded.dictionary, np.lexsort(tuple(table.T))


def _adjusted(order: int, parts: int):
    """The n-grams of a part -> parcels of (n-gram, n, a) for n > 1, by context, with words and sums.

    `a` is the raw count at the highest order or for n-grams that begin with <s>; else the number of distinct left
    extensions.  The words' are those of the part; the unigram <s> is dropped."""

    def run(part, grams, c):
        table, n, words, by = _from_the_last(grams, order)
        table, n, c = table[by], n[by], c[by]
        new = np.zeros(len(n), bool)  # another k-gram than the row before
        new[:1] = True
        starts = []
        for k in range(1, order + 1):
            new = new.copy()
            new[1:] |= table[1:, order - k] != table[:-1, order - k]
            starts.append(new & (n >= k))
        text, sizes, counts = [], [], []
        sums: dict = {}
        for k in range(1, order + 1):
            at = np.flatnonzero(starts[k - 1])
            if not len(at):
                continue
            block = np.cumsum(starts[k - 1])[n >= k] - 1
            raw = np.bincount(block, c[n >= k], len(at)).astype(np.int64)
            if k < order:
                left = np.bincount((np.cumsum(starts[k - 1]) - 1)[starts[k]], minlength=len(at))
                a = np.where(n[at] == k, raw, left)  # a row of k words only begins with <s>
            else:
                a = raw
            names = pa.compute.binary_join_element_wise(*[words.take(pa.array(table[at, col])) for col in range(order - k, order)], SEP)
            if k == 1:
                keep = np.array([x != BOS for x in names.to_pylist()])
                one, ones = names.filter(pa.array(keep)), a[keep]
                continue
            text.append(names)
            sizes.append(np.full(len(at), k, np.int32))
            counts.append(a.astype(np.int64))
            for name, x in [(f"n{j}", (a == j).sum()) for j in (1, 2, 3, 4)] + [("S", a.sum()), ("V", len(a))]:
                sums[k, name] = int(x)
        null = lambda m, kind: pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(one), WORDS, np.int32)), pa.array(np.full(len(one), part, np.int32)), null(len(one), pa.binary()), one, pa.array(ones.astype(np.int64))],
            names=["kind", "part", "parcel", "word", "a"])
        if not text:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array([SUMS] * len(sums), pa.int32()), pa.array([k for k, _ in sums], pa.int32()), null(len(sums), pa.binary()),
             pa.array([x for _, x in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["kind", "part", "parcel", "word", "a"])
        text = pa.concat_arrays(text)
        sent = _sent(part_of([g.rpartition(b" ")[0] for g in _bytes(text)], parts), text, np.concatenate(sizes), np.concatenate(counts))
        m = sent.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, GRAMS, np.int32)), sent.column(0), sent.column(1), null(m, pa.string()), null(m, pa.int64())], names=["kind", "part", "parcel", "word", "a"])

    return run


OWN, CONTEXT, TAIL, WORD = range(4)  # n-grams; contexts with their back-off weight; words as tails in a part; words of the model


def _contexts(order: int, parts: int, disc: dict):
    """The n-grams of some contexts -> parcels, by their last two words, of (n-gram, own share of its probability, weight of
    the lower order, OWN) and (context, weight, 0, CONTEXT)."""
    steps = np.zeros((order + 1, 4))
    for k, d in disc.items():
        steps[k] = (0.0, *d)

    def run(part, grams, n, a):
        names = _bytes(grams)
        contexts = _strings([g.rpartition(b" ")[0] for g in names]).dictionary_encode()
        at = contexts.indices.to_numpy()
        minus = steps[n, np.minimum(a, 3)]
        total = np.bincount(at, a)
        weight = np.bincount(at, minus) / total
        own = np.maximum(a - minus, 0.0) / total[at]
        heads = contexts.dictionary
        to = part_of(_last(names + _bytes(heads)), parts)
        kind = np.repeat([OWN, CONTEXT], [len(names), len(heads)]).astype(np.int8)
        yield _sent(to, pa.concat_arrays([grams, heads]), np.concatenate([own, weight]), np.concatenate([weight[at], np.zeros(len(heads))]), kind)

    return run


def _words(parts: int):
    """(word, p, part): words as tails of a part, and those of the model, whose part is null."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names, p = batch.column(0), batch.column(1).to_numpy()
                home = batch.column(2).is_null().to_numpy(zero_copy_only=False)
                part = np.where(home, part_of(_bytes(names), parts), batch.column(2).fill_null(0).to_numpy())
                yield _sent(part, pa.concat_arrays([names]), p, np.zeros(len(p)), np.where(home, WORD, TAIL).astype(np.int8))

    return run


def _model(order: int, buckets: int):
    """What `_contexts` and `_words` send to a part -> parcels of (n-gram, n, log_p, log_b), by bucket.

    From the last word to the first, an n-gram's tail is the last row before it that has one word less, so
    p = own + b * p(tail) needs no join."""

    def run(part, names, own, weight, kind):
        grams = np.flatnonzero((kind == OWN) | (kind == TAIL))
        _, n, _, by = _from_the_last(names.take(pa.array(grams)), order)
        p, b, n, at = own[grams][by], weight[grams][by], n[by], np.arange(len(by))
        for k in range(2, order + 1):
            here = np.flatnonzero(n == k)
            if len(here):
                last = np.maximum.accumulate(np.where(n == k - 1, at, -1))[here]
                p[here] += b[here] * p[last]
        p_all = own.copy()
        p_all[grams[by]] = p
        heads = np.flatnonzero(kind == CONTEXT)
        rows = np.flatnonzero((kind == OWN) | (kind == WORD))
        found = pa.compute.index_in(names.take(pa.array(rows)), value_set=names.take(pa.array(heads)))
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        found = found.fill_null(0).to_numpy()
        back = np.full(len(rows), np.nan)
        back[hit] = own[heads[found[hit]]]
        alone = np.ones(len(heads), bool)  # <s> is a context only
        alone[found[hit]] = False
        alone = heads[alone]
        with np.errstate(divide="ignore"):
            log_p = np.concatenate([np.log10(p_all[rows]), np.full(len(alone), np.nan)])
            log_b = np.log10(np.concatenate([back, own[alone]]))
        names = names.take(pa.array(np.concatenate([rows, alone])))
        yield _sent(bucket_of(names, buckets) * PARTS_OF, names, log_p, log_b)

    return run


def _rows(part, names, log_p, log_b):
    n = pa.compute.add(pa.compute.count_substring(names, SEP), pa.scalar(1, pa.int32()))
    yield pa.RecordBatch.from_arrays([names, n.cast(pa.int32()), *[pa.array(x, mask=np.isnan(x)) for x in (log_p, log_b)]], names=["ngram", "n", "log_p", "log_b"])


def _discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """(D1, D2, D3+) of one order from its counts of counts, with the fallback of SURVEY §7.3."""
    if not (n1 and n2 and n3 and n4):
        return FALLBACK_D
    y = n1 / (n1 + 2.0 * n2)
    d = tuple(j - (j + 1.0) * y * after / here for j, here, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return d if all(0.0 <= x <= j for j, x in enumerate(d, 1)) else FALLBACK_D


def buckets_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def train_ngram_lm(corpus: DataFrame, col: str = "text", order: int = 5) -> DataFrame:
    """A10: the model table (ngram, n, log_p, log_b), log10, bucketed by ngram.

    Includes `<unk>` (n = 1) and `<s>` (n = 1, context only: log_p null).
    """
    spark = corpus.sparkSession
    buckets = buckets_of(spark)
    parts = buckets * PARTS_OF
    counted = corpus.select(F.col(col).cast("string")).mapInArrow(_count(order, parts), PARCEL)
    counts = stage(delivered(counted, buckets, _adjusted(order, parts), COUNTS, np.int64), "lm-counts")
    disc = {}
    sums = counts.filter(F.col("kind") == SUMS).groupBy("part", "word").agg(F.sum("a").alias("a")).collect()  # six rows an order
    for k in {r["part"] for r in sums}:
        x = {r["word"]: r["a"] for r in sums if r["part"] == k}
        disc[k] = _discount(*[x[f"n{j}"] for j in (1, 2, 3, 4)])
    by_part = counts.filter(F.col("kind") == WORDS).select("word", "part", "a")
    words = stage(by_part.groupBy("word").agg(F.sum("a").alias("a")), "lm-words")
    a = F.col("a")
    one = words.agg(*[F.count_if(a == j).alias(f"n{j}") for j in (1, 2, 3, 4)], F.sum("a").alias("S"), F.count(F.lit(1)).alias("V")).first()
    d1, d2, d3 = d = _discount(*[one[f"n{j}"] for j in (1, 2, 3, 4)])
    # the empty context: its sums are known
    total = float(one["S"] or 1)
    unk = ((d[0] * one["n1"] + d[1] * one["n2"] + d[2] * (one["V"] - one["n1"] - one["n2"])) / total / (one["V"] + 1.0)) if one["V"] else 1.0
    minus = F.when(a == 1, d1).when(a == 2, d2).otherwise(d3)
    p = words.select("word", (F.greatest(a - minus, F.lit(0.0)) / F.lit(total) + F.lit(unk)).alias("p"))
    tails = by_part.select("word", "part").join(p, "word").select("word", "p", "part")
    home = p.unionByName(spark.range(1).select(F.lit(UNK).alias("word"), F.lit(unk).alias("p"))).withColumn("part", F.lit(None).cast("int"))
    sent = counts.filter(F.col("kind") == GRAMS).select("part", "parcel")
    sent = delivered(sent, buckets, _contexts(order, parts, disc), PARCEL, np.int32, np.int64)
    sent = sent.unionByName(tails.unionByName(home).mapInArrow(_words(parts), PARCEL))
    made = delivered(sent, buckets, _model(order, buckets), PARCEL, np.float64, np.float64, np.int8)
    model = delivered(made, buckets, _rows, "ngram string, n int, log_p double, log_b double", np.float64, np.float64)
    model = stage_bucketed(model, "lm-model", buckets, "ngram", placed=True)
    discard(counts, words)
    return model


def _packed(order: int, key_type: pa.DataType):
    """(key, text) -> packs: distinct n-grams, and for each segment and order the places of its n-grams."""

    def emit(keys: list, block: Coded):
        grams = block.grams(order)
        base = np.cumsum([0, *[len(texts) for _, texts, _ in grams]])
        text = pa.array([g for _, texts, _ in grams for g in texts], pa.binary()).cast(pa.string())
        codes = [np.where(code < 0, -1, code + b).astype(np.int32) for (code, *_), b in zip(grams, base)]
        lists = (text, pa.array(keys, key_type), pa.array(block.first, pa.int32()), pa.array(np.concatenate(codes)))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
                                          names=["grams", "keys", "first", "codes"])

    def run(batches):
        keys, block = [], Coded()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                block.add(text)
                if len(block.codes) >= PACK_TOKENS:
                    yield emit(keys, block)
                    keys, block = [], Coded()
        if keys:
            yield emit(keys, block)

    return run


def _pruned(order: int):
    """A pack of order 2 and the places of its grams that some model has -> the pack with n-grams of all orders that can be
    in a model: a longer one only where all its pairs of words are."""

    def prune(keys: pa.Array, first: np.ndarray, codes: np.ndarray, words: list, hit: np.ndarray):
        word, pair = np.asarray(codes, np.int64).reshape(2, -1)
        flags = np.zeros(max(int(codes.max(initial=-1)), int(hit.max(initial=-1))) + 2, bool)  # the last for places without one
        flags[hit] = True
        names = [w.encode() for w in words]
        ok, code, texts, out, base = np.ones(len(word), bool), word, names, [], 0
        lists = []
        for k in range(1, order + 1):
            if k == 1:
                good = flags[word]
            else:
                good = flags[pair] if k == 2 else ok & np.concatenate([[False], ok[:-1]])
            at = np.flatnonzero(good)
            ids = code[at] if k == 1 else code[at - 1] * len(names) + word[at]
            distinct, which = np.unique(ids, return_inverse=True)
            own = [names[x] for x in distinct.tolist()] if k == 1 else [texts[a] + b" " + names[b] for a, b in zip((distinct // len(names)).tolist(), (distinct % len(names)).tolist())]
            place = np.full(len(word), -1, np.int32)
            place[at] = which + base
            out.append(place)
            lists += own
            base += len(own)
            if k > 1:
                ok, texts = good, own
                code = np.full(len(word), -1, np.int64)
                code[at] = which
        grams = _strings(lists)
        return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (grams, keys, pa.array(first, pa.int32()), pa.array(np.concatenate(out)))]

    def run(packs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for pack in packs.to_batches():
            for r in range(pack.num_rows):
                own = lambda c: pack.column(c)[r].values  # noqa: E731, B023
                made = prune(own("keys"), own("first").to_numpy(), own("codes").to_numpy(), own("words").to_pylist(), found.column("i").to_numpy())
                rows.append(pa.Table.from_arrays([*made, pack.column("pack").slice(r, 1)], names=["grams", "keys", "first", "codes", "pack"]))
        return pa.concat_tables(rows)

    return run


def _scores(order: int, unk: list[float]):
    """A pack and the model rows of its n-grams -> (key, n_words, logprob0, n_oov0, ...)."""
    models = len(unk)

    def score(pack: dict):
        first = np.asarray(pack["first"])
        codes = np.asarray(pack["codes"], np.int64).reshape(order, -1)
        n_grams = pack["n_grams"]
        found = pack["found"]
        table = np.full((2 * models, n_grams + 1), np.nan)  # a last column for places without an n-gram
        i = found.column("i").to_numpy()
        for m in range(models):
            table[2 * m, i] = found.column(f"lp{m}").to_numpy()
            table[2 * m + 1, i] = found.column(f"lb{m}").to_numpy()
        scored = np.ones(codes.shape[1], bool)
        scored[first[:-1]] = False  # <s>
        out = [np.diff(first) - 2]
        for m in range(models):
            longest, lp = np.zeros(codes.shape[1], np.int64), np.full(codes.shape[1], unk[m])
            for j in range(1, order + 1):  # the longest n-gram that the model has
                own = table[2 * m, codes[j - 1]]
                hit = ~np.isnan(own)
                longest[hit], lp[hit] = j, own[hit]
            for j in range(1, order):  # contexts of that length or more that the model has
                before = np.concatenate([[-1], codes[j - 1][:-1]])
                weight = table[2 * m + 1, before]
                lp += np.where((longest <= j) & ~np.isnan(weight), weight, 0.0)
            lp[~scored] = 0.0
            out += [np.add.reduceat(lp, first[:-1]), np.add.reduceat(((longest == 0) & scored).astype(np.int64), first[:-1])]
        return out

    names = ["n_words"] + [f"{c}{m}" for m in range(models) for c in ("logprob", "n_oov")]
    kinds = [pa.int32()] + [pa.float64(), pa.int32()] * models

    def run(packs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for pack in packs.to_batches():
            for k in range(pack.num_rows):
                columns = score({"first": pack.column("first")[k].values.to_numpy(), "codes": pack.column("codes")[k].values.to_numpy(),
                                 "n_grams": pack.column("n_grams")[k].as_py(), "found": found})
                out.append(pa.Table.from_arrays([pack.column("keys")[k].values, *[pa.array(x).cast(t) for x, t in zip(columns, kinds)]], names=["key", *names]))
        return pa.concat_tables(out) if out else None

    return run


def score_segments(df: DataFrame, models: list[DataFrame], col: str = "text", key: str = "line_no", order: int = 5) -> DataFrame:
    """(key, n_words, logprob0, n_oov0, logprob1, ...) under several models."""
    kind = df.schema[key].dataType
    key_type = kind.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(key_type)
    if arrow is None:
        raise ValueError(f"a key is a bigint, an int or a string, not {key_type}")
    segments = df.select(F.col(key), F.col(col).cast("string").alias("text"))
    schema = f"grams array<string>, keys array<{key_type}>, first array<int>, codes array<int>"
    packs = stage(segments.mapInArrow(_packed(min(order, 2), arrow), schema).withColumn("pack", F.monotonically_increasing_id()), "lm-packs")
    if order > 2:  # words and pairs first, then longer n-grams whose pairs are in a model
        pairs = packs
        known = pairs.select("pack", F.posexplode("grams").alias("i", "ngram"))
        for m, model in enumerate(models):
            known = known.join(model.select("ngram", F.lit(True).alias(f"in{m}")), "ngram", "left")
        known = known.filter(F.coalesce(*[f"in{m}" for m in range(len(models))]).isNotNull()).select(F.col("pack").alias("of"), "i")
        n_words = F.array_max(F.slice("codes", F.lit(1), F.try_element_at("first", F.lit(-1)))) + 1
        own = pairs.select("pack", "keys", "first", "codes", F.slice("grams", F.lit(1), n_words).alias("words"))
        packs = stage(own.groupBy("pack").cogroup(known.groupBy("of")).applyInArrow(_pruned(order), schema + ", pack bigint"), "lm-packs")
        discard(pairs)
    found = packs.select("pack", F.posexplode("grams").alias("i", "ngram"))
    for m, model in enumerate(models):
        found = found.join(model.select("ngram", F.col("log_p").alias(f"lp{m}"), F.col("log_b").alias(f"lb{m}")), "ngram", "left")
    values = [f"{c}{m}" for m in range(len(models)) for c in ("lp", "lb")]
    found = found.filter(F.coalesce(*values).isNotNull()).select(F.col("pack").alias("of"), "i", *values)
    own = packs.select("pack", "keys", "first", "codes", F.size("grams").alias("n_grams"))
    unk = [m.filter(F.col("ngram") == UNK).select("log_p").first()[0] for m in models]  # one row a model
    out = ", ".join([f"key {key_type}, n_words int"] + [f"logprob{m} double, n_oov{m} int" for m in range(len(models))])
    scored = own.groupBy("pack").cogroup(found.groupBy("of")).applyInArrow(_scores(order, unk), out)  # a pack at a time
    return scored.withColumnRenamed("key", key)


def lm_score(df: DataFrame, model: DataFrame, col: str = "text", key: str = "line_no", order: int = 5) -> DataFrame:
    """Per segment (key, logprob, n_words, n_oov) in log10, as `query -v sentence`.

    `order` is the model's order or more.  `</s>` is scored, `<s>` is not; unknown words are scored
    as `<unk>`.  For the token w with history h: m = longest n-gram ending at w that the model
    has; log p = log p(that n-gram) + sum of log b(c) over the contexts c before w of length >= m
    that the model has as contexts.  No model n-gram or context contains `<unk>` or an unknown
    word, so lookups run on the raw tokens and only the unigram falls back to `<unk>`.
    """
    return score_segments(df, [model], col, key, order).select(
        key, F.col("logprob0").alias("logprob"), "n_words", F.col("n_oov0").alias("n_oov"))


def cross_entropy(df: DataFrame, model: DataFrame, col: str = "text", key: str = "line_no", order: int = 5) -> DataFrame:
    """(key, xent, n_words, n_oov) with xent = -log10 P / n_words (null for an empty segment)."""
    s = lm_score(df, model, col, key, order)
    return s.select(key, _per_word("logprob").alias("xent"), "n_words", "n_oov")


def _per_word(logprob: str) -> Column:
    return F.when(F.col("n_words") > 0, -F.col(logprob) / F.col("n_words"))


ROUND_DOWN = 1e-4  # |ced| below this becomes 0 (the reference's "round down scientific notation")


def ced(pool: DataFrame, pos_model: DataFrame, neg_model: DataFrame, col: str = "text", key: str = "line_no",
        order: int = 5) -> DataFrame:
    """ced = xent(pos) - xent(neg) per segment; tiny values become 0, an empty segment has a null
    ced.  Both models are looked up in one pass, so id and word count (J2) agree by construction."""
    s = score_segments(pool, [pos_model, neg_model], col, key, order)
    d = _per_word("logprob0") - _per_word("logprob1")
    return s.select(key, F.when(F.abs(d) < ROUND_DOWN, F.lit(0.0)).otherwise(d).alias("ced"), "n_words")
