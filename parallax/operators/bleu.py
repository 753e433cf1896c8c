"""Corpus BLEU over a grid of systems, and run statistics.

BLEU (Papineni et al. 2002), no smoothing: per group and n = 1..4,
num = sum over segments of min(count_hyp(g), max over references count_ref(g)),
den = sum of hypothesis n-grams; c = hypothesis length, r = sum over segments of the
closest reference length (ties -> shorter); BP = 1 if c >= r else exp(1 - r/c);
BLEU = 100 * BP * exp(mean log(num/den)), 0 when any num is 0.

Outputs and references are read once: a segment's hypothesis and references meet in one row (one
shuffle of segment rows), and a task counts the n-grams of a block of segments in integer arrays.
That gives the segment table: for every test variant (all or some references, cased or lower-cased)
the clipped counts and lengths of each segment.  The grid, whose loops are group keys, and the
run statistics are sums over it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_N = 4
BLOCK_TOKENS = 1 << 18  # tokens that are counted together; a segment with more is a block of its own
COUNTS = [f"{x}{n}" for n in range(1, MAX_N + 1) for x in ("num", "den")]


_B = np.arange(256)
_INSIDE = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))  # bytes of words: the white space of `tokens` is left out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as word numbers: text t has the words first[t] .. first[t + 1]."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(texts) else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inside = _INSIDE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offs[offs < len(data)]
    begin[edge] = inside[edge]  # a word ends with its text
    at = np.flatnonzero(begin)
    letters = np.concatenate([[0], np.cumsum(inside)])
    cut = np.append(letters[at], letters[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return _codes(words), np.searchsorted(at, offs)


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return pc.is_in(pa.array(x), value_set=pa.array(y)).to_numpy(zero_copy_only=False)


def _statistics(hyp_row: np.ndarray, ref_row: np.ndarray, word: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> dict:
    """Counts of each hypothesis against the references of its row that are wanted; the texts of the
    hypotheses stand before those of the references.

    An n-gram is looked at only where both (n - 1)-grams in it stand in a hypothesis and in a reference of the row."""
    n, length = len(hyp_row), np.diff(first)
    hl, rl = length[:n], length[n:]
    text = np.repeat(np.arange(len(length)), length)
    row, ref = np.concatenate([hyp_row, ref_row])[text], text >= n
    place = np.arange(len(word)) - first[text]
    alive = np.concatenate([np.ones(n, bool), wanted])[text]
    size = max(len(word), 1)  # codes are smaller
    code = word
    out = {}
    for k in range(1, MAX_N + 1):
        at = np.flatnonzero(alive & (place >= k - 1))
        if k > 1:
            at = at[alive[at - 1]]
            longer = np.zeros(len(word), np.int64)
            longer[at] = _codes(pa.array(code[at - 1] * size + word[at]))
            code = longer
        gram = row[at] * size + code[at]
        mine = ~ref[at]
        both = np.zeros(len(at), bool)
        both[mine], both[~mine] = _among(gram[mine], gram[~mine]), _among(gram[~mine], gram[mine])
        at, gram, mine = at[both], gram[both], mine[both]
        alive = np.zeros(len(word), bool)
        alive[at] = True
        # the most that any one reference of the row has of a gram
        key, count = np.unique(text[at[~mine]] * size + code[at[~mine]], return_counts=True)
        key, which = np.unique(ref_row[key // size - n] * size + key % size, return_inverse=True)
        most = np.zeros(len(key), np.int64)
        np.maximum.at(most, which, count)
        own, count = np.unique(text[at[mine]] * size + code[at[mine]], return_counts=True)
        clipped = np.minimum(count, most[np.searchsorted(key, hyp_row[own // size] * size + own % size)])
        out[f"num{k}"] = np.bincount(own // size, clipped, n).astype(np.int64)
        out[f"den{k}"] = np.maximum(hl - k + 1, 0)
    # the closest reference length, the shorter of two
    left, right = np.searchsorted(ref_row, hyp_row, "left"), np.searchsorted(ref_row, hyp_row, "right")
    hyp = np.repeat(np.arange(n), right - left)
    ref = np.arange(len(hyp)) - np.repeat(np.cumsum(right - left) - right, right - left)
    hyp, ref = hyp[wanted[ref]], ref[wanted[ref]]
    order = np.lexsort((rl[ref], np.abs(rl[ref] - hl[hyp]), hyp))
    best, at = np.unique(hyp[order], return_index=True)
    closest = np.zeros(n, np.int64)
    closest[best] = rl[ref[order[at]]]
    scored = np.zeros(n, bool)
    scored[best] = True
    return out | {"hl": hl, "rl": closest, "scored": scored}


def _side(rows: pa.Table, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """(row, value) of all values of a list column."""
    lists = rows.column(name).combine_chunks()
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), lists.flatten()


def _segments(names: list[str], tests: list[tuple]):
    def block(batch: pa.RecordBatch, lo: int, hi: int):
        part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
        (hyp_row, hyps), (ref_row, refs) = _side(part, "_hyps"), _side(part, "_refs")
        no = refs.field("no")
        coded = {}
        for name, numbers, lower in tests:
            text = "l" if lower else "x"
            if text not in coded:
                coded[text] = _words(pa.concat_arrays([hyps.field(text), refs.field(text)]))
            wanted = np.ones(len(refs), bool) if numbers is None else pc.is_in(no, value_set=pa.array(sorted(numbers), no.type)).to_numpy(zero_copy_only=False)
            out = _statistics(hyp_row, ref_row, *coded[text], wanted)
            out["scored"] &= hyps.field(text).is_valid().to_numpy(zero_copy_only=False)
            own = part.select(names).take(pa.array(hyp_row))
            columns = [c.combine_chunks() for c in own.columns]
            kinds = {"scored": pa.bool_()}
            columns += [pa.array([name] * len(hyps), pa.string())] + [pa.array(out[c]).cast(kinds.get(c, pa.int64())) for c in ("scored", "hl", "rl", *COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "test_id", "scored", "hl", "rl", *COUNTS])

    def run(batches):
        for batch in batches:
            size = np.cumsum([0, *batch.column("_size").to_pylist()])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + 4 * BLOCK_TOKENS, "right")) - 1)  # four bytes a token, about
                yield from block(batch, lo, hi)
                lo = hi

    return run


def segment_statistics(hyps: DataFrame, refs: DataFrame, keys: list[str], tests: dict[str, tuple], seg: str = "seg_id",
                       hyp: str = "hyp", ref: str = "ref", ref_no: str = "ref_no") -> DataFrame:
    """One row for each hypothesis and test: keys, seg, test_id, scored, hl, rl, num1..4, den1..4.

    `tests` has for each test_id (reference numbers or None for all, lower-cased or not).  Every reference
    counts, whatever its number.  A hypothesis that is null or has no reference is not `scored`; each of
    several hypotheses of a segment is scored by itself.
    """
    sk = [*keys, seg]
    kinds = sorted({"l" if low else "x" for _, low in tests.values()})  # only the texts that a test needs are moved
    texts = lambda c: [(F.col(c).cast("string") if x == "x" else F.lower(F.col(c))).alias(x) for x in kinds]
    no = F.col(ref_no).cast("string")
    one = refs.filter(F.col(ref).isNotNull()).select(*sk, F.struct(no.alias("no"), *texts(ref)).alias("_ref"))
    one = one.withColumn("_hyp", F.lit(None).cast(f"struct<{','.join(f'{x}:string' for x in kinds)}>"))
    rows = hyps.select(*sk, F.lit(None).cast(one.schema["_ref"].dataType).alias("_ref"), F.struct(*texts(hyp)).alias("_hyp"))
    rows = rows.unionByName(one)
    size = F.coalesce(F.length(F.coalesce(f"_ref.{kinds[0]}", f"_hyp.{kinds[0]}")), F.lit(0)) + 8
    # collect_list leaves out the side that a row does not have
    met = rows.groupBy(*sk).agg(F.collect_list("_hyp").alias("_hyps"), F.collect_list("_ref").alias("_refs"), F.sum(size).alias("_size"))
    met = met.filter(F.size("_hyps") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema if f.name in sk)
    schema += ", test_id string, scored boolean, hl long, rl long, " + ", ".join(f"{c} long" for c in COUNTS)
    given = [(name, None if numbers is None else {str(x) for x in numbers}, low) for name, (numbers, low) in tests.items()]
    order = [f.name for f in met.schema if f.name in sk]
    return met.mapInArrow(_segments(order, given), schema)


def _bleu_of(segments: DataFrame, keys: list[str]) -> DataFrame:
    scored = F.col("scored")
    total = lambda x: F.coalesce(F.sum(F.when(scored, F.col(x))), F.lit(0)).cast("bigint")
    out = segments.groupBy(*keys).agg(total("hl").alias("c"), total("rl").alias("r"), F.count_if(~scored).alias("n_unscored"),
                                      *[total(x).alias(x) for x in COUNTS])
    c, rr = F.col("c"), F.col("r")
    bp = F.when(c >= rr, F.lit(1.0)).when(c > 0, F.exp(F.lit(1.0) - F.try_divide(rr, c))).otherwise(F.lit(0.0))
    logs = [F.log(F.try_divide(F.col(f"num{n}"), F.col(f"den{n}"))) for n in range(1, MAX_N + 1)]
    any_zero = F.least(*[F.col(f"num{n}") for n in range(1, MAX_N + 1)]) == 0
    score = F.when(any_zero, F.lit(0.0)).otherwise(F.lit(100.0) * bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4))
    return out.withColumns({"bp": bp, "bleu": F.round(score, 2), "bleu_raw": score})


def corpus_bleu(hyps: DataFrame, refs: DataFrame, keys: list[str], seg: str = "seg_id", hyp: str = "hyp",
                ref: str = "ref", ref_no: str = "ref_no", lower: bool = False) -> DataFrame:
    """One row per group `keys`: c, r, num1..4, den1..4, bp, bleu (2 decimals), bleu_raw, and
    n_unscored (null hypotheses and those without a reference).

    What is not scored is left out of lengths and n-grams alike; a group of such hypotheses keeps its
    row, with c = 0 and bleu = 0.
    """
    return _bleu_of(segment_statistics(hyps, refs, keys, {"all": (None, lower)}, seg, hyp, ref, ref_no), keys)


def evaluation_grid(outputs: DataFrame, refs: DataFrame, keys: list[str], tests: dict[str, tuple] | None = None, seg: str = "seg_id",
                    hyp: str = "hyp", ref: str = "ref", ref_no: str = "ref_no", lower: bool = False) -> DataFrame:
    """BLEU for every group of the grid (e.g. ckpt metric x test x model) in one job.

    With `tests` every group is scored under each test variant too (a key `test_id`), from one pass
    over outputs and references.
    """
    segments = segment_statistics(outputs, refs, keys, tests or {"all": (None, lower)}, seg, hyp, ref, ref_no)
    return _bleu_of(segments, [*keys, "test_id"] if tests else keys)


def run_statistics(metrics: DataFrame, keys: list[str], value: str = "bleu") -> DataFrame:
    """A6 [H]: mean, sample std, min, max of a metric over runs."""
    v = F.col(value)
    return metrics.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(F.lit(1)).alias("runs"),
    )
