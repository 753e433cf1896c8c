"""Operator 5: quality classifier, a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of CHUNK bytes that cover it whole.  Learned byte vectors and
learned filters (WIDTH bytes, every STRIDE bytes) are max-pooled over each chunk; a small hidden
layer gives the chunk's log-odds, and their mean by chunk length is the document's probability.
The model is fitted in one task on a bounded sample of labelled rows (`sample` documents, by a
hash of doc_id); scoring is one pass over all rows without a shuffle.

Null and empty texts are one chunk of zero bytes.  Repeated rows get equal scores.  Labels without
quality or without a document teach nothing; of repeated labels of a document the smallest holds;
without any labelled row every score is 0.5.  Columns besides doc_id and text are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, column_bytes, pack, row_slices, unpack

CHUNK, OVERLAP, WIDTH, STRIDE = 512, 32, 8, 4
VECTOR, FILTERS, HIDDEN = 4, 32, 16
SAMPLE, BATCH, RATE = 2000, 32, 0.006
STEPS, MOST_EPOCHS = 875, 60  # gradient steps in all; fewer where so many passes over the sample are done before
AT_ONCE = 1024  # chunks computed together
PLACES = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


def chunks_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each chunk, row, share of its row's bytes); zeros behind a text's end."""
    size = np.diff(offs)
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(size - OVERLAP) // step))
    row = np.repeat(np.arange(len(size)), n)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    left = np.minimum(size[row] - begin, CHUNK)
    at = (offs[:-1][row] + begin)[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < left[:, None]
    padded = np.append(data, np.zeros(1, np.uint8))
    x = padded[np.where(inside, at, len(data))]
    weight = np.maximum(left, 1).astype(np.float64)
    return x, row, weight / np.bincount(row, weight, len(size))[row]


class ByteCNN:
    """Parameters and passes; all arrays are float32."""

    SHAPES = {"E": (256, VECTOR), "W": (WIDTH * VECTOR, FILTERS), "b": (FILTERS,), "U": (FILTERS, HIDDEN), "u": (HIDDEN,), "v": (HIDDEN,), "c": (1,)}

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.standard_normal(s) * (0.5 if k == "E" else (1.5 / s[0]) ** 0.5)).astype(np.float32) if k in "EWUv" else np.zeros(s, np.float32)
                  for k, s in self.SHAPES.items()}

    def to_bytes(self) -> bytes:
        return pack(**{k: v.reshape(-1).astype(np.float32) if len(v.reshape(-1)) == 1024 else np.pad(v.reshape(-1), (0, 1024 - v.size)) for k, v in self.p.items()})

    @classmethod
    def from_bytes(cls, data: bytes) -> ByteCNN:
        model, table = cls(), unpack(data)
        for k, s in cls.SHAPES.items():
            model.p[k] = table.column(k).to_numpy()[: int(np.prod(s))].reshape(s).copy()
        return model

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = self.p["E"][x]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), len(PLACES), WIDTH * VECTOR), (s[0], s[1] * STRIDE, s[2]))

    def chunk_logits(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, out, n = self.p, [], len(x)
        if keep is None and n % AT_ONCE:
            # products of one shape only: their rounding depends on the shape, and a score must not depend on its batch
            x = np.concatenate([x, np.zeros((AT_ONCE - n % AT_ONCE, x.shape[1]), x.dtype)])
        for a in range(0, len(x), AT_ONCE):
            win = np.ascontiguousarray(self.windows(x[a : a + AT_ONCE]))
            act = (win.reshape(-1, WIDTH * VECTOR) @ p["W"]).reshape(len(win), len(PLACES), FILTERS)
            top = act.max(axis=1) + p["b"]
            pooled = np.maximum(top, 0)
            hidden = np.tanh(pooled @ p["U"] + p["u"])
            out.append(hidden @ p["v"] + p["c"])
            if keep is not None:
                keep.setdefault("parts", []).append((x[a : a + AT_ONCE], win, act.argmax(axis=1), top, pooled, hidden))
        return np.concatenate(out)[:n] if out else np.zeros(0, np.float32)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, row, weight = chunks_of(data, offs)
        z = np.bincount(row, weight * self.chunk_logits(x), len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x, row, weight, y) -> dict[str, np.ndarray]:
        keep: dict = {}
        z = np.bincount(row, weight * self.chunk_logits(x, keep), len(y))
        d = ((1 / (1 + np.exp(-z)) - y) / len(y))[row] * weight
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        at = 0
        for xs, win, arg, top, pooled, hidden in keep["parts"]:
            dz = d[at : at + len(xs)].astype(np.float32)
            at += len(xs)
            g["c"] += dz.sum()
            g["v"] += hidden.T @ dz
            dh = dz[:, None] * p["v"] * (1 - hidden**2)
            g["u"] += dh.sum(axis=0)
            g["U"] += pooled.T @ dh
            dt = (dh @ p["U"].T) * (top > 0)
            g["b"] += dt.sum(axis=0)
            best = win[np.arange(len(xs))[:, None], arg]  # chunk, filter, window values
            g["W"] += np.einsum("cf,cfk->kf", dt, best)
            de = (dt[:, :, None] * p["W"].T).reshape(-1, VECTOR)  # chunk, filter, byte of the window
            byte = xs[np.arange(len(xs))[:, None, None], (arg * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1)
            for k in range(VECTOR):
                g["E"][:, k] += np.bincount(byte, de[:, k], 256)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, seed: int = 2) -> None:
        """Adam over shuffled batches of whole documents."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        rate = min(max(float(y.mean()), 0.02), 0.98)
        self.p["c"][:] = np.log(rate / (1 - rate))
        epochs = min(MOST_EPOCHS, max(1, round(STEPS * BATCH / len(texts))))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
                x, row, weight = chunks_of(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), offs)
                step += 1
                for k, g in self.gradients(x, row, weight, y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    pace = RATE * (1 - epoch / epochs) + 1e-4
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def _train(batches):
    rows = [(i, (t or "").encode("utf-8", "surrogatepass"), y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns))]
    if rows:
        rows.sort()
        model = ByteCNN()
        model.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["model"])


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> ByteCNN | None:
    """The model of a bounded sample of labelled rows outside the held-out fold; None without rows."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(fold(F.col("doc_id"), folds) != 0).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows are broadcast and fitted
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    found = rows.repartition(1).mapInArrow(_train, "model binary").collect()
    return ByteCNN.from_bytes(found[0].model) if found else None


def score_quality(docs: DataFrame, model: ByteCNN | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., score) of each row; a carried column that is named doc_id or score comes
    back as <name>_carried."""
    docs, carry = apart(docs, carry, ("doc_id", "score"))
    given = docs.sparkSession.sparkContext.broadcast(model.to_bytes() if model else None)
    own = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *carry])])
    names = ["doc_id", *carry]

    def run(batches):
        net = ByteCNN.from_bytes(given.value) if given.value else None
        for batch in batches:
            data, offs = column_bytes(batch.column("text"))
            score = np.full(len(batch), 0.5)
            if net:
                for lo, hi in row_slices(offs):
                    score[lo:hi] = net.scores(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*names).schema)
    return own.mapInArrow(run, f"{schema}, score double")
