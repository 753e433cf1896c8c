"""Operator 9: HTML extraction with a linear-chain conditional random field over DOM leaf blocks.

Each leaf block of a page has the label main text or other.  Its features are its ancestors' tags,
the words of their class, id and role, and the shape of its text; neighbouring labels have weights
of their own.  The weights are fitted on labelled pages by gradient ascent on the conditional
likelihood (forward-backward over all pages at once); pages are decoded by Viterbi, and the blocks
of main text are joined in page order.

Null and empty pages give an empty text; a page without tags is one block.  Repeated rows are
extracted one by one.  Columns besides page_id, url and html are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom_blocks import Block, leaf_blocks
from .labelled_pages import labelled_pages

TRAINING_PAGES, STEPS, DECAY = 1000, 150, 1e-4
SLICE = 64  # pages decoded together
PARTS = frozenset("article main section nav header footer aside form dialog fieldset ins table blockquote figure".split())


def _step(x: float, *ends: float) -> int:
    return sum(x >= e for e in ends)


def features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    out = {"bias", f"tag:{block.tags[-1] if block.tags else ''}"}
    out.update(f"in:{t}" for t in block.tags)
    out.update(f"name:{x}" for x in block.names)
    out.update(f"near:{x}" for x in block.nearest)
    part = next((t for t in reversed(block.tags) if t in PARTS), "")
    out.add(f"part:{part}")
    if not block.names and not part:
        out.add("unnamed")
    out.add(f"words:{_step(words, 2, 4, 8, 15, 30, 60)}")
    out.add(f"linked:{_step(block.linked / n, 0.05, 0.3, 0.6, 0.9)}")
    out.add(f"end:{text[-1] in '.!?:;…'}")
    out.add(f"stops:{_step(sum(text.count(c) for c in '.!?'), 1, 2, 5)}")
    if "©" in text or "copyright" in text[:40].lower():
        out.add("copyright")
    if "·" in text or "|" in text:
        out.add("divided")
    return list(out)


class BlockCRF:
    """Feature weights for label 1 (main text) against 0, and weights of neighbouring labels."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, ends: np.ndarray):
        self.weights, self.transitions, self.ends = weights, transitions, ends

    @classmethod
    def fit(cls, pages: list[str], steps: int = STEPS) -> BlockCRF:
        chains = [[b for b in leaf_blocks(p) if b.label is not None] for p in pages]
        chains = [c for c in chains if c]
        number: dict[str, int] = {}
        ids, begin = [], [0]
        for chain in chains:
            for b in chain:
                ids += [number.setdefault(f, len(number)) for f in features(b)]
                begin.append(len(ids))
        ids, begin = np.array(ids), np.array(begin)
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        y = np.array([int(b.label) for c in chains for b in c])
        length = np.array([len(c) for c in chains])
        most = length.max()
        first = np.cumsum(length) - length
        inside = np.arange(most) < length[:, None]
        at = np.where(inside, first[:, None] + np.arange(most), 0)
        w, trans, ends = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
        # wanted: how often labels follow each other, and start a page, in the labelled pages
        pair = inside[:, 1:]
        seen = np.array([[((y[at[:, :-1]] == a) & (y[at[:, 1:]] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)])
        start = np.array([(y[first] == a).sum() for a in (0, 1)])
        m = [np.zeros_like(w), np.zeros_like(trans), np.zeros_like(ends)]
        v = [x.copy() for x in m]
        for step in range(1, steps + 1):
            z = np.bincount(owner, w[ids], len(y))
            emit = np.zeros((len(length), most, 2))
            emit[:, :, 1] = np.where(inside, z[at], 0)
            forward, backward = np.zeros_like(emit), np.zeros_like(emit)
            forward[:, 0] = emit[:, 0] + ends
            for t in range(1, most):
                new = np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, axis=1) + emit[:, t]
                forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
            for t in range(most - 2, -1, -1):
                new = np.logaddexp.reduce(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
            whole = np.logaddexp.reduce(forward[:, -1], axis=1)
            one = np.exp(forward + backward - whole[:, None, None])
            p = one[:, :, 1][inside]
            both = np.exp(forward[:, :-1, :, None] + trans + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None])
            grads = [np.bincount(ids, (y - p)[owner], len(w)) / len(y) - DECAY * w, (seen - both[pair].sum(axis=0)) / len(y), (start - one[:, 0].sum(axis=0)) / len(y)]
            for k, x in enumerate((w, trans, ends)):
                m[k] += 0.1 * (grads[k] - m[k])
                v[k] += 0.01 * (grads[k] ** 2 - v[k])
                x += 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-5)
        return cls(dict(zip(number, w.tolist())), trans, ends)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of one page, by Viterbi."""
        if not blocks:
            return []
        (a, b), (c, d) = self.transitions.tolist()
        known, back = self.weights, []
        zero, one = self.ends.tolist()
        one += sum(known.get(f, 0.0) for f in features(blocks[0]))
        for block in blocks[1:]:
            z = sum(known.get(f, 0.0) for f in features(block))
            back.append((zero + a < one + c, zero + b < one + d))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + z
        label = int(one > zero)
        out = [label]
        for x in reversed(back):
            label = int(x[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n\n".join(b.text for b, y in zip(blocks, self.decode(blocks)) if y)


def train_blocks(n: int = TRAINING_PAGES) -> BlockCRF:
    """The model of n labelled pages: small and of fixed size."""
    return BlockCRF.fit(labelled_pages(n))


def extract_text(pages: DataFrame, model: BlockCRF | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; one pass over the pages without a shuffle."""
    given = pages.sparkSession.sparkContext.broadcast(model or train_blocks())

    def run(batches):
        crf = given.value
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = batch.slice(a, SLICE)
                texts = [crf.extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
