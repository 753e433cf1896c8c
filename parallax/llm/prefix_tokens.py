"""Operator 7: token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A byte-level BPE encoding is the one chain of vocabulary tokens in which every neighbouring pair
is *stable*: encoding the two tokens' bytes together gives these two tokens again.  So the last
token of each prefix follows from those of shorter prefixes, and one pass over a piece stores the
exact token count of every prefix.  A text's table is the running sum over its chunks (a chunk
ends where a single space stands between two other characters; no token reaches over that
place), and truncation or budget questions read the table without encoding again.

Null and empty texts have 0 tokens.  Repeated rows are counted one by one; other columns are
never read.  Chunks and stable pairs are remembered in each Python worker, up to fixed numbers of
entries; the memory is emptied when full, which changes no result.
"""
from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, row_slices

REMEMBERED = 1_500_000
LEARN_BYTES = 1 << 24  # text whose new chunks are learnt together

#: Fixed value: the piece pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK_EDGE = re.compile(r"(?<=\S) (?=\S)")
SPACE_RUN = re.compile(r" \s|\s |\A\s|\s\Z")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are
    themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of every prefix, for a byte-level BPE `tokenizer.json` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        ids = {bytes([b]): b for b in range(256)}  # a token's number: its byte, or 256 + its merge's rank
        self.left, self.right = list(range(256)), list(range(256))
        self.join: dict[int, int] = {}
        for m in model["model"]["merges"]:
            a, b = map(plain, m if isinstance(m, list) else m.split(" "))
            self.join[ids[a] << 32 | ids[b]] = len(self.left)
            ids.setdefault(a + b, len(self.left))
            self.left.append(ids[a])
            self.right.append(ids[b])
        self.step: dict[int, int] = {}  # trie of the reversed tokens: node << 8 | byte -> node
        self.token_at: list[int] = [-1]
        for t, number in ids.items():
            node = 0
            for x in reversed(t):
                if (node << 8 | x) not in self.step:
                    self.step[node << 8 | x] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.step[node << 8 | x]
            self.token_at[node] = number
        self.stable: dict[int, bool] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """BPE by the definition: the best-ranked neighbouring pair is merged until none is left."""
        parts = list(data)
        while len(parts) > 1:
            rank, at = min((self.join.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [rank]
        return parts

    def is_stable(self, a: int, b: int) -> bool:
        """Whether no merge over the border comes before the merges that built a and b: the later
        of the two tokens is taken apart, step by step, and the parts at the border are tried."""
        known = self.stable.get(a << 32 | b)
        if known is not None:
            return known
        if len(self.stable) >= REMEMBERED:
            self.stable.clear()
        x, y, before, known = a, b, 1 << 60, True
        while known:
            known = not self.join.get(x << 32 | y, 1 << 60) < before
            if x < 256 and y < 256:
                break
            if x > y:  # x was built later: until then its right part stood at the border
                x, before = self.right[x], x
            else:  # with equal ranks the left place is merged first
                y, before = self.left[y], y + 1
        self.stable[a << 32 | b] = known
        return known

    def _extend(self, piece: bytes, last: list[int], counts: list[int]) -> None:
        """Fill the tables of a piece from len(last) - 1 bytes on: each prefix ends with the one
        token that is stable behind the prefix before it."""
        step, token_at, stable = self.step, self.token_at, self.stable
        for end in range(len(last), len(piece) + 1):
            node, begin = 0, end
            while begin:
                begin -= 1
                node = step.get(node << 8 | piece[begin])
                if node is None:
                    begin = -1
                    break
                t = token_at[node]
                if t >= 0:
                    if not begin:
                        break
                    ok = stable.get(last[begin] << 32 | t)
                    if ok is None:
                        ok = self.is_stable(last[begin], t)
                    if ok:
                        break
            if begin < 0 or token_at[node] < 0:  # no chain: not the case for a regular vocabulary
                parts = self.merged(piece[:end])
                last.append(parts[-1])
                counts.append(len(parts))
            else:
                last.append(t)
                counts.append(counts[begin] + 1)

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """counts[i] = tokens of piece[:i], for i in 0..len(piece)."""
        last, counts = [-1], [0]
        self._extend(piece, last, counts)
        return counts

    def piece_counts(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """Tokens of each piece.  In sorted order a piece goes on from the prefix that it shares
        with the one before it, whose table is there already."""
        found, last, counts, before = {}, [-1], [0], b""
        for piece in sorted(pieces):
            same = 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            self._extend(piece, last, counts)
            found[piece] = counts[-1]
            before = piece
        return found

    @staticmethod
    def pieces(chunk: str) -> list[str]:
        word = chunk[1:]
        if chunk[:1] == " " and word.isalpha():
            return [chunk]
        if chunk[:1] == " " and word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], word[-1]]
        return PIECES.findall(chunk)

    def _learn(self, chunks: Iterable[str]) -> None:
        """Remember the counts of new chunks."""
        split = {c: [p.encode("utf-8", "surrogatepass") for p in self.pieces(c)] for c in chunks}
        known = self.piece_counts({p for ps in split.values() for p in ps})
        if len(self.chunks) + len(split) > REMEMBERED:
            self.chunks.clear()
        for c, ps in split.items():
            self.chunks[c] = sum(known[p] for p in ps)

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.special is None:
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    @staticmethod
    def _chunks(segment: str) -> list[str]:
        """The segment cut before each space that has other characters on both sides."""
        if not segment:
            return []
        parts = CHUNK_EDGE.split(segment) if SPACE_RUN.search(segment) else segment.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def counts(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text; the chunks that are new in a batch are learnt together."""
        totals, new, waiting = [], set(), []
        for text in texts:
            total = 0
            for segment, special in self._segments(text):
                if special:
                    total += 1
                    continue
                chunks = self._chunks(segment)
                found = list(map(self.chunks.get, chunks))
                if None in found:
                    missing = [c for c, n in zip(chunks, found) if n is None]
                    new.update(missing)
                    waiting.append((len(totals), missing))
                    total += sum(n for n in found if n is not None)
                else:
                    total += sum(found)
            totals.append(total)
        if new:
            self._learn(new)
        for row, missing in waiting:
            totals[row] += sum(map(self.chunks.__getitem__, missing))
        return totals

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Counts at every prefix of one text, in characters."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.start, self.total, self.special = [], [0], []
        at = 0
        for segment, special in counter._segments(text):
            for c in [segment] if special else counter._chunks(segment):
                self.start.append(at)
                self.special.append(special)
                self.total.append(self.total[-1] + (1 if special else counter.count(c)))
                at += len(c)

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        if chars <= 0 or not self.start:
            return 0
        if chars >= len(self.text):
            return self.total[-1]
        j = bisect_right(self.start, chars - 1) - 1
        while self.special[j] and j + 1 < len(self.start) and self.start[j + 1] == self.start[j]:
            j += 1
        part = self.text[self.start[j] : chars]
        if self.special[j]:  # a cut special string is ordinary text that may join what stands before
            k = j - 1 if j and not self.special[j - 1] else j
            return self.total[k] + self.counter.count(self.text[self.start[k] : chars])
        return self.total[j] + self.counter.count(part)

    def fits(self, budget: int) -> bool:
        return self.total[-1] <= budget

    def truncate(self, budget: int) -> int:
        """The most characters whose prefix has `budget` tokens at most."""
        if self.total[-1] <= budget:
            return len(self.text)
        j = bisect_right(self.total, budget) - 1
        end = self.start[j + 1] if j + 1 < len(self.start) else len(self.text)
        return next(i for i in range(end, -1, -1) if self.count(i) <= budget)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_for(path: str) -> PrefixCounter:
    """One counter for each file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; no shuffle, one pass over the texts."""

    def run(batches):
        counter = counter_for(path)
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            tokens = np.zeros(len(batch), np.int64)
            for lo, hi in row_slices(offs, LEARN_BYTES):
                tokens[lo:hi] = counter.counts(t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist())
            size = np.diff(offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
