"""Dictionary-coded text columns: rows in packs, each with the list of its distinct words.

Looking words up in a table (casing, vocabulary, merges) needs no row per occurrence: a pack of
`PACK_TOKENS` tokens or so becomes one row that holds its distinct words, its rows, and for every
token the place of its word in that list.  Only the distinct words meet the table, in a join; the
results come back to the pack as an array in the same order, and the rows read them by place.  A
word that stands in every line costs one row a pack, so it is no hot key.

Packs are cut where the input's partitions hold them: coding shuffles nothing.
"""
from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..caches import keep

PACK_TOKENS = 1 << 16  # a longer row is a pack of its own
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")  # what `tokens` splits at


def _pack(n_cols: int):
    """Rows -> (pack, words, rows): `rows` has the other columns and the codes of the text."""

    def packed(part: list[pa.RecordBatch], codes: list[list[int]], words: dict) -> pa.RecordBatch:
        table = pa.Table.from_batches(part).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:n_cols]]
        columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        rows = pa.StructArray.from_arrays([*columns, pa.array(codes, pa.list_(pa.int32()))], names=[f"c{i}" for i in range(n_cols)] + ["codes"])
        return pa.RecordBatch.from_arrays(
            [pa.array([list(words)], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)],
            names=["_words", "_rows"])

    def run(batches):
        part, codes, words, n = [], [], {}, 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(n_cols).to_pylist()):
                own = [words.setdefault(w, len(words)) for w in _SPACE.split(text) if w] if text is not None else None
                codes.append(own)
                n += len(own or ())
                if n >= PACK_TOKENS:
                    part.append(batch.slice(first, i + 1 - first))
                    yield packed(part, codes, words)
                    part, codes, words, n, first = [], [], {}, 0, i + 1
            if first < batch.num_rows:
                part.append(batch.slice(first))
        if part:
            yield packed(part, codes, words)

    return run


def coded(df: DataFrame, col: str) -> DataFrame:
    """(_pack, _words ARRAY<STRING>, _rows ARRAY<STRUCT<c0, c1, ..., codes ARRAY<INT>>>), read twice by what follows."""
    others = [c for c in df.columns if c != col]
    fields = "".join(f"c{i}: {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    schema = f"_words array<string>, _rows array<struct<{fields}codes: array<int>>>"
    packs = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{col}`").cast("string").alias("text"))
    return keep(packs.mapInArrow(_pack(len(others)), schema).withColumn("_pack", F.monotonically_increasing_id()))


def looked_up(packs: DataFrame, table: DataFrame, word: str = "word", value: str = "seg") -> DataFrame:
    """packs with `_values`: for each word of a pack its value in `table` (word, value), null where it has none."""
    entries = packs.select("_pack", F.posexplode("_words").alias("_i", "_w"))
    known = table.select(F.col(word).alias("_w"), F.col(value).alias("_v"))
    found = entries.join(known, "_w", "left").groupBy("_pack").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_f"))
    found = found.select("_pack", F.transform("_f", lambda x: x["_v"]).alias("_values"))
    return packs.join(found, "_pack", "left")


def rows_of(found: DataFrame, others: list[str], make, schema: str) -> DataFrame:
    """The rows of the packs: their columns `others`, and what `make(codes, words, values)` gives for them.

    make gets Arrow arrays: a list of places for each row (null for a null text), and the pack's words and values.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, words = batch.column(0)[i].values, batch.column(1)[i].values
                values = batch.column(2)[i].values
                values = pa.nulls(0) if values is None else values  # a pack without words
                own = {c: rows.field(f"c{j}") for j, c in enumerate(others)} | make(rows.field("codes"), words, values)
                yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    kind = found.schema["_rows"].dataType.elementType
    fields = [f"`{c}` {kind[f'c{j}'].dataType.simpleString()}" for j, c in enumerate(others)]
    return found.select("_rows", "_words", "_values").mapInArrow(run, ", ".join([*fields, schema]))


def _joined(default: bool, name: str):
    def make(codes, words, values):
        flat = pc.list_flatten(codes)
        if not len(flat):
            return {name: pa.array([""] * len(codes), pa.string())}
        out = pc.coalesce(values, words) if default else values
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(codes), 0).to_numpy())]), pa.int32()), out.take(flat))
        return {name: pc.fill_null(pc.binary_join(lists, " "), "")}

    return make


def recoded(df: DataFrame, col: str, table_of: Callable[[DataFrame], DataFrame], default: bool = False) -> DataFrame:
    """df with every word of `col` replaced by its value, single spaces between them.

    `table_of` gets the distinct words (word STRING) and returns (word, seg).  A null text becomes
    ''.  With `default` a word without a value stays as it is.
    """
    packs = coded(df, col)
    words = packs.select(F.explode("_words").alias("word")).distinct()
    found = looked_up(packs, table_of(words))
    others = [c for c in df.columns if c != col]
    return rows_of(found, others, _joined(default, col), f"`{col}` string").select(*[F.col(f"`{c}`") for c in df.columns])
