"""Operator 6: license scan by diagonal voting.

Every rolling word k-gram of every text is hashed and joined in Spark with the positions of the
license templates (a small fixed table, broadcast).  A hit votes for the diagonal word position -
template position of its template.  A phrase of exact words is found where its diagonal has a vote
for each of its k-grams.  For whole notices, the votes of a text and template form groups of
neighbouring diagonals (inserted or missing words), however their words interleave with other votes,
and every stretch of a group that isn't much longer than the template is verified: the
template positions that it covers must reach MIN_COVER of the template.  Of stretches that overlap
the best is the span: it covers most, or else its length is nearest to the template's.

Null and empty texts have no words and no labels.  Rows that repeat a doc_id and text get the same
result; rows that share a doc_id only are told apart by a hash of their text.  Columns besides
doc_id and text are not read.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER, Words, column_bytes, rolling, row_slices, windows

K = 2
GAP, SLIDE = 12, 6  # words between the votes of one span; words that may be inserted or missing
MIN_COVER, MOST_LONG = 0.75, 1.5
NO_ID = -(1 << 63)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words, before small letters are made

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of well-known license notices.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _grams(text: pa.Array, lo: int, hi: int, data, offs, k: int):
    words = Words(LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], ALNUM_WORDS)
    row, at = windows(words.first, k)
    return row, at - words.first[row], rolling(words.hashes(), at, at + k).astype(np.int64)


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    """(h, template, label, exact, place, grams): the k-grams of phrases and notices."""
    rows = []
    every = [(label, p, True) for p, label in PHRASES.items()] + [(label, t, False) for label, t in NOTICES]
    for number, (label, text, exact) in enumerate(every):
        data, offs = column_bytes(pa.array([" ".join(words_of(text))]))
        _, place, h = _grams(None, 0, 1, data, offs, k)
        if len(h) > 64:
            raise ValueError(f"more than 64 k-grams, the bits of a number: {text}")
        rows += [(int(x), number, label, exact, int(p), len(h)) for p, x in zip(place, h)]
    return spark.createDataFrame(rows, "h long, template int, label string, exact boolean, place int, grams int")


def rolling_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_key, word, h) of every k-gram of docs(doc_id, text, text_key)."""

    def run(batches):
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in row_slices(offs):
                row, at, h = _grams(None, lo, hi, data, offs, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][row]), pa.array(keys[lo:hi][row]), pa.array(at.astype(np.int32)), pa.array(h)],
                                                 names=["doc_id", "text_key", "word", "h"])

    return docs.mapInArrow(run, "doc_id long, text_key long, word int, h long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def _longest(n_words):
    """Words of the longest span of a notice of n words."""
    return n_words * MOST_LONG + 2


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, label, exact, begin, end, score): places of phrases and verified notices,
    in words from 0; a null doc_id is NO_ID here."""
    spark = docs.sparkSession
    hits = rolling_grams(_keyed(docs)).join(F.broadcast(templates(spark)), "h")
    votes = hits.withColumn("diagonal", F.col("word") - F.col("place")).groupBy(
        "doc_id", "text_key", "template", "label", "exact", "grams", "diagonal").agg(
        F.expr("bit_or(shiftleft(1L, place))").alias("places"), F.min("word").alias("first"), F.max("word").alias("last"))
    share = lambda c: F.bit_count(c) / F.col("grams")
    phrases = votes.filter("exact AND bit_count(places) = grams").select(
        "doc_id", "text_key", "label", "exact", F.col("diagonal").alias("begin"), (F.col("last") + K).alias("end"), F.lit(1.0).alias("score"))

    own = ["doc_id", "text_key", "template"]
    notices = votes.filter("NOT exact").withColumn("all", F.bit_or("places").over(Window.partitionBy(*own))).filter(share(F.col("all")) >= MIN_COVER)
    by_word = Window.partitionBy(*own).orderBy("first", "diagonal")  # the votes of one text and template
    before = F.max("last").over(by_word.rowsBetween(Window.unboundedPreceding, -1))
    notices = notices.withColumn("new", F.coalesce(F.col("first") - before > GAP, F.lit(True)).cast("int")).withColumn("region", F.sum("new").over(by_word))
    by_diagonal = Window.partitionBy(*own, "region").orderBy("diagonal")
    slide = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    notices = notices.withColumn("new", F.coalesce(slide > SLIDE, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(by_diagonal))

    group = [*own, "region", "group"]
    place = F.explode(F.expr("filter(sequence(0, grams - 1), p -> getbit(places, p) = 1)"))
    words = notices.select(*group, "label", "exact", "grams", "diagonal", place.alias("place")).groupBy(
        *group, "label", "exact", "grams", (F.col("diagonal") + F.col("place")).alias("begin")).agg(F.expr("bit_or(shiftleft(1L, place))").alias("places"))
    near = Window.partitionBy(*group).orderBy("begin")
    most = int(max(_longest(len(words_of(t))) for _, t in NOTICES))
    ahead = F.collect_list(F.struct("begin", "places")).over(near.rangeBetween(0, most))
    fits = F.filter("ahead", lambda x: x["begin"] + K - F.col("begin") <= _longest(F.col("grams") + K - 1))
    put = lambda places, end: F.struct(places.alias("places"), end.alias("end"))
    cover = F.aggregate(fits, put(F.lit(0).cast("long"), F.col("begin") + K), lambda s, x: F.when(
        x["places"].bitwiseOR(s["places"]) != s["places"], put(x["places"].bitwiseOR(s["places"]), x["begin"] + K)).otherwise(s))
    spans = words.withColumn("ahead", ahead).withColumn("cover", cover).select(
        *group, "label", "exact", "grams", "begin", F.col("cover.end").alias("end"), share(F.col("cover.places")).alias("score")).filter(F.col("score") >= MIN_COVER)
    others = F.collect_list(F.struct("begin", "end", "score")).over(near.rangeBetween(-most, most))
    rank = lambda begin, end, score: F.struct(score, -F.abs(end - begin - F.col("grams") - K + 1), -begin)
    beaten = F.exists("others", lambda x: (x["begin"] < F.col("end")) & (x["end"] > F.col("begin")) & (
        rank(x["begin"], x["end"], x["score"]) > rank(F.col("begin"), F.col("end"), F.col("score"))))
    spans = spans.withColumn("others", others).filter(~beaten)
    return phrases.union(spans.select("doc_id", "text_key", "label", "exact", "begin", "end", "score"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): base
    columns count the phrases only; labels has the notices too; spans are sorted."""
    spans = license_spans(docs)
    places = F.when(F.col("exact"), F.col("begin"))
    found = spans.groupBy("doc_id", "text_key").agg(
        F.count(places).alias("n_base"), F.min(places).cast("long").alias("first_word"), F.max(places).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("score").alias("score"),
        F.sort_array(F.collect_set(F.struct("begin", "end", "label", "score"))).alias("spans"))
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    rows = _keyed(docs).select("doc_id", "text_key", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(RAW_WORD)).cast("long").alias("n_words"))
    return rows.join(found, ["doc_id", "text_key"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
