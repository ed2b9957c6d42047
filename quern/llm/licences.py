"""License scan by diagonal voting.

Every run of k words of every text is hashed and joined, in Spark, to the same
runs of the templates. A hit votes for its diagonal (place in the text less
place in the template): a faithful copy gathers all its votes on one diagonal,
an edited one on a few neighbouring diagonals, which are merged. Spans with
enough votes are then verified word by word against the template.

The template table is a parameter of known size (checked), so it is broadcast;
the texts' runs never leave their partition unless they hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textcode
from quern.llm.common import keyed_text

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that may appear with edits, as published by their stewards.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under the Creative Commons Attribution License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]

K = 2
#: A template is cut into parts of at most this many words, so that its votes fit one 64-bit mask.
PART_WORDS = 60
#: Diagonals this close are one span if they are of one template.
DRIFT = 3
#: Share of a template's runs that must vote before a span is verified, and its least similarity then.
MIN_VOTES, MIN_MATCH = 0.4, 0.75
#: Templates of so few words say too little when a word differs and must match in full.
SHORT_WORDS = 10
#: The template table may have this many runs at most, else it isn't broadcast.
MAX_RUNS = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    """Words of a text with A-Z lower-cased, other letters as they are."""
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def parts(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a phrase, words) of each part of each template."""
    out = [(label, True, words(phrase)) for phrase, label in phrases.items()]
    for label, text in templates:
        own = words(text)
        n = -(-len(own) // PART_WORDS)
        out += [(label, False, own[len(own) * i // n : len(own) * (i + 1) // n]) for i in range(n)]
    if any(len(x[2]) < K for x in out):
        raise ValueError(f"a template needs {K} words at least")
    if any(len(x[2]) > PART_WORDS for x in out):
        raise ValueError(f"a phrase has {PART_WORDS} words at most")
    return [(i, *x) for i, x in enumerate(out)]


def _runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs): hashes of all runs of K words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textcode.chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                own = textcode.grams(*textcode.word_hashes(part.column(2), textcode.ALNUM), K)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), textcode.list_column(*own)], ["doc_id", "text_key", "runs"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key bigint, runs array<bigint>")


def votes(docs: DataFrame, pieces: list) -> DataFrame:
    """(doc_id, text_key, part, diagonal, mask, low, high): which runs of a template part hit, by diagonal."""
    rows = []
    for number, _, _, own in pieces:
        hashes, places = textcode.word_hashes(pa.array([" ".join(own)]), textcode.ALNUM)
        rows += [(number, at, h) for at, h in enumerate(textcode.grams(hashes, places, K)[0].view(np.int64).tolist())]
    table = docs.sparkSession.createDataFrame(rows, "part int, at int, run bigint")
    if len(rows) <= MAX_RUNS:
        table = F.broadcast(table)
    hits = _runs(docs).select("doc_id", "text_key", F.posexplode("runs").alias("place", "run")).join(table, "run")
    return hits.groupBy("doc_id", "text_key", "part", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"), F.min("place").alias("low"), F.max("place").alias("high")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score), one row per input row.

    Null and empty texts have no words, labels "" and score 0. Rows repeated
    with the same id and text each get the same result. ``spans`` lists the
    verified copies (label, first word, last word, similarity). Other columns
    are not read; an empty table gives an empty result.
    """
    pieces = parts(phrases, templates)
    text = keyed_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    by_diagonal = votes(text, pieces)
    info = docs.sparkSession.createDataFrame([(n, label, phrase, len(own)) for n, label, phrase, own in pieces], "part int, label string, phrase boolean, length int")
    full = F.bit_count("mask")
    known = by_diagonal.join(F.broadcast(info), "part").withColumn("hit", full).where(F.when(F.col("phrase"), full == F.col("length") - K + 1).otherwise((full >= 2) | (F.col("length") <= K + 1)))
    # Merge neighbouring diagonals of a template: a new span begins where the diagonal jumps.
    order = Window.partitionBy("doc_id", "text_key", "part").orderBy("diagonal")
    jump = F.col("phrase") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT)
    spans = known.withColumn("span", F.sum(jump.cast("int")).over(order)).groupBy("doc_id", "text_key", "part", "span").agg(
        F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("length").alias("length"), F.bit_or("mask").alias("mask"), F.min("low").alias("low"), (F.max("high") + K - 1).alias("high"), F.min("diagonal").alias("diagonal")
    )
    spans = spans.where(F.col("phrase") | (F.bit_count("mask") >= F.lit(MIN_VOTES) * (F.col("length") - K + 1)))
    found = spans.groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("low"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("low"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"),
        F.collect_list(F.when(~F.col("phrase"), F.struct("part", "low", "high"))).alias("loose"),
    )
    same = text["doc_id"].eqNullSafe(found["doc_id"]) & (text["text_key"] == found["text_key"])
    joined = text.join(found, same, "left").select(text["doc_id"], "text", "n_base", "first_word", "last_word", "base", "loose")
    return _verified(joined, pieces)


def _verified(joined: DataFrame, pieces: list) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string())]
        + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("similarity", pa.float64())]))), ("score", pa.float64())]
    )

    def check(text: str, loose: list[dict]) -> list[dict]:
        own, out = words(text), []
        for x in loose:
            _, label, _, template = pieces[x["part"]]
            low, high = max(0, x["low"] - DRIFT), min(len(own), x["high"] + 1 + DRIFT)
            blocks = [m for m in SequenceMatcher(None, template, own[low:high], autojunk=False).get_matching_blocks() if m.size]
            same = sum(m.size for m in blocks) / len(template)
            if same >= (1 if len(template) <= SHORT_WORDS else MIN_MATCH):
                out.append({"label": label, "first_word": low + blocks[0].b, "last_word": low + blocks[-1].b + blocks[-1].size - 1, "similarity": same})
        return sorted(out, key=lambda x: (x["first_word"], x["last_word"], x["label"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textcode.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                n_words = np.diff(textcode.word_hashes(part.column(1), textcode.ALNUM)[1])
                base, loose = part.column(5).to_pylist(), part.column(6).to_pylist()
                spans = [check(part.column(1)[i].as_py(), x) if x else [] for i, x in enumerate(loose)]
                labels = [",".join(sorted({*(x or ()), *(s["label"] for s in own)})) for x, own in zip(base, spans)]
                score = [max([1.0] * bool(x) + [s["similarity"] for s in own], default=0.0) for x, own in zip(base, spans)]
                columns = [part.column(0), n_words, part.column(2).fill_null(0), part.column(3), part.column(4), [",".join(x or ()) for x in base], labels, spans, score]
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, spans array<struct<label:string,first_word:bigint,last_word:bigint,similarity:double>>, score double")
