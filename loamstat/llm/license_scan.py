"""License scans by diagonal voting.

Templates are word sequences: short base phrases and longer notices.  All
rolling word k-gram hashes of every document are joined by Spark to the
positions of the templates' k-grams.  A match at document position d and
template position t votes for the diagonal d - t.  Votes are aggregated by
diagonal; neighbouring diagonals of one template (shifted by inserted or
missing words) whose spans follow each other are merged into one candidate
span.  Spans are verified word by word against the text of those documents.

Where all k-grams of a base phrase vote for the same diagonal the phrase may
stand at that diagonal; it counts if the words there are the phrase's.

The template table is a fixed parameter of a few hundred rows, so it is
broadcast; the documents' side of the join is a map without a shuffle.

Edge cases: null texts are empty; documents shorter than k words match
nothing; repeated rows get equal results; overlapping places all count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstat.llm.common import bloom_build, flat_bytes, materialize, row_key, sieve, text_slices
from loamstat.llm.wordhash import ALNUM, Words, as_long, lowered, ngrams, phrase_words, phrases, words

#: The phrases that the base rule counts, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public notice texts (shortened to their first sentences) whose spans add labels.
NOTICES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License", "apache-2"),
    ("Licensed under the Apache License Version 2.0", "apache-2"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under the GNU General Public License version 3", "gpl-3"),
    ("This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License", "gpl"),
    ("Redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License v. 2.0", "mpl-2"),
)


@dataclass(frozen=True)
class ScanParams:
    """``k``: words of a gram; ``drift``: largest shift between neighbouring
    diagonals; ``gap``: largest distance of their spans in words; ``cover``: least share
    of a template's words that a verified span must match in order."""

    k: int = 3
    drift: int = 3
    gap: int = 4
    cover: float = 0.7


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """``(gram, template, t)``: every k-gram of every template."""
    rows = []
    for i, (text, _) in enumerate(templates):
        h = phrase_words(text)
        w = Words(h, h, np.zeros(len(h), np.int64), h)
        grams, at = ngrams(w, k)
        rows += [(int(g), i, int(t)) for g, t in zip(as_long(grams), at, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, t int")


def document_grams(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, doc, n_words, grams array<long>)``: all rolling k-gram hashes by place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            w = words(data, offs, ALNUM)
            n = np.bincount(w.doc, minlength=part.num_rows) if len(w.doc) else np.zeros(part.num_rows, np.int64)
            h, at = ngrams(w, k)
            cut = np.searchsorted(w.doc[at], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(as_long(h)))],
                ["doc_id", "doc", "n_words", "grams"],
            )

    return _keyed(docs).mapInArrow(scan, "doc_id long, doc binary, n_words long, grams array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc"), F.col("text").cast("string").alias("text"))


def diagonal_votes(grams: DataFrame, templates: DataFrame) -> DataFrame:
    """``(doc, template, diagonal, votes, first, last)`` from the gram join."""
    rolled = grams.select("doc", F.posexplode("grams").alias("d", "gram"))
    met = rolled.join(F.broadcast(templates), "gram")  # a fixed template table
    return (
        met.groupBy("doc", "template", (F.col("d") - F.col("t")).alias("diagonal"))
        .agg(F.count_distinct("d").alias("votes"), F.min("d").alias("first"), F.max("d").alias("last"))
    )


def merged_spans(votes: DataFrame, p: ScanParams) -> DataFrame:
    """``(doc, template, first, last, votes)``: chains of neighbouring diagonals.

    ``last`` is the last word.  A diagonal joins the chain before it if it drifts at most
    ``drift`` and starts at most ``gap`` words behind the chain's end.
    """
    by = Window.partitionBy("doc", "template").orderBy("first", "diagonal")
    new = (
        (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > p.drift)
        | (F.col("first") - F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)) > p.gap + p.k)
    )
    chained = votes.withColumn("chain", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("doc", "template", "chain").agg(
        F.min("first").alias("first"), (F.max("last") + p.k - 1).alias("last"), F.sum("votes").alias("votes")
    ).drop("chain")


def word_ids(own: list[str], template: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both word lists as numbers that are equal where the words are (-1: not in the template)."""
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    return np.array([number.get(w, -1) for w in own], np.int64), np.array([number[w] for w in template], np.int64)


def ordered_cover(text: np.ndarray, template: np.ndarray) -> float:
    """Longest common subsequence over the template's length (numbers of words)."""
    best = np.zeros(len(template) + 1, np.int64)
    for h in text:
        step = np.where(template == h, best[:-1] + 1, best[1:])
        best[1:] = np.maximum.accumulate(np.maximum(step, best[1:]))
    return best[-1] / max(len(template), 1)


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...], votes: DataFrame, phrases_too: int, p: ScanParams) -> DataFrame:
    """Verified spans ``(doc, template, first, last, cover, base)``.

    ``base`` marks the places where one of the first ``phrases_too``
    templates stands word by word.
    """
    said = [_words_of(t) for t, _ in templates]
    grams = F.element_at(F.array(*[F.lit(len(t) - p.k + 1) for t in said]), F.col("template") + 1)
    spans = merged_spans(votes, p).where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(grams * F.lit(0.4)))).select("doc", "template", "first", "last", F.lit(False).alias("base"))
    places = votes.where((F.col("template") < phrases_too) & (F.col("votes") == grams)).select(
        "doc", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + grams + p.k - 2).alias("last"), F.lit(True).alias("base")
    )
    span = F.struct("template", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "base")
    wanted = materialize(spans.unionByName(places).groupBy("doc").agg(F.collect_list(span).alias("spans")), "spans")
    kept = sieve(bloom_build(wanted.select("doc")), docs.sparkSession, 0)
    texts = _keyed(docs).select("doc", "text").mapInArrow(kept, "doc binary, text string").join(wanted, "doc").dropDuplicates(["doc"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            w = words(data, offs, ALNUM)
            cut = np.searchsorted(w.doc, np.arange(part.num_rows + 1))
            low, out = lowered(data), []

            def read(r: int, lo: int, hi: int) -> list[str]:
                lo, hi = cut[r] + max(0, lo), min(cut[r + 1], cut[r] + hi)
                return [x.decode() for x in map(low.__getitem__, map(slice, w.start[lo:hi], w.end[lo:hi]))]

            for r, spans in enumerate(part.column(2).to_pylist()):
                for s in spans:
                    t, first, last = said[s["template"]], s["first"], s["last"]
                    if s["base"]:
                        if read(r, first, last + 1) == t:
                            out.append((part.column(0)[r].as_py(), s["template"], first, last, 1.0, True))
                        continue
                    cover = ordered_cover(*word_ids(read(r, first, last + 1), t))
                    if cover < 1:
                        # a template's edge words need not be in any matched gram
                        around = ordered_cover(*word_ids(read(r, first - len(t), last + 1 + len(t)), t))
                        cover = max(cover, min(around, cover + 2 * p.k / len(t)))
                    if cover >= p.cover:
                        out.append((part.column(0)[r].as_py(), s["template"], first, last, float(cover), False))
            yield pa.RecordBatch.from_pylist([dict(zip(_SPANS.names, o, strict=True)) for o in out], schema=_SPANS)

    return texts.select("doc", "text", "spans").mapInArrow(verify, "doc binary, template int, first int, last int, cover double, base boolean")


_SPANS = pa.schema([("doc", pa.binary()), ("template", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("cover", pa.float64()), ("base", pa.bool_())])


def _words_of(text: str) -> list[str]:
    data, offs = flat_bytes(pa.array([text]))
    w = words(data, offs, ALNUM)
    return phrases(lowered(data), w, np.arange(len(w.doc)), np.ones(len(w.doc), np.int64))


def license_scan(
    docs: DataFrame,
    base_phrases: tuple[tuple[str, str], ...] = BASE_PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    p: ScanParams = ScanParams(),
) -> DataFrame:
    """One row per document: base places and labels, and labels of verified notices.

    Columns: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score``.  ``score`` is 1 with a base place, else the best cover.
    Every phrase must have ``k`` words at least.
    """
    spark = docs.sparkSession
    templates = (*base_phrases, *notices)
    if min(len(phrase_words(t)) for t, _ in templates) < p.k:
        raise ValueError("a template has fewer words than a gram")
    grams = document_grams(docs, p.k)
    votes = materialize(diagonal_votes(grams, template_grams(spark, templates, p.k)), "votes")
    label = F.element_at(F.array(*[F.lit(name) for _, name in templates]), F.col("template") + 1)
    found = materialize(license_spans(docs, templates, votes, len(base_phrases), p), "found")
    base = (
        found.where("base")
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_base"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.collect_set(label).alias("base_set"))
    )
    spans = found.where("not base").groupBy("doc").agg(F.collect_set(label).alias("more"), F.max("cover").alias("cover"))
    counts = docs_words(docs)
    none = F.array().cast("array<string>")
    joined = counts.join(base, "doc", "left").join(spans, "doc", "left")
    base_set, more = F.coalesce("base_set", none), F.coalesce("more", none)
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("lo").cast("long").alias("first_word"),
        F.col("hi").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def docs_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, n_words)`` of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            n = np.bincount(words(data, offs, ALNUM).doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64))], ["doc_id", "doc", "n_words"])

    return _keyed(docs).mapInArrow(scan, "doc_id long, doc binary, n_words long")
