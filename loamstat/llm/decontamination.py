"""Benchmark decontamination by a distributed positional inverted index.

1. *Windows.*  The distinct windows of all test items: ``window`` consecutive
   words (a shorter item is one window), whatever the number of items that
   hold them.
2. *Anchors.*  Corpus frequencies of the items' terms are counted in one scan.
   A window's two rarest terms, with their distance, are its anchors; windows
   with the same anchors share them.
3. *Index.*  A second scan stores, for every document, its word count and the
   postings (term, position) of all anchor terms.  The postings of anchors
   are complete: every document and every place.
4. *Intersection.*  Postings meet the anchors on the term.  Subtracting the
   anchor's offset aligns both lists on the place of the rarest term; within a
   document a place stays where both lists have it (a candidate), or counts
   as a proximity match where they come within ``slop`` words.
5. *Check.*  Every candidate is a place where a window may begin.  The words
   that stand there are joined with the windows word by word: on the text
   of the words, not on hashes.  Items come in last, by the windows found.

Terms are looked up by 64-bit hashes, which only propose candidates; what
counts as a hit is decided by the words.  No row holds more than the places
of one document.  Windows that very many documents hold are dealt over
``SALTS`` copies in the two joins on the words.

Edge cases: null texts have no words; items without words have no windows;
repeated documents get the same result, repeated items the same windows;
a null item id is never reported in ``items`` but its words count as hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.llm.common import bloom_build, bloom_has, drop_keys, materialize, row_key, sieve, text_slices
from loamstat.llm.wordhash import ALNUM, as_long, lowered, phrases, words

#: Copies of a window's row in the joins on its words, so that a passage of very many documents
#: isn't one task's.
SALTS = 16
#: Term counts that a task of the frequency scan holds before it hands them on.
_HELD_COUNTS = 1 << 19


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(phrase, k, item_id)``: the windows of every item, ``k`` lower-cased words joined by a space."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            w = words(data, offs, ALNUM)
            n = np.bincount(w.doc, minlength=part.num_rows) if len(w.doc) else np.zeros(part.num_rows, np.int64)
            size = np.minimum(n, window)
            at = np.flatnonzero(np.arange(len(w.doc)) + size[w.doc] <= np.cumsum(n)[w.doc]) if len(w.doc) else np.zeros(0, np.int64)
            low = lowered(data)
            for a in range(0, len(at), 50_000):
                own = at[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phrases(low, w, own, size[w.doc[own]]), pa.string()), pa.array(size[w.doc[own]].astype(np.int32)), part.column(0).take(pa.array(w.doc[own]))],
                    ["phrase", "k", "item_id"],
                )

    source = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, "phrase string, k int, item_id string").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))


def window_terms(windows: DataFrame) -> DataFrame:
    """``(word, term)``: the distinct words of the windows and their hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "word"):
            w = words(data, offs, ALNUM)  # one word a row
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_long(w.hash))], ["word", "term"])

    return windows.select(F.explode(F.split("phrase", " ")).alias("word")).distinct().mapInArrow(scan, "word string, term long")


def term_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, term, cf)``: corpus frequency of each of ``terms`` (a work table), 0 if absent."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_build(terms.select("term")))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        t, inverse = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
        return t, np.bincount(inverse, np.concatenate([b for _, b in held]), len(t)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, data, offs in text_slices(batches, "text"):
            t, c = np.unique(as_long(words(data, offs, ALNUM).hash), return_counts=True)
            keep = bloom_has(shared.value, t)
            held.append((t[keep], c[keep]))
            if sum(len(a) for a, _ in held) > _HELD_COUNTS:
                held = [merged(held)]
                if len(held[0][0]) > _HELD_COUNTS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["term", "cf"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], ["term", "cf"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term long, cf long").groupBy("term").agg(F.sum("cf").alias("cf"))
    return terms.join(counted, "term", "left").select("word", "term", F.coalesce("cf", F.lit(0).cast("long")).alias("cf"))


def window_anchors(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(phrase, k, t0, t1, gap, place)``: the two rarest terms of every window.

    Ties go by the word.  ``place`` is the first of the rarest term in the
    window and ``gap`` the way from there to the first of the second; a window
    of one distinct word has a null ``t1`` and gap 0.
    """
    each = windows.select("phrase", "k", F.posexplode(F.split("phrase", " ")).alias("place", "word")).join(frequencies, "word")
    ranked = each.groupBy("phrase", "k").agg(F.array_sort(F.collect_list(F.struct("cf", "word", "place", "term"))).alias("terms"))
    first = F.element_at("terms", 1)
    second = F.get(F.filter("terms", lambda t: t["word"] != first["word"]), F.lit(0))
    return ranked.select("phrase", "k", first["term"].alias("t0"), second["term"].alias("t1"), F.coalesce(second["place"] - first["place"], F.lit(0)).alias("gap"), first["place"].alias("place"))


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc, n_words, terms array, places array)``: postings of ``terms`` (a work table) in every document.

    A Bloom filter chooses the postings; its false alarms meet no anchor later.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom_build(terms))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            w = words(data, offs, ALNUM)
            h = as_long(w.hash)
            first = np.searchsorted(w.doc, np.arange(part.num_rows + 1))
            keep = np.flatnonzero(bloom_has(shared.value, h))
            cut = pa.array(np.searchsorted(w.doc[keep], np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.ListArray.from_arrays(cut, pa.array(h[keep])),
                    pa.ListArray.from_arrays(cut, pa.array((keep - first[w.doc[keep]]).astype(np.int32))),
                ],
                ["doc_id", "doc", "n_words", "terms", "places"],
            )

    return _keyed(docs, id_col, text_col).mapInArrow(scan, "doc_id long, doc binary, n_words long, terms array<long>, places array<int>")


def postings(index: DataFrame) -> DataFrame:
    """``(term, row, pos)`` from the index."""
    return index.where("size(terms) > 0").select("row", F.explode(F.arrays_zip("terms", "places")).alias("p")).select(F.col("p.terms").alias("term"), "row", F.col("p.places").alias("pos"))


def aligned(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """``(t0, t1, gap, row, pos, exact)``: places of rarest terms whose second anchor stands
    at its distance (``exact``) or up to ``slop`` words off it."""
    pair = ["t0", "t1", "gap"]
    pairs = anchors.select(*pair).distinct()
    spots = pairs.select(F.col("t0").alias("term"), *pair, F.lit(0).alias("lead"), F.lit(0).alias("back")).unionByName(
        pairs.where("t1 is not null").select(F.col("t1").alias("term"), *pair, F.lit(1).alias("lead"), F.col("gap").alias("back"))
    )
    met = postings(index).join(spots, "term").select(*pair, "row", (F.col("pos") - F.col("back")).alias("pos"), (F.col("lead") == 0).alias("leads"))
    by = Window.partitionBy(*pair, "row").orderBy("pos")
    other = F.when(~F.col("leads"), F.lit(1))
    near = F.count(other).over(by.rangeBetween(-slop, slop))
    same = F.count(other).over(by.rangeBetween(0, 0))
    return (
        met.withColumn("near", near)
        .withColumn("same", same)
        .where(F.col("leads") & (F.col("t1").isNull() | (F.col("near") > 0)))
        .select(*pair, "row", "pos", (F.col("t1").isNull() | (F.col("same") > 0)).alias("exact"))
    )


def _met_pairs(places: DataFrame, anchors: DataFrame) -> Column:
    return (places["t0"] == anchors["t0"]) & places["t1"].eqNullSafe(anchors["t1"]) & (places["gap"] == anchors["gap"])


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, contaminated, n_near``.

    ``items`` holds the ids (as strings, sorted) of the items with a window in
    the document, ``n_hit`` counts the words inside any such occurrence.
    ``n_near`` counts proximity matches: distinct windows whose two rarest
    words stand in the document at their distance, up to ``slop`` words more
    or less (exact occurrences included).
    """
    index, places, anchors, hits, named = _searched(docs, items, window, slop, id_col, text_col, item_col)
    pair = ["t0", "t1", "gap"]
    held = anchors.groupBy(*pair).agg(F.count(F.lit(1)).alias("windows"))
    met = places.select(*pair, "row").distinct()
    near = met.join(held, _met_pairs(met, held)).groupBy("row").agg(F.sum("windows").alias("n_near"))
    none = F.lit(0).cast("long")
    out = index.select("doc_id", "row", "doc", "n_words").join(near, "row", "left").join(hits, "doc", "left").join(named, "doc", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.array_size("items").cast("long"), none).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
        F.coalesce("n_near", none).alias("n_near"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows, with all their columns, that hold no window of an item."""
    hits = _searched(docs, items, window, 0, id_col, text_col, item_col)[3]
    return drop_keys(docs, row_key(id_col, text_col), materialize(hits.select("doc"), "contaminated"))


def _searched(docs: DataFrame, items: DataFrame, window: int, slop: int, id_col: str, text_col: str, item_col: str) -> tuple[DataFrame, ...]:
    """The index, aligned places, anchors, ``(doc, n_hit)`` and ``(doc, items)`` of the documents with a window."""
    held = materialize(item_windows(items, window, item_col), "windows")
    windows = held.select("phrase", "k").distinct()
    terms = materialize(window_terms(windows), "terms")
    anchors = materialize(window_anchors(windows, term_frequencies(docs, terms, text_col)), "anchors")
    wanted = materialize(anchors.select(F.explode(F.array("t0", "t1")).alias("term")).where("term is not null").distinct(), "wanted")
    index = materialize(positional_index(docs, wanted, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "index")
    places = materialize(aligned(index, anchors, slop), "aligned")

    # where windows may begin, by document
    sure = places.where("exact").select("t0", "t1", "gap", "row", "pos")
    starts = anchors.select("t0", "t1", "gap", "k", "place").distinct()
    begin = sure.join(starts, _met_pairs(sure, starts)).select("row", (F.col("pos") - F.col("place")).alias("start"), "k").where("start >= 0").distinct()
    lists = begin.join(index.select("row", "doc", "n_words"), "row").where("start + k <= n_words").groupBy("doc").agg(F.collect_set(F.struct("start", "k")).alias("begins"))
    found = materialize(lists, "begins")

    texts = _keyed(docs, id_col, text_col).select("doc", "text")
    texts = texts.mapInArrow(sieve(bloom_build(found.select("doc")), docs.sparkSession, 0), "doc binary, text string").join(found, "doc").dropDuplicates(["doc"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            w = words(data, offs, ALNUM)
            first = np.searchsorted(w.doc, np.arange(part.num_rows))
            begins = part.column(2)
            doc = np.repeat(np.arange(part.num_rows), begins.value_lengths().to_numpy(zero_copy_only=False))
            flat = begins.flatten()
            start, k = flat.field("start").to_numpy(), flat.field("k").to_numpy()
            low = lowered(data)
            for a in range(0, len(doc), 50_000):
                own = slice(a, a + 50_000)
                at = first[doc[own]] + start[own]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc[own])), pa.array(start[own], pa.int32()), pa.array(k[own], pa.int32()), pa.array(phrases(low, w, at, k[own]), pa.string())],
                    ["doc", "start", "k", "phrase"],
                )

    spoken = texts.select("doc", "text", "begins").mapInArrow(read, "doc binary, start int, k int, phrase string")
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    occurrences = materialize(spoken.withColumn("salt", salt).join(windows.select("phrase", copies), ["phrase", "salt"], "left_semi"), "occurrences")
    # words inside any occurrence: the length of the union of the intervals
    ends = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end")))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("covered")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["covered"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("covered")),
        lambda s: s["covered"],
    )
    hits = occurrences.groupBy("doc").agg(ends.alias("n_hit"))
    met = occurrences.select("doc", "phrase", "salt").distinct().join(held.where("item_id is not null").select("phrase", "item_id", copies), ["phrase", "salt"])
    named = met.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return index, places, anchors, hits, named
