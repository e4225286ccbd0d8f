"""Phrase collocation mining with counting quotient filters.

1. *Words.*  Texts are cut into pieces and words; each slice of a scan task is
   written as the numbers of its own distinct (language, word) pairs, with the
   pairs and their counts beside it.  Grouping the pairs counts all words; those
   with ``least`` occurrences get dense ids, and a join gives every slice the
   ids of its own numbers.  No dictionary is broadcast.
2. *Phrases.*  For 2, 3 and 4 words in turn, tasks pack the ids of consecutive
   frequent words into keys and count them in quotient filters, one per block
   of the permuted key space, sealed whenever a million keys have come
   together.  One task per block merges its sorted filters and keeps the
   phrases with ``least`` occurrences.  A longer phrase is counted only where
   both phrases it consists of may be frequent (a Bloom filter of the shorter
   ones; what passes by chance falls below ``least`` when counted exactly).
   Blocks hold some million keys each on average, whatever the corpus; a
   frequent key adds one entry per filter.
3. *Scores.*  Every cut of a phrase joins the counts of its two parts; the
   lowest score counts.  Phrases inside longer ones of nearly the same count
   go.  The best of every language are ranked, first in 64 parts, then
   together.

Ids have 31 bits at most: two thousand million different frequent words.

Edge cases: null texts are empty; a null language is ``und`` and shares its
counts; repeated rows count again; ties rank by count, then by the phrase's
bytes; very long texts are cut at piece ends, which no phrase crosses; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstat.llm.common import bloom_build, bloom_has, flat_bytes, materialize, mix64, small_batches, text_slices
from loamstat.llm.quotient_filter import blocks_of, counted, merged, pack, permute, restore, seal, unpack
from loamstat.llm.wordhash import Words, as_long, lowered, words

#: Bytes of text numbered together.
SLICE = 4 << 20
#: Bytes of an Arrow batch: rows of this module are whole slices.
BATCH_BYTES = 16 << 20
#: Slices in a row group of a work table: what a task holds of one, whatever its share of the table.
GROUP_SLICES = 4
#: Keys that a task holds before it seals them into filters.
HELD_KEYS = 1 << 20
#: Keys per block of the key space, on average and before equal ones of a filter are counted.
BLOCK_KEYS = 1 << 20
LONGEST = 4

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_CUTS
_WORD[[0x20, 0x09]] = False

_ENTRIES = "array<struct<lang:string,word:string,n:bigint>>"


def _short_runs(data: np.ndarray, offs: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is; a single long text in parts that end with a piece."""
    if len(offs) > 2 or len(data) <= 2 * limit:
        yield data, offs
        return
    ends = np.flatnonzero(_CUTS[data]) + 1
    at = 0
    while at < len(data):
        k = np.searchsorted(ends, at + limit, "right") - 1
        to = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[k + 1]) if k + 1 < len(ends) else len(data)
        if to <= at:
            to = len(data)
        yield data[at:to], np.array([0, to - at], np.int64)
        at = to


def _distinct(w: Words, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of every word, counts; words are told apart by 128-bit digests and their language."""
    key = mix64(w.hash ^ mix64(lang.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if (w.check[first][inverse] == w.check).all() and (lang[first][inverse] == lang).all():
        return first, inverse, n
    both = np.stack([w.hash, w.check, lang.astype(np.uint64)], axis=1)
    _, first, inverse, n = np.unique(both, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.ravel(), n


def numbered_slices(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", limit: int = SLICE) -> DataFrame:
    """``(slice, seq, entries)``: word numbers (int32, -1 between pieces) and the words they stand for."""
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, all_data, all_offs in text_slices(batches, "text", limit):
            langs = rows.column(1).to_pylist()
            names = sorted(set(langs))
            number_of = {x: i for i, x in enumerate(names)}
            codes = np.array([number_of[x] for x in langs])
            for part, (data, offs) in enumerate(_short_runs(all_data, all_offs, limit)):
                w = words(data, offs, _WORD, checked=True)
                if not len(w.start):
                    continue
                lang = codes[w.doc]
                first, number, n = _distinct(w, lang)
                low = lowered(data)
                spelt = [low[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                seen = np.cumsum(_CUTS[data], dtype=np.int32)
                apart = (seen[w.start[1:] - 1] != seen[w.end[:-1] - 1]) | (w.doc[1:] != w.doc[:-1])
                seq = np.insert(number.astype(np.int32), np.flatnonzero(apart) + 1, -1)
                entries = pa.StructArray.from_arrays([pa.array([names[i] for i in lang[first]], pa.string()), pa.array(spelt, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])
                key = f"{rows.column(0)[0].as_py()}-{part}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([seq.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), entries)], ["slice", "seq", "entries"]
                )

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return source.mapInArrow(scan, f"slice string, seq binary, entries {_ENTRIES}")


def with_dense_ids(frozen: DataFrame) -> DataFrame:
    """Adds ``id``, 1 to the number of rows of a work table, by partition and place."""
    placed = materialize(frozen.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(F.sum("k").over(over), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("id", (F.col("before") + F.col("place") + 1).cast("int")).drop("part", "place", "before")


def frequent_words(slices: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)`` of all words, and ``(lang, word, n, id)`` of those with ``least`` occurrences."""
    each = slices.select(F.explode("entries").alias("e")).select("e.lang", "e.word", "e.n")
    counts = materialize(each.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return totals, materialize(with_dense_ids(counts.where(F.col("n") >= least)), "words")


def id_sequences(slices: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(seq)``: the ids (int32) of every slice, 0 for rare words and between pieces; runs of 0 are one."""
    own = slices.select("slice", F.posexplode("entries").alias("place", "e")).select("slice", "place", "e.lang", "e.word")
    named = own.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("slice").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                seq = np.frombuffer(b.column(0)[i].as_py(), np.int32)
                ids = np.zeros(max(int(seq.max()), 0) + 2, np.int32)  # the last place is read for -1
                ids[b.column(1)[i].values.to_numpy()] = b.column(2)[i].values.to_numpy()
                found = ids[seq]
                keep = found != 0
                keep[1:] |= found[:-1] != 0
                out.append(found[keep].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["seq"])

    return slices.select("slice", "seq").join(named, "slice").select("seq", "places", "ids").mapInArrow(rename, "seq binary")


def gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, for Bloom filters only."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for i in ids:
        h = mix64(h ^ mix64(i.astype(np.uint64)))
    return h


def count_phrases(sequences: DataFrame, size: int, bits: int, block_bits: int, least: int, shorter: np.ndarray | None, held: int = HELD_KEYS) -> DataFrame:
    """``(ids array<int>, n)``: phrases of ``size`` words with ``least`` occurrences.

    ``shorter`` is a Bloom filter of the frequent phrases of one word less.
    """
    wide = size * bits
    block_bits = min(block_bits, wide)
    shared = sequences.sparkSession.sparkContext.broadcast(shorter)

    def filters(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        keys, counts = counted(permute(pack([np.concatenate(p) for p in zip(*parts, strict=True)], bits), wide))
        block = blocks_of(keys, wide, block_bits)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        sealed = [seal(keys.take(slice(a, z)), counts[a:z], wide, block_bits) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]], pa.int64()), pa.array(sealed, pa.binary())], ["block", "filter"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have = [], 0
        for b in batches:
            data, offs = flat_bytes(b.column(0))
            for a, z in zip(offs[:-1], offs[1:], strict=True):
                seq = data[a:z].view(np.int32)
                m = len(seq) - size + 1
                if m <= 0:
                    continue
                if shared.value is None:
                    fits = (seq[:m] != 0) & (seq[1 : m + 1] != 0)
                else:
                    whole = seq[: m + 1] != 0
                    for k in range(1, size - 1):
                        whole &= seq[k : m + 1 + k] != 0
                    at = np.flatnonzero(whole)
                    some = np.zeros(m + 1, bool)
                    some[at] = bloom_has(shared.value, gram_hash([seq[at + k] for k in range(size - 1)])) if len(at) else False
                    fits = some[:-1] & some[1:]
                at = np.flatnonzero(fits)
                if len(at):
                    parts.append([seq[at + k] for k in range(size)])
                    have += len(at)
                if have >= held:
                    yield filters(parts)
                    parts, have = [], 0
        if have:
            yield filters(parts)

    def merge(table: pa.Table) -> pa.Table:
        keys, n = merged([x.as_py() for x in table.column("filter")])
        keep = n >= least
        ids = np.stack(unpack(restore(keys.take(keep), wide), size, bits), axis=1).astype(np.int32)
        offs = np.arange(len(ids) + 1, dtype=np.int32) * size
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(offs), pa.array(ids.ravel())), "n": pa.array(n[keep], pa.int64())})

    return sequences.mapInArrow(scan, "block long, filter binary").groupBy("block").applyInArrow(merge, "ids array<int>, n long")


def _bloom_of(grams: DataFrame, size: int) -> np.ndarray:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if len(flat):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(gram_hash(list(flat.T))))], ["h"])

    return bloom_build(grams.select("ids").mapInArrow(hashes, "h long"))


def frequent_phrases(sequences: DataFrame, vocabulary: DataFrame, least: int, longest: int = LONGEST, block_keys: int = BLOCK_KEYS, held: int = HELD_KEYS) -> DataFrame:
    """``(ids, n)`` of all words and phrases of up to ``longest`` words with ``least`` occurrences."""
    top, total = vocabulary.agg(F.max("id"), F.sum("n")).first()
    bits = max(int(top or 1).bit_length(), 1)
    block_bits = max(5, (int(total or 0) // block_keys).bit_length())
    found = [vocabulary.select(F.array("id").alias("ids"), "n")]
    bloom = None
    for size in range(2, longest + 1):
        grams = materialize(count_phrases(sequences, size, bits, block_bits, least, bloom, held), f"phrases{size}")
        found.append(grams)
        if size < longest:
            bloom = _bloom_of(grams, size)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def scored(grams: DataFrame) -> DataFrame:
    """``(ids, a, l, r, score)`` of the phrases that no longer one covers; products are exact decimals."""
    phrases = grams.where(F.size("ids") > 1)
    parts = grams.select(F.col("ids").alias("part"), F.col("n").alias("n"))
    cuts = phrases.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.slice("ids", F.lit(1), F.col("k"))).join(parts.withColumnRenamed("n", "l"), "part").drop("part")
    cuts = cuts.withColumn("part", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))).join(parts.withColumnRenamed("n", "r"), "part").drop("part")
    exact = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = cuts.withColumn("score", exact).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("ids", "a", "c.l", "c.r", "c.score")
    inside = F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), p -> slice(ids, p, m))))"
    )
    covers = phrases.where(F.size("ids") > 2).select(F.explode(inside).alias("ids"), F.col("n").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covers, "ids", "left")
    return kept.where(F.expr("longer IS NULL OR 100 * CAST(longer AS DECIMAL(19,0)) < 80 * CAST(a AS DECIMAL(19,0))")).drop("longer")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text", slice_bytes: int = SLICE, block_keys: int = BLOCK_KEYS, held: int = HELD_KEYS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring
    cut, ``n`` all words of the language; ``score`` is floor(2000000 a / (l + r)).
    """
    slices = materialize(numbered_slices(docs, lang_col, text_col, slice_bytes), "slices", GROUP_SLICES)
    totals, vocabulary = frequent_words(slices, least)
    sequences = materialize(id_sequences(slices, vocabulary), "sequences", GROUP_SLICES)
    kept = materialize(scored(frequent_phrases(sequences, vocabulary, least, LONGEST, block_keys, held)), "scored")
    spelt = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("said"))
    named = kept.join(spelt, "ids").select("lang", F.array_join(F.transform("said", lambda s: s["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
