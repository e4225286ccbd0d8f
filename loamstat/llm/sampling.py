"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, bound: int, per_shard: int) -> DataFrame:
    """``(doc_id, text, y, shard, mark)``: about ``bound`` labelled documents at most, ``per_shard`` in each shard.

    Rows are taken by the hash of their id, at a rate that the count of
    labelled rows sets, so the sample is the same on every run.  The sampled
    ids (bounded by ``bound``) are broadcast to the text scan.  Ids labelled
    twice take the larger label, null ids or labels are not used.  Rows that
    share an id come with different ``mark``s; ``one_per_id`` keeps one, once
    they are encoded.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    total = known.count()
    rate = min(1.0, bound / max(total, 1))
    shards = max(1, -(-min(total, bound) // per_shard))
    place = F.pmod(F.xxhash64("doc_id", F.lit(97)), F.lit(1 << 20))
    picked = known.where(place < F.lit(int(rate * (1 << 20)))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(131)), F.lit(shards)).cast("int"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y", "shard", F.xxhash64("text").alias("mark"))


def one_per_id(encoded: DataFrame) -> DataFrame:
    """One row for each ``doc_id``, that of the least ``mark``: as many rows as ids, however often an id repeats."""
    rest = [c for c in encoded.columns if c not in ("doc_id", "mark")]
    return encoded.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "mark").alias("kept")).select("doc_id", "kept.*")
