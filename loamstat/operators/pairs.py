"""Preparation of a parallel corpus: normalise, filter, index, encode, batch, split."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import global_rank

PAD, SOS, EOS, FIRST = 0, 0, 1, 2


def strip_accents(col: Column) -> Column:
    """Canonical decomposition without combining marks, in Arrow batches; texts of ASCII only stay out of Python."""

    def plain(s: pd.Series) -> pd.Series:
        out = s.str.normalize("NFD")
        return out.map(lambda x: x if x is None or x.isascii() else "".join(c for c in x if unicodedata.category(c) != "Mn"), na_action="ignore")

    plain.__annotations__ = {"s": pd.Series, "return": pd.Series}
    ascii_only = col.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only, col).otherwise(F.pandas_udf(plain, "string")(F.when(~ascii_only, col)))


def normalize_sentence(col: Column, accents: bool = True) -> Column:
    """Accents stripped, lower case, trimmed, a space before ``.!?``, all else but letters to a space."""
    text = F.lower(F.trim(strip_accents(col) if accents else col))
    # The two patterns of the normal form
    text = F.regexp_replace(text, r"([.!?])", r" $1")
    return F.trim(F.regexp_replace(text, r"[^a-zA-Z.!?]+", " "))


def filter_pairs(pairs: DataFrame, max_len: int = 10, prefixes: tuple[str, ...] = (), src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Both sides under ``max_len`` words, the target starting with a prefix (if any are given)."""
    short = lambda c: F.size(F.split(c, " ")) < max_len
    out = pairs.where(short(F.col(src)) & short(F.col(tgt)))
    if prefixes:
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | F.startswith(F.col(tgt), F.lit(p))
        out = out.where(starts)
    return out


def build_vocab(pairs: DataFrame, side: str, key: str = "pair_id") -> DataFrame:
    """``(word, index, count)`` with indices from 2 in order of first appearance.

    First places are aggregated per word; only distinct words are ranked, by range partitions.
    """
    each = pairs.select(key, F.posexplode(F.split(side, " ")).alias("pos", "word")).where("word <> ''")
    words = each.groupBy("word").agg(F.min(F.struct(key, "pos")).alias("first"), F.count(F.lit(1)).alias("count"))
    flat = words.select("word", "count", F.col(f"first.{key}").alias("__k"), F.col("first.pos").alias("__p"))
    return global_rank(flat, [F.col("__k"), F.col("__p")], "index").select("word", (F.col("index") + FIRST - 1).alias("index"), "count")


def encode(pairs: DataFrame, vocab: DataFrame, side: str, key: str = "pair_id") -> DataFrame:
    """``(key, ids)``: word indices in order, then EOS; unknown words are left out."""
    each = pairs.select(key, F.posexplode(F.split(side, " ")).alias("pos", "word"))
    ids = each.join(vocab.select("word", "index"), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("s"))
    known = pairs.select(key).join(ids, key, "left")
    return known.select(key, F.concat(F.coalesce(F.col("s.index"), F.array().cast("array<bigint>")), F.array(F.lit(EOS).cast("long"))).alias("ids"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str = "pair_id") -> DataFrame:
    """Words of index arrays up to EOS, joined by spaces."""
    each = encoded.select(key, F.posexplode("ids").alias("pos", "index")).where(F.col("index") >= FIRST)
    words = each.join(vocab.select("word", "index"), "index").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
    return encoded.select(key).join(words, key, "left").select(key, F.coalesce(F.array_join(F.col("s.word"), " "), F.lit("")).alias("text"))


def pad_batches(encoded: DataFrame, size: int = 64, seed: int = 0, src: str = "src_ids", tgt: str = "tgt_ids", key: str = "pair_id") -> DataFrame:
    """Batches of ``size`` in a seeded order: both sides padded with 0 to the batch's longest,
    SOS before the target, and its mask."""
    shuffled = encoded.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = global_rank(shuffled, [F.col("__h"), F.col(key)], "__r")
    batched = ranked.withColumns({"batch": F.floor((F.col("__r") - 1) / size), "tgt_in": F.concat(F.array(F.lit(SOS).cast("long")), tgt)})
    w = Window.partitionBy("batch")
    padded = lambda c: F.concat(c, F.array_repeat(F.lit(PAD).cast("long"), (F.max(F.size(c)).over(w) - F.size(c)).cast("int")))
    out = batched.withColumns({"src_padded": padded(src), "tgt_padded": padded("tgt_in")})
    real = F.transform(F.sequence(F.lit(1), F.size("tgt_padded")), lambda i: i <= F.size("tgt_in"))
    return out.select(key, "batch", "src_padded", "tgt_padded", real.alias("mask"))


def split_pairs(df: DataFrame, share: float = 0.8, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """Adds ``train``: a keyed share of the rows, the same on every run and partitioning."""
    return df.withColumn("train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def keyed_split(df: DataFrame, share: float, key: str) -> DataFrame:
    """N15 with arithmetic keys only, so that any engine repeats it."""
    mixed = F.pmod(F.col(key) * 1_103_515_245 + 12_345, F.lit(2_147_483_648))
    return df.withColumn("train", F.pmod(F.floor(mixed / 65_536), F.lit(1000)) < int(share * 1000))
