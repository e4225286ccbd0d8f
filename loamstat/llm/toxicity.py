"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct hashed unigrams (value 1), bigrams and skip-bigrams
one and two words apart (value ``gram_value``) of the lower-cased text; the
lowest bit of a feature tells the two kinds apart.  Training shards of a bounded
labelled sample run FTRL-proximal with per-coordinate rates and L1; the
shards' weights are averaged (parameter mixing).  L1 leaves few non-zero
weights, so what is broadcast to the scoring scan is a short index and value
array; its size is bounded by the hash space.

Edge cases: null and empty texts have no features and score by the bias
alone; repeated rows score alike; without labels every weight is zero and
every score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstat.llm.common import map_rows, text_slices
from loamstat.llm.sampling import fold_of, labelled_sample, one_per_id
from loamstat.llm.wordhash import ALNUM, ngrams, words


@dataclass(frozen=True)
class FtrlParams:
    """``sample``: bound of labelled documents used; shards of ``per_shard`` train apart."""

    bits: int = 20
    gram_value: float = 0.3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 5
    sample: int = 16_000
    per_shard: int = 8_000


@dataclass(frozen=True)
class SparseWeights:
    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        """Weight times value of every feature."""
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.value
        return w


def hashed_features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram and skip-gram occurrence of a slice."""
    w = words(data, offs, ALNUM)
    keep = np.uint64(64 - bits)
    rows, feats = [w.doc], [w.hash >> keep & ~np.uint64(1)]
    for steps in ((0, 1), (0, 2), (0, 3)):
        h, at = ngrams(w, 2, steps)
        rows.append(w.doc[at])
        feats.append(h >> keep | np.uint64(1))
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def _distinct(rows: np.ndarray, feats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.int64) << bits) | feats)
    return key >> bits, key & ((1 << bits) - 1)


def ftrl_train(examples: list[np.ndarray], y: np.ndarray, p: FtrlParams) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the examples in the given order, ``epochs`` times.

    The bias starts at the labels' log odds and has its own coordinate
    without L1.  Returns weights times feature values, and the bias.
    """
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    odds = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size, 0.0, p.l1)
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    def values(i: np.ndarray) -> np.ndarray:
        return np.where((i & 1 == 1) & (i != size), p.gram_value, 1.0)

    for _ in range(p.epochs):
        for features, t in zip(examples, y, strict=True):
            i = np.append(features, size)
            x, w = values(i), weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x + odds, -35, 35))) - t) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / p.alpha * w
            n[i] = grown
    every = weights(np.arange(size + 1)) * values(np.arange(size + 1))
    return every[:size], float(every[size]) + odds


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, params: FtrlParams = FtrlParams()) -> SparseWeights:
    """Weights from labelled rows that ``allowed`` admits."""
    sample = labelled_sample(docs, labels, "toxic", allowed, params.sample, params.per_shard)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            rows, feats = _distinct(*hashed_features(data, offs, params.bits), params.bits)
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(cut), pa.array(feats.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), x], ["doc_id", "y", "shard", "mark", "x"])

    encoded = one_per_id(sample.mapInArrow(encode, "doc_id long, y double, shard int, mark long, x array<int>"))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        # a fixed shuffle: neighbouring ids may be alike
        order = np.random.Generator(np.random.PCG64(table.num_rows)).permutation(table.num_rows)
        y = table.column("y").to_numpy()
        lists = table.column("x").combine_chunks()
        flat, cut = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        examples = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]  # views
        w, bias = ftrl_train([examples[i] for i in order], y[order], params)
        index = np.flatnonzero(w)
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "n": pa.array([table.num_rows], pa.int64()),
                "index": pa.array([index.astype(np.int32)], pa.list_(pa.int32())),
                "value": pa.array([w[index]], pa.list_(pa.float64())),
                "bias": pa.array([bias], pa.float64()),
            }
        )

    got = encoded.groupBy("shard").applyInArrow(shard, "shard int, n long, index array<int>, value array<double>, bias double").collect()
    got = sorted(got, key=lambda r: r["shard"])
    total = sum(r["n"] for r in got)
    mixed, bias = np.zeros(1 << params.bits), 0.0
    for r in got:
        mixed[np.array(r["index"], np.int64)] += np.array(r["value"]) * (r["n"] / total)
        bias += r["bias"] * r["n"] / total
    index = np.flatnonzero(mixed)
    return SparseWeights(index.astype(np.int64), mixed[index].astype(np.float32), bias, params.bits)


def _scores(data: np.ndarray, offs: np.ndarray, w: np.ndarray, model: SparseWeights) -> np.ndarray:
    rows, feats = hashed_features(data, offs, model.bits)
    hit = w[feats] != 0
    rows, feats = _distinct(rows[hit], feats[hit], model.bits)
    total = np.bincount(rows, weights=w[feats], minlength=len(offs) - 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score_toxicity(docs: DataFrame, model: SparseWeights) -> DataFrame:
    """``doc_id, score, predicted`` of every row; a map only.

    Each distinct feature of a text counts once, however often it occurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.dense()
        for part, data, offs in text_slices(batches, "text"):
            score = _scores(data, offs, w, shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: SparseWeights) -> DataFrame:
    """The rows, with all their columns, whose score is under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.dense()
        for part, data, offs in text_slices(batches, "text"):
            yield part.filter(pa.array(_scores(data, offs, w, shared.value) < 0.5))

    return map_rows(docs, scan)


#: Fold rule of the registered query: remainder 0 of 5 is held out.
FOLDS, HELD_OUT = 5, 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """Score all documents with a model that never saw the held-out fold."""
    model = train_toxicity(docs, labels, fold_of("doc_id", FOLDS) != HELD_OUT, params)
    return score_toxicity(docs, model).select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
