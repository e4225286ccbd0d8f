"""Quality: attention-based multiple-instance learning over passages.

A document is a bag of passages (runs of ``passage_words`` words; the last
may be shorter; every word of the text is in one).  Each passage is encoded
by a learned tanh layer over its surface statistics and a signed hash
projection of its words.  Gated attention, ``softmax(w . (tanh(V h) *
sigmoid(U h)))`` over the bag, weighs the passages; a linear unit scores the
weighted sum.  Only documents carry labels; passage weights are learned from
them.

Training is data-parallel with averaging: shards of a bounded labelled sample
run a few epochs from shared parameters, the parameters are averaged, and so
on for some rounds.  The parameter vector has a fixed small size.

Edge cases: null, empty and word-less texts are empty bags and score by the
unit's bias; repeated rows score alike; without labels the initial parameters
are used (score near 0.5).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstat.llm.common import map_rows, materialize, mix64, text_slices
from loamstat.llm.sampling import fold_of, labelled_sample, one_per_id
from loamstat.llm.wordhash import SPACED, ngrams, words


@dataclass(frozen=True)
class MilParams:
    """``sample``: bound of labelled documents used; shards of ``per_shard`` train apart for ``epochs`` in each of ``rounds``."""

    passage_words: int = 48
    hidden: int = 24
    attention: int = 12
    projected: int = 256
    sample: int = 12_000
    per_shard: int = 4_000
    rounds: int = 3
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 5


_CLASS = np.full(256, 4, np.uint8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f")):
    _CLASS[[ord(c) for c in _chars]] = _i
for _i, _chars in enumerate(("\n", "!?", "#$%&*@^~+", "|<>{}[]=_/\\`", ".,;:", "'\"-()"), 5):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0x80:] = 11
CLASSES = 12
EXTRA = 5


def _first_seen(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where a value occurs for the first time in its row."""
    key = mix64(h ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    out = np.zeros(len(key), bool)
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out[order[new]] = True
    return out


def encode_passages(data: np.ndarray, offs: np.ndarray, p: MilParams) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, feature matrix) of a slice."""
    w = words(data, offs, SPACED)
    width = CLASSES + EXTRA + p.projected
    if len(w.hash) == 0:
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    begin = np.searchsorted(w.doc, w.doc)  # first word of the row
    place = (np.arange(len(w.doc)) - begin) // p.passage_words
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    of_word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w.doc))))
    row = w.doc[starts]
    # bytes: a passage's reach from its first word to the next passage's first word or the row's end
    byte_from = w.start[starts]
    nxt = np.append(w.start[starts[1:]], offs[-1])
    byte_to = np.minimum(nxt, offs[row + 1])
    length = byte_to - byte_from
    of_byte = np.repeat(np.arange(len(starts)), length)
    at = np.arange(length.sum()) + np.repeat(byte_from - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    counts = np.bincount(of_byte * CLASSES + _CLASS[data[at]], minlength=len(starts) * CLASSES).reshape(-1, CLASSES)
    n = np.bincount(of_word).astype(np.float64)
    new_word = np.bincount(of_word, _first_seen(w.doc, w.hash)) / n
    repeat = np.zeros(len(w.hash))
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    h3, at3 = ngrams(w, 3)
    new_three = np.ones(len(w.hash))
    new_three[at3] = _first_seen(w.doc[at3], h3)
    span = (w.end - w.start).astype(np.float64)
    extra = np.stack(
        [
            new_word,
            np.bincount(of_word, repeat) / n,
            np.bincount(of_word, new_three) / n,
            np.log1p(np.bincount(of_word, span) / n),
            np.log1p(n) / np.log1p(p.passage_words),
        ],
        axis=1,
    )
    slot = (w.hash % np.uint64(p.projected)).astype(np.int64)
    sign = np.where(w.hash >> np.uint64(63), 1.0, -1.0)
    projected = np.bincount(of_word * p.projected + slot, sign, len(starts) * p.projected).reshape(-1, p.projected)
    x = np.concatenate([np.sqrt(counts / length[:, None]) * 3, extra * 2, projected / np.sqrt(n)[:, None] * 0.5], axis=1)
    return row, x.astype(np.float32)


def _shapes(p: MilParams) -> list[tuple[int, ...]]:
    d = CLASSES + EXTRA + p.projected
    return [(d, p.hidden), (p.hidden,), (p.hidden, p.attention), (p.hidden, p.attention), (p.attention,), (p.hidden,), (1,)]


def init_params(p: MilParams) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(p.seed))
    return np.concatenate([(rng.normal(size=s) / np.sqrt(s[0]) * (len(s) > 1 or k == 4)).ravel() for k, s in enumerate(_shapes(p))])


def _unpack(theta: np.ndarray, p: MilParams) -> list[np.ndarray]:
    out, at = [], 0
    for s in _shapes(p):
        k = int(np.prod(s))
        out.append(theta[at : at + k].reshape(s))
        at += k
    return out


def _sums(x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
    out = np.zeros((bags, *x.shape[1:]))
    np.add.at(out, bag, x) if x.ndim == 1 else out.__iadd__(np.stack([np.bincount(bag, x[:, j], bags) for j in range(x.shape[1])], axis=1))
    return out


def forward(theta: np.ndarray, x: np.ndarray, bag: np.ndarray, bags: int, p: MilParams) -> tuple:
    """Logits of the bags, attention weights, and what the gradient needs."""
    w1, b1, v, u, wa, c, b = _unpack(theta, p)
    h = np.tanh(x @ w1 + b1)
    tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -30, 30)))
    e = (tv * su) @ wa
    top = np.full(bags, -np.inf)
    np.maximum.at(top, bag, e)
    a = np.exp(e - top[bag])
    a /= np.bincount(bag, a, bags)[bag]
    z = _sums(a[:, None] * h, bag, bags)
    return z @ c + b[0], a, (h, tv, su, z)


def gradient(theta: np.ndarray, x: np.ndarray, bag: np.ndarray, y: np.ndarray, p: MilParams) -> np.ndarray:
    w1, b1, v, u, wa, c, b = _unpack(theta, p)
    logit, a, (h, tv, su, z) = forward(theta, x, bag, len(y), p)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    gz = d[:, None] * c
    from_z = (h * gz[bag]).sum(1)
    ge = a * (from_z - np.bincount(bag, a * from_z, len(y))[bag])
    gt = ge[:, None] * wa
    gv, gu = gt * su * (1 - tv**2), gt * tv * su * (1 - su)
    gh = (a[:, None] * gz[bag] + gv @ v.T + gu @ u.T) * (1 - h**2)
    parts = [x.T @ gh, gh.sum(0), h.T @ gv, h.T @ gu, (tv * su).T @ ge, z.T @ d, np.array([d.sum()])]
    return np.concatenate([g.ravel() for g in parts]) + p.decay * theta


def train_epochs(theta: np.ndarray, x: np.ndarray, bag: np.ndarray, y: np.ndarray, p: MilParams, round_no: int) -> np.ndarray:
    """Adam over mini-batches of bags; ``bag`` ascends."""
    theta, m, s = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
    cut = np.searchsorted(bag, np.arange(len(y) + 1))
    rng = np.random.Generator(np.random.PCG64([p.seed, round_no]))
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), p.batch):
            own = order[k : k + p.batch]
            rows = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in own])
            g = gradient(theta, x[rows].astype(np.float64), np.repeat(np.arange(len(own)), cut[own + 1] - cut[own]), y[own], p)
            step += 1
            m = 0.9 * m + 0.1 * g
            s = 0.999 * s + 0.001 * g * g
            theta -= p.rate / (1 + round_no) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return theta


def train_quality(docs: DataFrame, labels: DataFrame, allowed: Column, p: MilParams = MilParams()) -> np.ndarray:
    """Parameters from labelled rows that ``allowed`` admits."""
    sample = labelled_sample(docs, labels, "quality", allowed, p.sample, p.per_shard)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            row, x = encode_passages(data, offs, p)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            flat = [x[cut[r] : cut[r + 1]].ravel() for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(flat, pa.list_(pa.float32()))], ["doc_id", "y", "shard", "mark", "x"])

    bags = materialize(one_per_id(sample.mapInArrow(encode, "doc_id long, y double, shard int, mark long, x array<float>")), "passages")
    theta = init_params(p)
    width = _shapes(p)[0][0]
    for r in range(p.rounds):
        fit = _fitter(theta, r, width, p)
        got = bags.where("size(x) > 0").groupBy("shard").applyInArrow(fit, "shard int, n long, theta array<double>").collect()
        if got:
            got = sorted(got, key=lambda g: g["shard"])
            theta = sum(np.array(g["theta"]) * g["n"] for g in got) / sum(g["n"] for g in got)
    return theta


def _fitter(theta: np.ndarray, round_no: int, width: int, p: MilParams) -> Callable[[pa.Table], pa.Table]:
    """One shard's epochs of one round."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        bags = table.column("x").combine_chunks()
        x = bags.flatten().to_numpy().reshape(-1, width)  # single precision, not copied
        bag = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy() // width)
        got = train_epochs(theta, x, bag, table.column("y").to_numpy(), p, round_no)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(bags)], pa.int64()), "theta": pa.array([got], pa.list_(pa.float64()))})

    return fit


def _scores(data: np.ndarray, offs: np.ndarray, theta: np.ndarray, p: MilParams) -> np.ndarray:
    row, x = encode_passages(data, offs, p)
    return 1 / (1 + np.exp(-np.clip(forward(theta, x, row, len(offs) - 1, p)[0], -35, 35)))


def score_quality(docs: DataFrame, theta: np.ndarray, p: MilParams = MilParams()) -> DataFrame:
    """``doc_id, score, predicted`` of every row; a map only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            score = _scores(data, offs, theta, p)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, score double, predicted int")


def drop_low_quality(docs: DataFrame, theta: np.ndarray, p: MilParams = MilParams()) -> DataFrame:
    """The rows, with all their columns, whose score is 0.5 or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            yield part.filter(pa.array(_scores(data, offs, theta, p) >= 0.5))

    return map_rows(docs, scan)


def passage_attention(docs: DataFrame, theta: np.ndarray, p: MilParams = MilParams()) -> DataFrame:
    """``(doc_id, passage, weight)``: the attention every passage gets in its document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            row, x = encode_passages(data, offs, p)
            weight = forward(theta, x, row, part.num_rows, p)[1]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "passage", "weight"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, passage long, weight double")


#: Fold rule of the registered query: remainder 1 of 3 is held out.
FOLDS, HELD_OUT = 3, 1


def quality_scores(docs: DataFrame, labels: DataFrame, p: MilParams = MilParams()) -> DataFrame:
    """Score all documents with a model that never saw the held-out fold."""
    theta = train_quality(docs, labels, fold_of("doc_id", FOLDS) != HELD_OUT, p)
    return score_quality(docs, theta, p).select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
