"""Exact quantiles of many columns at once, by counted bits of doubles.

A double's bits, with the sign turned round, order as the numbers do.  The n-th
smallest value of a column is found from its highest bits down: each round counts
the rows under the bits known so far by their next ``WIDTH`` bits.  All columns and
quantiles share the four rounds; nothing holds values, so memory does not grow with
the number of distinct ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that one round adds.
WIDTH = 16
_SIGN = np.uint64(1 << 63)


def order_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that order as ``x`` does: -0.0 equals 0.0, NaN is the largest."""
    b = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(b & _SIGN, ~b, b | _SIGN)


def from_bits(bits: np.ndarray) -> np.ndarray:
    """The doubles of ``order_bits``."""
    return np.where(bits & _SIGN, bits & ~_SIGN, ~bits).view(np.float64)


def first_beyond(v: np.ndarray, tol: float) -> np.ndarray:
    """The smallest double ``u`` with ``u - v > tol`` as doubles subtract, by halving its bits; NaN if there is none."""
    two, end = np.uint64(2), order_bits(np.array([np.inf]))[0] + np.uint64(1)
    with np.errstate(invalid="ignore"):
        lo, hi = order_bits(v), np.full(len(v), end)
        near = order_bits(v + tol)  # the sum, but for rounding
        low, top = np.maximum(near - two, lo), np.minimum(near + two, end)
        within = (from_bits(top) - v > tol) & ~(from_bits(low) - v > tol)
        lo, hi = np.where(within, low, lo), np.where(within, top, hi)
        while (lo < hi).any():
            mid = lo + (hi - lo) // two
            far = from_bits(mid) - v > tol
            lo, hi = np.where(far, lo, np.where(lo < hi, mid + np.uint64(1), lo)), np.where(far, mid, hi)
    return from_bits(lo)


def _counter(known: list[np.ndarray], shift: int, width: int):  # noqa: ANN202
    """Counts of the next ``width`` bits for the rows whose higher bits are among ``known`` of their column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, prefixes in enumerate(known):
                b = order_bits(batch.column(j).drop_null().to_numpy(zero_copy_only=False).astype(float))
                head = b >> np.uint64(shift + width) if shift + width < 64 else np.zeros_like(b)
                at = np.searchsorted(prefixes, head)
                hit = (at < len(prefixes)) & (prefixes[np.minimum(at, len(prefixes) - 1)] == head) if len(prefixes) else np.zeros(len(b), bool)
                slots, n = np.unique(b[hit] >> np.uint64(shift), return_counts=True)
                if len(slots):
                    head, digit = slots >> np.uint64(width), slots & np.uint64((1 << width) - 1)
                    yield pa.RecordBatch.from_pydict({"j": np.full(len(slots), j, np.int32), "head": head.astype(np.int64), "digit": digit.astype(np.int32), "n": n.astype(np.int64)})

    return count


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, as ``percentile`` gives them: nulls are left out, linear between two values.

    A column without values has null quantiles.  ``df`` is read five times, these columns only; freeze it
    first where it is costly to make.  The driver gets two numbers a column and quantile.
    """
    picked = df.select(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    sizes = picked.agg(*[F.count(f"c{j}") for j in range(len(cols))]).first()
    places = {j: [p * (n - 1) for p in probs] for j, n in enumerate(sizes) if n}
    want = {(j, r): (0, r + 1) for j, at in places.items() for p in at for r in (math.floor(p), math.ceil(p))}
    top = 64
    while top and want:
        width = min(WIDTH, top)
        top -= width
        known = [np.array(sorted({head for (k, _), (head, _) in want.items() if k == j}), np.uint64) for j in range(len(cols))]
        counts = picked.mapInArrow(_counter(known, top, width), "j int, head long, digit int, n long").groupBy("j", "head", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("j", "head").orderBy("digit"))  # at most 2^WIDTH rows
        of = list(zip(*((j, r, head, left) for (j, r), (head, left) in want.items()), strict=True))
        asked = df.sparkSession.createDataFrame(pa.table({"j": pa.array(of[0], pa.int32()), **{c: pa.array(v, pa.int64()) for c, v in zip(("r", "head", "left"), of[1:], strict=True)}}))
        met = counts.withColumn("upto", upto).join(F.broadcast(asked), ["j", "head"]).where("left <= upto and left > upto - n")
        found = met.select("j", "r", "head", "digit", (F.col("left") - F.col("upto") + F.col("n")).alias("left")).collect()
        want = {(x.j, x.r): (x.head << width | x.digit, x.left) for x in found}
    value = {k: float(from_bits(np.array([head], np.uint64))[0]) for k, (head, _) in want.items()}

    def at(j: int, p: float) -> float:
        lo, hi = math.floor(p), math.ceil(p)
        a, b = value[j, lo], value[j, hi]
        return a if lo == hi or a == b else (hi - p) * a + (p - lo) * b

    return {c: [at(j, p) for p in places[j]] if j in places else [None] * len(probs) for j, c in enumerate(cols)}
