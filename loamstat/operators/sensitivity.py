"""Variance-based sensitivity: input designs, Sobol, mara and FAST indices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.functions.ordered import global_rank
from loamstat.functions.selection import quantiles

Model = Callable[[list[Column]], Column]

DESIGNS = ("random", "latin", "curve", "grid")


def _unit(i: Column, j: int, seed: int) -> Column:
    return (F.pmod(F.xxhash64(i, F.lit(j), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _by_quantiles(u: Column, values: list[float], steps: int) -> Column:
    """The value at share ``u`` of a table of ``steps`` + 1 quantiles, linear in between."""
    at = u * steps
    k = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    q = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(q, k + 1) + (at - k) * (F.element_at(q, k + 2) - F.element_at(q, k + 1))


def quantile_sample(df: DataFrame, cols: list[str], n: int, design: str = "random", seed: int = 1, steps: int = 100) -> DataFrame:
    """``row_id`` and ``n`` draws of each column by its marginal quantiles.

    ``latin`` puts one draw in each of n strata, in a keyed order; ``curve`` follows FAST's search
    curve; ``grid`` walks the quantiles.  The quantile table has ``steps`` + 1 numbers a column.
    """
    spark = df.sparkSession
    probs = [i / steps for i in range(steps + 1)]
    table = quantiles(df, cols, probs)
    base = spark.range(n).withColumnRenamed("id", "row_id")
    out = []
    for j, c in enumerate(cols):
        i = F.col("row_id")
        if design == "random":
            u = _unit(i, j, seed)
        elif design == "latin":
            step = next(s for s in range(int(n * 0.618) + j | 1, 2 * n + 3, 2) if np.gcd(s, n) == 1)  # a permutation of the strata
            u = (F.pmod(i * step + (seed * 7919 + j * 104_729) % n, F.lit(n)) + _unit(i, j, seed)) / n
        elif design == "curve":
            s = (2 * i + 1) / n * np.pi - np.pi
            u = 0.5 + F.asin(F.sin(s * frequencies(len(cols))[j])) / np.pi
        else:
            u = (i + 0.5) / n
        out.append(_by_quantiles(u, table[c], steps).alias(c))
    return base.select("row_id", *out)


def frequencies(d: int) -> list[int]:
    """Odd, well separated frequencies of the search curve."""
    return [2 * (j * 4 + 5) + 1 for j in range(d)]


def sobol_indices(a: DataFrame, b: DataFrame, cols: list[str], model: Model, key: str = "row_id") -> DataFrame:
    """First-order ``s1`` and total ``st`` indices by pick-freeze: ``(factor, s1, st)``.

    Rows expand to one per factor: A with the factor from B.  ``model`` is a column expression.
    """
    both = a.alias("a").join(b.alias("b"), key)
    ya, yb = model([F.col(f"a.{c}") for c in cols]), model([F.col(f"b.{c}") for c in cols])
    mixed = [F.struct(F.lit(c).alias("factor"), model([F.col(f"{'b' if x == c else 'a'}.{x}") for x in cols]).alias("ym")) for c in cols]
    rows = both.select(ya.alias("ya"), yb.alias("yb"), F.explode(F.array(*mixed)).alias("m")).select("ya", "yb", "m.*")
    var = (F.var_pop("ya") + F.var_pop("yb")) / 2 + (F.avg("ya") - F.avg("yb")) ** 2 / 4
    out = rows.groupBy("factor").agg(var.alias("v"), F.avg(F.col("yb") * (F.col("ym") - F.col("ya"))).alias("v1"), (F.avg((F.col("ya") - F.col("ym")) ** 2) / 2).alias("vt"))
    return out.select("factor", (F.col("v1") / F.col("v")).alias("s1"), (F.col("vt") / F.col("v")).alias("st"))


def mara_indices(x: DataFrame, cols: list[str], model: Model, seed: int = 1, key: str = "row_id") -> DataFrame:
    """First-order indices from one re-ordered replicate: runs are matched on each factor's rank."""
    y1 = x.select(key, model([F.col(c) for c in cols]).alias("y"), *cols)
    # the replicate: every column in a keyed order of its own, so each value occurs again with other partners
    parts = None
    for j, c in enumerate(cols):
        one = x.select(F.col(c), F.col(key).alias(f"from_{c}"), F.xxhash64(F.col(key), F.lit(j), F.lit(seed)).alias("__h"))
        slot = global_rank(one, [F.col("__h"), F.col(f"from_{c}")], "slot").drop("__h")
        parts = slot if parts is None else parts.join(slot, "slot")
    y2 = parts.select("slot", model([F.col(c) for c in cols]).alias("y2"), *[f"from_{c}" for c in cols])
    long = y2.select("y2", F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"from_{c}").alias(key)) for c in cols])).alias("m")).select("y2", "m.*")
    met = long.join(y1.select(key, "y"), key)
    return met.groupBy("factor").agg((F.covar_pop("y", "y2") / F.sqrt(F.var_pop("y") * F.var_pop("y2"))).alias("s1"))


def _spectrum(sample: DataFrame, y: Column, n: int, waves: Column, by: list[str], key: str) -> DataFrame:
    """``(by, wave, p)``: squared Fourier coefficients of ``y`` along the search curve, for the waves of each row."""
    s = (2 * F.col(key) + 1) / n * np.pi - np.pi
    rows = sample.select(*by, y.alias("y"), s.alias("s"), F.explode(waves).alias("wave"))
    part = lambda f: F.avg(F.col("y") * f(F.col("wave") * F.col("s"))) ** 2
    return rows.groupBy(*by, "wave").agg((part(F.cos) + part(F.sin)).alias("p"))


def fast_indices(sample: DataFrame, cols: list[str], y: Column, harmonics: int = 4, key: str = "row_id") -> DataFrame:
    """D1 / V from Fourier sums over one search curve for all factors; ``sample`` is a ``curve`` design
    of more than ``2 * harmonics * max(frequencies)`` rows."""
    n = sample.count()
    w = frequencies(len(cols))
    if n <= 2 * max(w) * harmonics:
        raise ValueError(f"a curve of {n} rows can't hold {harmonics} harmonics of {max(w)}")
    own = [(c, wi * h) for c, wi in zip(cols, w, strict=True) for h in range(1, harmonics + 1)]
    power = _spectrum(sample, y, n, F.array(*[F.lit(k) for k in sorted({k for _, k in own})]), [], key)
    total = sample.agg(F.var_pop(y).alias("v")).first()["v"]
    table = sample.sparkSession.createDataFrame(own, "factor string, wave int")
    first = power.join(F.broadcast(table), "wave").groupBy("factor").agg(F.sum("p").alias("p"))  # a few rows a factor
    return first.select("factor", (2 * F.col("p") / F.lit(total)).alias("s1"))


def fast_design(df: DataFrame, cols: list[str], n: int, harmonics: int = 4, steps: int = 100) -> DataFrame:
    """E12's design for both indices: ``(factor, row_id, cols)``, a search curve of ``n`` rows for every factor.

    The factor runs at the highest frequency the curve can hold, the others at low ones, spread up to
    ``high / (2 harmonics)``.
    """
    high, low = _fast_frequencies(n, harmonics, len(cols))
    probs = [i / steps for i in range(steps + 1)]
    table = quantiles(df, cols, probs)
    base = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    s = (2 * F.col("row_id") + 1) / n * np.pi - np.pi
    out = None
    for f in cols:
        others = iter(low)
        one = base.select(F.lit(f).alias("factor"), "row_id", *[_by_quantiles(0.5 + F.asin(F.sin(s * (high if c == f else next(others)))) / np.pi, table[c], steps).alias(c) for c in cols])
        out = one if out is None else out.unionByName(one)
    return out


def _fast_frequencies(n: int, harmonics: int, d: int) -> tuple[int, list[int]]:
    high = (n - 1) // (2 * harmonics)
    most = high // (2 * harmonics)
    if most < 1:
        raise ValueError(f"a curve of {n} rows is too short for {harmonics} harmonics")
    return high, [1 + (i * max(most - 1, 0)) // max(d - 2, 1) if most >= d - 1 else i % most + 1 for i in range(d - 1)]


def fast_total_indices(design: DataFrame, cols: list[str], y: Column, harmonics: int = 4, key: str = "row_id") -> DataFrame:
    """``(factor, s1, dt, st)`` of a ``fast_design``: D1 / V, Dt / V (all that the other factors explain
    without this one) and the total index 1 - Dt / V."""
    n = design.agg(F.count_distinct(key).alias("n")).first()["n"]
    high, _ = _fast_frequencies(n, harmonics, len(cols))
    waves = F.array(*[F.lit(k) for k in [*range(1, high // 2 + 1), *(high * h for h in range(1, harmonics + 1))]])
    power = _spectrum(design, y, n, waves, ["factor"], key)
    sums = power.groupBy("factor").agg(F.sum(F.when(F.col("wave") >= high, F.col("p"))).alias("d1"), F.sum(F.when(F.col("wave") <= high // 2, F.col("p"))).alias("dt"))
    total = design.groupBy("factor").agg(F.var_pop(y).alias("v"))
    share = lambda c: 2 * F.col(c) / F.col("v")
    return sums.join(total, "factor").select("factor", share("d1").alias("s1"), share("dt").alias("dt"), (1 - share("dt")).alias("st"))


def fix_factor(sample: DataFrame, name: str, value: float | None = None) -> DataFrame:
    """A column set to its mean, or to a value."""
    return sample.withColumn(name, F.lit(float(sample.agg(F.avg(name)).first()[0] if value is None else value)))


def unit_sample(spark: SparkSession, n: int, cols: list[str], seed: int) -> DataFrame:
    """Keyed uniform columns."""
    return spark.range(n).select(F.col("id").alias("row_id"), *[_unit(F.col("id"), j, seed).alias(c) for j, c in enumerate(cols)])
