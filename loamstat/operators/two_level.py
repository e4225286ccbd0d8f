"""Calibration by two levels of replicates: outer data sets, inner permutations of each (R9), and null correlations.

An outer replicate shuffles the samples of all features alike and adds known
shifts to group X, so every method meets the same data.  Inner replicates permute the groups of
one outer data set again.  Both are keyed arithmetically, and all outer
replicates go through each step in one job, told apart by ``rep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import cumulative_count, global_rank
from loamstat.functions.special import t_two_sided
from loamstat.functions.work import materialize
from loamstat.operators import calibrate, multitest, stats
from loamstat.operators.correlate import BLOCK, complete_linkage, n_eff_of, pearson_edges
from loamstat.operators.correlate import unit_rows as _unit_rows
from loamstat.operators.factor import MAX_COLUMNS, cross_products
from loamstat.operators.resample import block_t, keyed, shuffled_x

#: Bytes of Gram matrices, one an outer replicate, that may come to the driver.
GRAM_BYTES = 1 << 28

SPECTRAL = ("bonf_spectral", "fdr_spectral")
CLUSTERED = ("bonf_cluster", "fdr_cluster", "combined_min", "combined_geometric", "combined_harmonic")
RESAMPLED = ("westfall_young", "reiner_bh", "reiner_by")
METHODS = (*calibrate.METHODS, *SPECTRAL, *CLUSTERED, *RESAMPLED)


def outer_replicates(packed: DataFrame, n_x: int, outer: int, shifts: DataFrame | None = None, seed: int = 1, equal_var: bool = True, key: str = "feature_id") -> DataFrame:
    """``(rep, feature_id, v, t, p, effect)``: each feature's samples shuffled, shifted in its first ``n_x``, and tested.

    ``shifts`` is ``(feature_id, shift)``; a feature with a shift other than 0 has an effect.
    """
    known = packed.select(F.col(key).cast("long").alias("feature_id"), "v")
    known = known.join(shifts.select("feature_id", F.col("shift").cast("double").alias("shift")), "feature_id", "left") if shifts is not None else known.withColumn("shift", F.lit(None).cast("double"))

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if pdf.empty:
                continue
            x = np.stack(pdf.v.to_numpy()).astype(float)
            shift = pdf["shift"].fillna(0.0).to_numpy(float)
            samples = np.arange(x.shape[1])
            first = (samples < n_x).astype(float)[None, :]
            for rep in range(1, outer + 1):
                order = np.lexsort((samples, keyed(np.array([rep]), samples, seed)[0]))
                mixed = x[:, order] + shift[:, None] * first
                t, dof = block_t(mixed - mixed.mean(axis=1, keepdims=True), first, equal_var)
                yield pd.DataFrame({"rep": rep, "feature_id": pdf.feature_id.to_numpy(), "v": list(mixed), "t": t[0], "p": t_two_sided(t, dof)[0], "effect": shift != 0})

    return known.mapInPandas(walk, "rep long, feature_id long, v array<double>, t double, p double, effect boolean")


def inner_statistics(data: DataFrame, n_x: int, inner: int, seed: int = 1, equal_var: bool = True) -> DataFrame:
    """``(rep, inner, feature_id, t)``: the statistics of every outer data set under ``inner`` permutations."""

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for rep, own in pdf.groupby("rep"):
                for at in range(0, len(own), 500):
                    few = own.iloc[at : at + 500]
                    x = np.stack(few.v.to_numpy())
                    ids = np.arange(inner)
                    t, _ = block_t(x - x.mean(axis=1, keepdims=True), shuffled_x(int(rep) * inner + ids, np.arange(x.shape[1]), n_x, seed + 7919), equal_var)
                    yield pd.DataFrame({"rep": rep, "inner": np.repeat(ids, len(few)), "feature_id": np.tile(few.feature_id.to_numpy(), inner), "t": t.ravel()})

    return data.select("rep", "feature_id", "v").mapInPandas(walk, "rep long, inner long, feature_id long, t double")


def westfall_young_thresholds(resampled: DataFrame, inner: int, alpha: float = 0.05) -> DataFrame:
    """``(rep, threshold)``: of the inner replicates' largest |t|, descending, the ``int(alpha * inner)``-th (from 0)."""
    most = resampled.groupBy("rep", "inner").agg(F.max(F.abs("t")).alias("most"))
    order = Window.partitionBy("rep").orderBy(F.col("most").desc(), "inner")  # a row an inner replicate
    return most.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") == int(alpha * inner)).select("rep", F.col("most").alias("threshold"))


def pooled_p(tests: DataFrame, resampled: DataFrame) -> DataFrame:
    """``p_resampled`` of ``(rep, feature_id, t)``: the share of the replicate's pooled |t| at or above its own.

    One count over all replicates, in the order of (replicate, falling |t|), less what belongs to those before.
    """
    pool = resampled.select("rep", F.lit(None).cast("long").alias("feature_id"), F.abs("t").alias("size"), F.lit(1).alias("drawn"))
    seen = tests.select("rep", "feature_id", F.abs("t").alias("size"), F.lit(0).alias("drawn"))
    place = F.struct(F.col("rep"), (-F.col("size")).alias("size"))
    merged = cumulative_count(pool.unionByName(seen).withColumn("place", place), F.col("place"), F.col("drawn") == 1, "above")
    per = materialize(resampled.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "drawn")
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rep").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row an outer replicate
    own = merged.where("drawn = 0").join(before, "rep").select("rep", "feature_id", ((F.col("above") - F.col("before")) / F.col("n")).alias("p_resampled"))
    return tests.join(own, ["rep", "feature_id"])


def spectral_numbers(data: DataFrame, outer: int, method: str = "nyholt") -> dict[int, int]:
    """Effective number of tests of every outer data set, from the eigenvalues of a Gram matrix over its samples."""
    samples = data.agg(F.max(F.size("v"))).first()[0] or 0
    if samples > MAX_COLUMNS or outer * samples * samples * 8 > GRAM_BYTES:
        raise ValueError("too many samples for Gram matrices on the driver; take fewer outer replicates a call")

    def unit(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            x = np.stack(pdf.v.to_numpy()) if len(pdf) else np.zeros((0, 1))
            x = x - x.mean(axis=1, keepdims=True)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"rep": pdf.rep, "u": list(np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12))})

    grams = cross_products(data.select("rep", "v").mapInPandas(unit, "rep long, u array<double>"), F.col("u"), by="rep")
    return {rep: n_eff_of(np.linalg.eigvalsh(q), int(m), method) for rep, (m, _, q) in grams.items()}


def replicate_edges(data: DataFrame, min_r: float, key: str = "feature_id", block: int | None = None) -> DataFrame:
    """``(rep, i, j, r)``, i < j: correlations of at least ``min_r`` inside each replicate; a task multiplies two blocks of one."""
    return pearson_edges(data, key=key, block=block, min_r=min_r, by=("rep",))


def replicate_clusters(data: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``(rep, feature_id, cluster)``: complete linkage of every outer data set, cut at distance ``threshold``, in one run.

    Features outside all clusters are clusters of their own.
    """
    names = global_rank(data.select("feature_id").distinct(), [F.col("feature_id")], "place")
    width = names.count() + 1
    numbered = materialize(data.join(names, "feature_id").select("rep", "feature_id", F.col("place").cast("long").alias("place"), "v"), "numbered")
    node = lambda c: F.col("rep") * width + F.col(c)
    edges = replicate_edges(numbered, 1 - threshold, "place")
    near = complete_linkage(edges.select(node("i").alias("i"), node("j").alias("j"), F.greatest(F.lit(0.0), 1 - F.col("r")).alias("distance")), threshold)
    own = numbered.select("rep", "feature_id", node("place").alias("node"))
    return own.join(near, "node", "left").select("rep", "feature_id", F.coalesce("cluster", "node").alias("cluster"))


def two_level_calibration(
    packed: DataFrame,
    n_x: int,
    outer: int,
    inner: int,
    shifts: DataFrame | None = None,
    methods: tuple[str, ...] = METHODS,
    alpha: float = 0.05,
    threshold: float = 0.1,
    seed: int = 1,
    equal_var: bool = True,
    key: str = "feature_id",
) -> DataFrame:
    """``(method, rep, fn, fp, rejections, n_effects, n_tests)`` of every outer replicate under each method.

    ``*_spectral`` and ``*_cluster`` put an effective number of tests in place
    of their number; ``combined_*`` correct the combined p of each cluster's
    members; ``westfall_young`` rejects beyond the inner replicates' largest |t|, ``reiner_*`` correct the share
    of pooled inner |t| at or above one's own.
    """
    wrong = set(methods) - set(METHODS)
    if wrong:
        raise ValueError(f"unknown methods: {sorted(wrong)}")
    data = materialize(outer_replicates(packed, n_x, outer, shifts, seed, equal_var, key), "outer")
    tests = data.select("rep", "feature_id", "t", "p", "effect")
    out = []

    def add(method: str, decided: DataFrame) -> None:
        r, e = F.col("reject"), F.col("effect")
        n = lambda c: F.sum(c.cast("long"))
        out.append(decided.groupBy("rep").agg(n(~r & e).alias("fn"), n(r & ~e).alias("fp"), n(r).alias("rejections"), n(e).alias("n_effects"), F.count(F.lit(1)).alias("n_tests")).select(F.lit(method).alias("method"), "*"))

    for m in methods:
        if m in calibrate.METHODS:
            add(m, calibrate.decide(tests, m, alpha))
    if set(methods) & set(SPECTRAL):
        numbers = spectral_numbers(data, outer)
        _effective(add, tests, data.sparkSession.createDataFrame(sorted(numbers.items()), "rep long, m_eff long"), "spectral", methods, alpha)
    if set(methods) & set(CLUSTERED):
        labels = materialize(replicate_clusters(data, threshold), "clusters")
        _effective(add, tests, labels.groupBy("rep").agg(F.count_distinct("cluster").alias("m_eff")), "cluster", methods, alpha)
        for how in ("min", "geometric", "harmonic"):
            if f"combined_{how}" in methods:
                combined = stats.combine_pvalues(tests.join(labels, ["rep", "feature_id"]), "cluster", how).withColumn("p", F.col("p_combined"))
                add(f"combined_{how}", calibrate.decide(combined, "fdr_bh", alpha))
    if set(methods) & set(RESAMPLED):
        resampled = materialize(inner_statistics(data, n_x, inner, seed, equal_var), "inner")
        if "westfall_young" in methods:
            limit = westfall_young_thresholds(resampled, inner, alpha)
            add("westfall_young", tests.join(limit, "rep").withColumn("reject", F.abs("t") > F.col("threshold")))
        if set(methods) & {"reiner_bh", "reiner_by"}:
            pooled = materialize(pooled_p(tests, resampled).withColumn("p", F.col("p_resampled")), "pooled")
            for m in ("bh", "by"):
                if f"reiner_{m}" in methods:
                    add(f"reiner_{m}", calibrate.decide(pooled, f"fdr_{m}", alpha))
    return stats.combine_results(*out)


def _effective(add, tests: DataFrame, numbers: DataFrame, kind: str, methods: tuple[str, ...], alpha: float) -> None:  # noqa: ANN001
    known = tests.join(numbers, "rep")
    if f"bonf_{kind}" in methods:
        add(f"bonf_{kind}", known.withColumn("reject", F.col("p") * F.col("m_eff") < alpha))
    if f"fdr_{kind}" in methods:
        # Benjamini-Hochberg at alpha m / m_eff
        adjusted = multitest.adjust(tests, "fdr_bh", ["rep"]).select("rep", "feature_id", "effect", "p_fdr_bh")
        counts = tests.groupBy("rep").agg(F.count("p").alias("m"))
        decided = adjusted.join(numbers, "rep").join(counts, "rep")
        add(f"fdr_{kind}", decided.withColumn("reject", F.col("p_fdr_bh") <= alpha * F.col("m") / F.col("m_eff")))


# --- R7 ------------------------------------------------------------------------

#: A correlation is counted in steps of 2^-30; its place has 31 bits, found 15 and 16 at a time.
_STEPS = 30
#: Replicates that one task walks for its two blocks of features.
REP_BLOCK = 50


def null_correlations(packed: DataFrame, reps: int, seed: int = 1, quantiles: tuple[float, ...] = (0.025, 0.975), key: str = "feature_id", block: int = BLOCK, rep_block: int = REP_BLOCK) -> DataFrame:
    """``(rep, q0, q1, ..)``: quantiles of all pairs' correlations after shuffling every feature's samples.

    A task gets two blocks of features and some replicates, shuffles and
    multiplies them, and counts the correlations in steps of 2^-30: first by
    their upper 15 bits, then, inside the quantiles' steps, by the lower 16.
    So two jobs serve all replicates, no pair leaves a task, and the order
    statistics are exact to a step.  The driver gets one number a replicate and quantile.
    """
    parts = max(1, -(-packed.count() // block))
    dealt = packed.select(F.col(key).cast("long").alias("k"), "v", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("b"))
    placed = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit((max(reps, 1) - 1) // rep_block))))
    placed = placed.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("o")

    def counted(inside: dict[int, list[int]] | None) -> DataFrame:
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            bi, bj, c = pdf.bi.iloc[0], pdf.bj.iloc[0], int(pdf.c.iloc[0])
            sides = []
            for b in (bi, bj):
                own = pdf[pdf.b == b].sort_values("k")
                sides.append((own.k.to_numpy(), _unit_rows(np.stack(own.v.to_numpy()) if len(own) else np.zeros((0, 1)))))
            out = []
            for rep in range(c * rep_block, min(reps, (c + 1) * rep_block)):
                mixed = []
                for names, x in sides:
                    pos = np.arange(x.shape[1])
                    rows = [np.argsort(keyed(np.array([rep]), pos, seed + int(n) * 7919)[0], kind="stable") for n in names]
                    mixed.append(np.take_along_axis(x, np.array(rows).reshape(x.shape), 1) if len(names) else x)
                if not len(sides[0][0]) or not len(sides[1][0]):
                    continue
                r = np.clip(mixed[0] @ mixed[1].T, -1, 1)
                keep = sides[0][0][:, None] < sides[1][0][None, :] if bi == bj else np.ones(r.shape, bool)
                step = np.floor((r[keep] + 1) * (1 << _STEPS) + 0.5).astype(np.int64)
                high = step >> 16
                if inside is None:
                    at, n = np.unique(high, return_counts=True)
                else:
                    at, n = np.unique(step[np.isin(high, inside.get(rep, []))], return_counts=True)
                out.append(pd.DataFrame({"rep": rep, "at": at, "n": n}))
            return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})

        return placed.groupBy("bi", "bj", "c").applyInPandas(count, "rep long, at long, n long").groupBy("rep", "at").agg(F.sum("n").alias("n"))

    over = Window.partitionBy("rep")
    upto = over.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    steps = materialize(counted(None), "steps").withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(over)})
    # the first step at which the count reaches the share, and what lies before it
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.struct("at", (F.col("upto") - F.col("n")).alias("before"), F.ceil(F.col("all") * q).alias("want")))).alias(f"p{i}") for i, q in enumerate(quantiles)]
    chosen = materialize(steps.groupBy("rep").agg(*picks), "chosen")
    inside = {r["rep"]: [r[f"p{i}"]["at"] for i in range(len(quantiles))] for r in chosen.collect()}
    fine = materialize(counted(inside), "fine").withColumn("high", F.shiftright("at", 16))
    fine = fine.withColumn("upto", F.sum("n").over(Window.partitionBy("rep", "high").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).join(chosen, "rep")
    value = lambda i: F.min(F.when((F.col("high") == F.col(f"p{i}.at")) & (F.col("upto") + F.col(f"p{i}.before") >= F.col(f"p{i}.want")), F.col("at")))
    return fine.groupBy("rep").agg(*[(value(i) / float(1 << _STEPS) - 1).alias(f"q{i}") for i in range(len(quantiles))])
