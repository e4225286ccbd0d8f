"""Projections, cleaning and filters over long observations.

``obs`` is ``(feature_id, sample_id, grp, value, gap_status)``; column names
are arguments where more than one table shape uses a function.  NaN values
are refused by ``check_values`` unless it is asked to drop them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import global_rank
from loamstat.functions.selection import quantiles
from loamstat.functions.work import materialize

VARIANCE = {0: F.var_pop, 1: F.var_samp}


def melt_matrix(wide: DataFrame, samples: DataFrame, areas: list[str], gaps: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """IO2: a wide matrix to long observations; the i-th area and gap column belong together.

    ``samples`` (sample_id, grp) is joined on the area column's name.
    """
    keys = keys or [c for c in wide.columns if c not in areas and c not in (gaps or [])]
    cells = [
        F.struct(F.lit(a).alias("sample_id"), F.col(f"`{a}`").cast("double").alias("value"), (F.col(f"`{gaps[i]}`") if gaps else F.lit(None)).cast("int").alias("gap_status"))
        for i, a in enumerate(areas)
    ]
    long = wide.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")
    return assign_groups(long, samples)


def assign_groups(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """label samples by group; a left join, unknown samples get a null group."""
    return obs.join(samples.select("sample_id", "grp"), "sample_id", "left")


def check_values(obs: DataFrame, drop: bool = False) -> DataFrame:
    """NaN values raise at run time, or are dropped if asked for."""
    if drop:
        return obs.where(~F.isnan("value"))
    return obs.withColumn("value", F.when(F.isnan("value"), F.raise_error(F.lit("NaN among the values"))).otherwise(F.col("value")).cast("double"))


def log2_values(obs: DataFrame) -> DataFrame:
    """F1."""
    return obs.withColumn("value", F.log2("value"))


def fill_gaps(obs: DataFrame, code: int = 0) -> DataFrame:
    """a null gap code becomes ``code``."""
    return obs.fillna(code, subset=["gap_status"])


def drop_high_delta(features: DataFrame, tol: float = 1000.0, delta: str = "delta") -> DataFrame:
    """F3."""
    return features.where(F.abs(delta) <= tol)


def sample_id(name: Column) -> Column:
    """the last ``_`` part of a file name, up to its first dot."""
    return F.substring_index(F.substring_index(name, "_", -1), ".", 1)


def align_samples(area: DataFrame, gap: DataFrame) -> DataFrame:
    """gap rows whose sample has an area column; both orders must agree.

    Inputs are ``(position, sample_id)``; raises where the order differs.
    """
    kept = gap.join(area.select("sample_id"), "sample_id", "left_semi")
    rank = lambda df: global_rank(df, [F.col("position")], "place")
    both = rank(kept).alias("g").join(rank(area.join(kept.select("sample_id"), "sample_id", "left_semi")).alias("a"), F.expr("g.sample_id = a.sample_id"))
    ok = F.when(F.col("g.place") == F.col("a.place"), F.col("g.place")).otherwise(F.raise_error(F.lit("samples are in another order")).cast("long"))
    return both.select("g.sample_id", "g.position", ok.cast("int").alias("place"))


def masstime(mass: Column, rtime: Column) -> Column:
    """the ``mass@time`` key from the source texts."""
    return F.concat_ws("@", mass, rtime)


def split_masstime(key: Column) -> Column:
    """struct of mass and time."""
    parts = F.split(key, "@")
    return F.struct(parts[0].cast("double").alias("mass"), parts[1].cast("double").alias("rtime"))


def filter_features(obs: DataFrame, measure: Column, keep: Callable[[Column], Column], by: str = "feature_id", name: str = "measure") -> DataFrame:
    """keep features whose aggregated ``measure`` passes; the measure is carried along."""
    kept = obs.groupBy(by).agg(measure.alias(name)).where(keep(F.col(name)))
    return obs.join(kept, by)


def _threshold_or_share(obs: DataFrame, measure: Column, val: float, method: str, strict: bool, by: str) -> DataFrame:
    per = obs.groupBy(by).agg(measure.alias("measure"))
    if method == "threshold":
        return obs.join(per.where(F.col("measure") > val if strict else F.col("measure") >= val), by)
    per = materialize(per, "measures")
    cut = quantiles(per, ["measure"], [float(val)])["measure"][0]
    return obs.join(per.where(F.col("measure") > F.lit(cut)), by)


def variance_filter(obs: DataFrame, val: float, method: str = "threshold", ddof: int = 1, strict: bool = True, by: str = "feature_id") -> DataFrame:
    """F8: keep features by variance: above a threshold, or above a quantile (``method='proportion'``)."""
    return _threshold_or_share(obs, VARIANCE[ddof]("value"), val, method, strict, by)


def mean_filter(obs: DataFrame, val: float, method: str = "threshold", strict: bool = True, by: str = "feature_id") -> DataFrame:
    """the same by the absolute mean."""
    return _threshold_or_share(obs, F.abs(F.avg("value")), val, method, strict, by)


def mad_filter(obs: DataFrame, th: float, by: str = "feature_id") -> DataFrame:
    """keep features whose mean absolute deviation from the mean is ``th`` or more."""
    means = obs.groupBy(by).agg(F.avg("value").alias("__m"))
    kept = obs.join(means, by).groupBy(by).agg(F.avg(F.abs(F.col("value") - F.col("__m"))).alias("measure")).where(F.col("measure") >= th)
    return obs.join(kept, by)


def drop_bottom(tests: DataFrame, crit: Column, prop: float, key: str = "feature_id") -> DataFrame:
    """drop the K = int(prop * m) rows lowest in ``crit`` (ties by ``key``), by exact global rank."""
    ranked = global_rank(tests.withColumn("__c", crit), [F.col("__c"), F.col(key)], "__rank")
    m = tests.count()
    return ranked.where(F.col("__rank") > int(prop * m)).drop("__c", "__rank")


ACCEPTED = (0, 8, 64, 128)


def group_gaps(obs: DataFrame, accept: tuple[int, ...] = ACCEPTED) -> DataFrame:
    """Share of accepted gap codes and count of others per feature and group."""
    good = F.col("gap_status").isin(*accept)
    return obs.groupBy("feature_id", "grp").agg(F.avg(good.cast("double")).alias("accepted"), F.sum((~good).cast("long")).alias("gaps"), F.count(F.lit(1)).alias("n"))


def reliability(obs: DataFrame, contrasts: DataFrame, tol: float = 0.8, accept: tuple[int, ...] = ACCEPTED) -> DataFrame:
    """per feature and contrast, is either side's accepted share ``tol`` or more; gaps of both sides."""
    per = group_gaps(obs, accept)
    x = per.select("feature_id", F.col("grp").alias("grp_x"), F.col("accepted").alias("ax"), F.col("gaps").alias("gaps1"))
    y = per.select("feature_id", F.col("grp").alias("grp_y"), F.col("accepted").alias("ay"), F.col("gaps").alias("gaps2"))
    sides = F.broadcast(contrasts)  # a handful of pairs of groups
    return x.join(sides, "grp_x").join(y, ["feature_id", "grp_y"]).select("feature_id", "contrast", "gaps1", "gaps2", ((F.col("ax") >= tol) | (F.col("ay") >= tol)).alias("reliable"))


def reliable_features(obs: DataFrame, tol: float = 0.8, accept: tuple[int, ...] = (0, 64, 128)) -> DataFrame:
    """features whose accepted share over all their samples is ``tol`` or more."""
    share = F.avg(F.col("gap_status").isin(*accept).cast("double"))
    return obs.groupBy("feature_id").agg(share.alias("accepted")).where(F.col("accepted") >= tol)


def absent_present(rel: DataFrame, hi: int, lo: int) -> DataFrame:
    """``hi`` or more gaps on one side and ``lo`` or fewer on the other."""
    return rel.where(((F.col("gaps1") >= hi) & (F.col("gaps2") <= lo)) | ((F.col("gaps2") >= hi) & (F.col("gaps1") <= lo)))


def get_features(obs: DataFrame, keys: DataFrame, on: str | list[str] = "feature_id") -> DataFrame:
    """F16: rows whose key is listed."""
    return obs.join(keys, on, "left_semi")


def null_features(obs: DataFrame, tests: DataFrame, on: str | list[str] = "feature_id") -> DataFrame:
    """rows of features without a rejected test (matched on the whole key)."""
    return obs.join(tests.where("reject"), on, "left_anti")


def extract_pvalues(tests: DataFrame, keys: DataFrame, on: str = "feature_id") -> DataFrame:
    """the tests of each listed key, sorted by contrast."""
    return tests.join(keys, on, "left_semi").groupBy(on).agg(F.array_sort(F.collect_list(F.struct("contrast", "p", "fc"))).alias("tests"))


def remove_sparse_columns(df: DataFrame, tol: float = 0.99, keep: tuple[str, ...] = ()) -> DataFrame:
    """drop numeric columns whose share of zeros is above ``tol``; one pass."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in keep]
    if not numeric:
        return df
    share = df.agg(*[F.avg((F.col(f"`{c}`") == 0).cast("double")).alias(c) for c in numeric]).first().asDict()
    return df.drop(*[c for c in numeric if (share[c] or 0) > tol])


def moments(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample sd of columns: one row to the driver."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, cols: list[str], center: bool = True, scale: bool = True) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """centre and scale columns; also their means and sample sds.  A constant column becomes 0."""
    known = moments(df, cols)
    out = {}
    for c in cols:
        m, s = known[c]
        x = F.col(c) - F.lit(m if center else 0.0)
        out[c] = x / F.lit(s) if scale and s else x
    return df.withColumns(out), known


def scale_to_ranges(sample: DataFrame, ref: DataFrame, cols: list[str]) -> DataFrame:
    """columns in [0, 1] to the ranges observed in ``ref``."""
    row = ref.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return sample.withColumns({c: F.lit(row[f"lo_{c}"]) + F.col(c) * F.lit(row[f"hi_{c}"] - row[f"lo_{c}"]) for c in cols})


def prepare_regression(df: DataFrame, target: str, ids: list[str]) -> DataFrame:
    """drop id columns, log the target, then standardise everything numeric."""
    kept = df.drop(*ids).withColumn(target, F.ln(target))
    return standardize(kept, kept.columns)[0]


def randomize_column(df: DataFrame, col: str, share: float, key: str, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """replace a keyed share of a column by draws: uniform in its range, or normal with its moments."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    u = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if kind == "uniform":
        draw = F.lit(row["lo"]) + u(1) * F.lit(row["hi"] - row["lo"])
    else:
        draw = F.lit(row["m"]) + F.lit(row["s"] or 0.0) * F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))
    return df.withColumn(col, F.when(u(0) < share, draw).otherwise(F.col(col)))


def group_residuals(obs: DataFrame) -> DataFrame:
    """subtract the group's mean inside each feature."""
    mean = F.avg("value").over(Window.partitionBy("feature_id", "grp"))
    return obs.withColumn("value", F.col("value") - mean)


def remove_effects(obs: DataFrame, tests: DataFrame, control: str, factor: float = 1.0) -> DataFrame:
    """in features with a rejected test, x - factor * group mean + control mean."""
    hit = tests.where("reject").select("feature_id").distinct().withColumn("__hit", F.lit(True))
    mean = F.avg("value").over(Window.partitionBy("feature_id", "grp"))
    base = F.avg(F.when(F.col("grp") == control, F.col("value"))).over(Window.partitionBy("feature_id"))
    moved = F.col("value") - factor * mean + base
    return obs.join(hit, "feature_id", "left").withColumn("value", F.when(F.col("__hit"), moved).otherwise(F.col("value"))).drop("__hit")


def remove_pair_effects(obs: DataFrame, tests: DataFrame, x: str, y: str) -> DataFrame:
    """inside one contrast, pull the higher group down to the lower group's mean where its test is rejected."""
    hit = tests.where("reject").select("feature_id").distinct().withColumn("__hit", F.lit(True))
    by = Window.partitionBy("feature_id")
    mx, my = (F.avg(F.when(F.col("grp") == g, F.col("value"))).over(by) for g in (x, y))
    own = F.when(F.col("grp") == x, mx).otherwise(my)
    pair = obs.where(F.col("grp").isin(x, y)).join(hit, "feature_id", "left")
    return pair.withColumn("value", F.when(F.col("__hit"), F.col("value") - own + F.least(own, mx, my)).otherwise(F.col("value"))).drop("__hit")
