"""Ranks, reshaping and windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.ordered import global_rank


def rank_abs(df: DataFrame, by: list[str], value: str = "value", ties: str = "max", scale: bool = False) -> DataFrame:
    """Rank of -abs(value) per ``by``; ties share their largest (or smallest) rank; ``scale`` makes the least 0."""
    order = Window.partitionBy(*by).orderBy(F.abs(value).desc())
    rank = F.count(value).over(order) if ties == "max" else F.rank().over(order)
    out = df.withColumn("rank", rank.cast("long"))
    return out.withColumn("rank", F.col("rank") - F.min("rank").over(Window.partitionBy(*by))) if scale else out


def rank_spread(ranks: DataFrame, by: list[str], rank: str = "rank", digits: int = 9) -> DataFrame:
    """Sample variance and sd of a variable's ranks, and the rank of the sd; sds that are equal in ``digits`` decimals tie."""
    if dict(ranks.dtypes)[rank] in ("int", "bigint"):  # from exact sums: running means leave a last digit to the order of the rows
        r, n = F.col(rank).cast("long"), F.col("__n").cast("double")
        sums = ranks.groupBy(*by).agg(F.count(r).alias("__n"), F.sum(r).alias("__s"), F.sum(r * r).alias("__q"))
        dec = lambda c: F.col(c).cast("decimal(20,0)")
        spread = (dec("__n") * dec("__q") - dec("__s") * dec("__s")).cast("double")
        per = sums.withColumn("rank_var", F.when(n > 1, spread / (n * (n - 1)))).withColumn("rank_sd", F.sqrt("rank_var")).select(*by, "rank_var", "rank_sd")
    else:
        per = ranks.groupBy(*by).agg(F.var_samp(rank).alias("rank_var"), F.stddev_samp(rank).alias("rank_sd"))
    groups = [c for c in by if c != "variable"]
    order = Window.partitionBy(*groups).orderBy(F.round("rank_sd", digits).desc())  # ties apart from rounding
    return per.withColumn("sd_rank", F.count("rank_sd").over(order))


def rank_diff(ranks: DataFrame, a: str, b: str, on: list[str], method: str = "method", rank: str = "rank") -> DataFrame:
    """Rank of method ``a`` minus rank of method ``b``, and its absolute value."""
    side = lambda m, n: ranks.where(F.col(method) == m).select(*on, F.col(rank).alias(n))
    d = F.col("__a") - F.col("__b")
    return side(a, "__a").join(side(b, "__b"), on).select(*on, d.alias("diff"), F.abs(d).alias("abs_diff"))


def stack_ranks(frames: dict[str, DataFrame], name: str = "method") -> DataFrame:
    """Stack tables by column name, tagged."""
    out = None
    for tag, df in frames.items():
        tagged = df.withColumn(name, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def to_long(wide: DataFrame, ids: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], name, value)


def to_wide(long: DataFrame, ids: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """Long to wide; the columns are named, so no extra pass looks for them."""
    return long.groupBy(*ids).pivot(name, columns).agg(F.first(value))


def split_name(col: Column, sep: str, parts: list[str]) -> list[Column]:
    """Parts of a compound name."""
    return [F.split(col, sep)[i].alias(p) for i, p in enumerate(parts)]


def topk(df: DataFrame, col: str, k: int, ascending: bool = True, by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """The k smallest or largest rows, overall or per group; ties by ``key``."""
    order = [F.col(col).asc() if ascending else F.col(col).desc(), *([F.col(key)] if key else [])]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def tail_dependence(df: DataFrame, p1: str, p2: str, th: float, share: float, window: int, left: bool = True, by: list[str] | None = None, key: str = "feature_id") -> DataFrame:
    """Rows sorted by ``p2``, the lowest (or highest) share kept; per position the share of
    ``p1 < th`` over the ``window`` rows from it on, and the half-width of ``p2`` over them.

    Full windows only.  With ``by`` each group is a window partition.  One
    large group is ranked by range partitions and cut into runs of positions
    that overlap by a window, so no task holds the whole order.
    """
    first = F.col(p2).asc() if left else F.col(p2).desc()
    if by:
        every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(first, key)
        ranked = df.withColumns({"__r": F.row_number().over(order), "__n": F.count(F.lit(1)).over(every)})
        kept, keys = ranked.where(F.col("__r") <= F.floor(F.col("__n") * share)), list(by)
        own = F.lit(True)
    else:
        last = int(share * df.count())
        ranked = global_rank(df, [first, F.col(key)], "__r").where(F.col("__r") <= last)
        run = max(4 * window, 10_000)
        home = F.floor((F.col("__r") - 1) / run)
        back = F.floor((F.col("__r") - window) / run)  # an earlier run may reach this row
        kept = ranked.withColumn("__run", F.explode(F.array_distinct(F.array(home, F.greatest(back, F.lit(0))))))
        keys, own = ["__run"], F.floor((F.col("__r") - 1) / run) == F.col("__run")
    frame = Window.partitionBy(*keys).orderBy("__r").rowsBetween(0, window - 1)
    width = (F.max(p2).over(frame) - F.min(p2).over(frame)) / 2
    out = kept.withColumns({"share": F.avg((F.col(p1) < th).cast("double")).over(frame), "half_width": width, "__c": F.count(F.lit(1)).over(frame)})
    return out.where((F.col("__c") == window) & own).select(*(by or []), F.col("__r").alias("position"), "share", "half_width")


def line_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line and correlation."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("corr"))


def interval_dependence(df: DataFrame, p1_cols: list[str], p2: str, at: float, th: float, width: int, key: str = "feature_id") -> DataFrame:
    """Share of each ``p1 < th`` among the width/2 rows on either side of ``at`` in the order of ``p2``.

    Only the nearest rows on each side are sorted (top-k), never the table.
    """
    half = width // 2
    below = df.where(F.col(p2) < at).orderBy(F.col(p2).desc(), F.col(key).desc()).limit(half)
    above = df.where(F.col(p2) >= at).orderBy(F.col(p2), F.col(key)).limit(half)
    return below.unionByName(above).agg(*[F.avg((F.col(c) < th).cast("double")).alias(c) for c in p1_cols])


def model_delta(paths: DataFrame, by: list[str] | None = None, weights: tuple[float, float] = (0.5, 1.0), order: str = "lambda") -> DataFrame:
    """Change of the support size along a path ``(lambda, size)`` and its centred change:
    ``w1 * (next - previous)`` plus ``w2 * (second next - second previous)``."""
    along = Window.partitionBy(*(by or [])).orderBy(order)  # a path has as many rows as lambdas
    near = F.lead("size", 1).over(along) - F.lag("size", 1).over(along)
    far = F.lead("size", 2).over(along) - F.lag("size", 2).over(along)
    return paths.withColumns({"delta": F.col("size") - F.lag("size").over(along), "sliding": weights[1] * near + weights[0] * far})
