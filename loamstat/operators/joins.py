"""Band, proximity and value-similarity joins, and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions import blocks
from loamstat.functions.blocks import dealt_block
from loamstat.functions.ordered import global_rank, suffix_min
from loamstat.functions.selection import first_beyond
from loamstat.functions.work import materialize


def _bands(df: DataFrame, col: str, tol: float, name: str, reach: bool) -> DataFrame:
    """Adds a bucket of width ``tol`` (or, with ``reach``, a row for each bucket within ``tol``)."""
    if tol <= 0:
        return df.withColumn(name, F.col(col).cast("double"))
    b = F.floor(F.col(col) / tol)
    return df.withColumn(name, F.explode(F.array(b - 1, b, b + 1)) if reach else b)


def _dealt_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join of buckets that makes many rows of few: both sides are dealt over all shuffle partitions and
    merged, since a small side would be broadcast and small sides would be joined in a few tasks."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on)


#: Rows that share a place (both values), on average, from which places are joined and not rows.
PACKED = 4


def _ahead(dm: float, dt: float) -> Column:
    """A row for its own bucket and for each of the neighbours behind it."""
    steps = [(a, b) for a in ((0, 1) if dm > 0 else (0,)) for b in ((-1, 0, 1) if dt > 0 else (0,)) if (a, b) >= (0, 0)]
    return F.explode(F.array(*[F.struct((F.col("__bm") + a).alias("m"), (F.col("__bt") + b).alias("t"), F.lit((a, b) == (0, 0)).alias("own")) for a, b in steps]))


def _packed_duplicates(features: DataFrame, dm: float, dt: float, key: str, mass: str, rtime: str) -> DataFrame:
    """``masstime_duplicates`` by places: ``(mass, rtime)`` with all their keys."""
    at = features.groupBy(F.col(mass).cast("double").alias("m"), F.col(rtime).cast("double").alias("t")).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    placed = _bands(_bands(at, "m", dm, "__bm", False), "t", dt, "__bt", False)
    left = placed.select(_ahead(dm, dt).alias("__at"), *[F.col(c).alias(f"{c}_l") for c in ("m", "t", "keys")])
    left = left.select(F.col("__at.m").alias("__bm"), F.col("__at.t").alias("__bt"), F.col("__at.own").alias("__own"), "m_l", "t_l", "keys_l")
    right = placed.select("__bm", "__bt", *[F.col(c).alias(f"{c}_r") for c in ("m", "t", "keys")])
    d_m, d_t = F.abs(F.col("m_l") - F.col("m_r")), F.abs(F.col("t_l") - F.col("t_r"))
    equal = (F.col("m_l") == F.col("m_r")) & (F.col("t_l") == F.col("t_r"))
    # in a bucket, two places meet once, and a place itself
    once = ~F.col("__own") | (F.col("m_l") < F.col("m_r")) | ((F.col("m_l") == F.col("m_r")) & (F.col("t_l") <= F.col("t_r")))
    met = _dealt_join(left, right, ["__bm", "__bt"]).where(once & (d_m <= dm) & (d_t <= dt))
    pairs = met.select(equal.alias("__equal"), d_m.alias("dm"), d_t.alias("dt"), F.explode("keys_l").alias("k"), "keys_r").select("__equal", "dm", "dt", "k", F.explode("keys_r").alias("l"))
    pairs = pairs.where((F.col("k") < F.col("l")) | (~F.col("__equal") & (F.col("k") > F.col("l"))))
    return pairs.select(F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j"), "dm", "dt")


def masstime_duplicates(features: DataFrame, dm: float, dt: float, key: str = "feature_id", mass: str = "mass", rtime: str = "rtime") -> DataFrame:
    """Pairs i < j with |dm| and |dt| within their tolerances, and both differences.

    Both axes are bucketed by their tolerance and one side looks into its own bucket and the four
    neighbours behind it, so every pair of buckets meets once: an equi-join whose buckets hold near rows only.
    Where few places hold the rows, places meet with lists of their keys, and pairs are made behind the join.
    """
    rows, places = features.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(mass, rtime))).first()
    if rows >= PACKED * max(places, 1):
        return _packed_duplicates(features, dm, dt, key, mass, rtime)
    side = lambda s: [F.col(key).alias(f"{key}_{s}"), F.col(mass).alias(f"m_{s}"), F.col(rtime).alias(f"t_{s}")]
    placed = _bands(_bands(features, mass, dm, "__bm", False), rtime, dt, "__bt", False)
    left = placed.select(_ahead(dm, dt).alias("__at"), *side("l")).select(F.col("__at.m").alias("__bm"), F.col("__at.t").alias("__bt"), F.col("__at.own").alias("__own"), f"{key}_l", "m_l", "t_l")
    right = placed.select("__bm", "__bt", *side("r"))
    d_m, d_t = F.abs(F.col("m_l") - F.col("m_r")), F.abs(F.col("t_l") - F.col("t_r"))
    once = F.when(F.col("__own"), F.col(f"{key}_l") < F.col(f"{key}_r")).otherwise(F.col(f"{key}_l") != F.col(f"{key}_r"))
    met = _dealt_join(left, right, ["__bm", "__bt"]).where(once & (d_m <= dm) & (d_t <= dt))
    return met.select(F.least(f"{key}_l", f"{key}_r").alias("i"), F.greatest(f"{key}_l", f"{key}_r").alias("j"), d_m.alias("dm"), d_t.alias("dt"))


def value_duplicates(obs: DataFrame, tol: float) -> DataFrame:
    """Feature pairs whose share of equal values over the same samples is ``tol`` or more.

    Features have one value per sample.  Of n samples two such features agree
    on ceil(tol * n) cells.  With every feature's cells in one order, the rarest
    (sample, value) first, they then share one of their first
    n - ceil(tol * n) + 1 cells, so only these meet; imputed constants come
    last and rarely join.  Pairs that met are compared in full.  Where values are so few that
    the rarest cells meet about as many pairs as there are, all pairs are compared block by block.
    """
    cells = materialize(obs.select("feature_id", "sample_id", "value"), "cells")
    total = cells.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    need = max(1, math.ceil(tol * total))
    known = cells.where("value is not null")
    common = known.groupBy("sample_id", "value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rare = Window.partitionBy("feature_id").orderBy("held", "sample_id")
    # cells that no other feature has meet nothing, but they take the first places
    placed = known.join(common, ["sample_id", "value"], "left").withColumn("held", F.coalesce("held", F.lit(1))).withColumn("place", F.row_number().over(rare))
    keys = placed.where((F.col("place") <= total - need + 1) & (F.col("held") > 1))
    a, b = (keys.select(F.col("feature_id").alias(x), "sample_id", "value") for x in ("i", "j"))
    packed = materialize(known.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "value"))).alias("s")), "packed")
    sums = keys.groupBy("sample_id", "value").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n"))
    count, samples = packed.count(), cells.select("sample_id").distinct().count()
    if (sums.first()["n"] or 0) > count * (count - 1) / 2 / OFTEN_MET and samples <= 4 * total:
        both = _equal_cells(packed, need, samples)
        return both.where(F.col("equal") >= F.lit(tol * total)).select("i", "j", (F.col("equal") / total).alias("similarity"))
    met = a.join(b, ["sample_id", "value"]).where("i < j").select("i", "j").distinct()
    x, y = (packed.select(F.col("feature_id").alias(n), F.col("s.sample_id").alias(f"s{n}"), F.col("s.value").alias(f"v{n}"), F.col("s").alias(f"c{n}")) for n in ("i", "j"))
    aligned = F.aggregate(F.zip_with("vi", "vj", lambda u, v: (u == v).cast("long")), F.lit(0).cast("long"), lambda t, e: t + e)
    equal = F.when(F.col("si") == F.col("sj"), aligned).otherwise(F.size(F.array_intersect("ci", "cj")).cast("long"))
    both = met.join(x, "i").join(y, "j").select("i", "j", equal.alias("equal"))
    return both.where(F.col("equal") >= F.lit(tol * total)).select("i", "j", (F.col("equal") / total).alias("similarity"))


#: All pairs are compared block by block where the rarest cells would meet more than one in so many.
OFTEN_MET = 50


def _equal_cells(packed: DataFrame, need: int, samples: int) -> DataFrame:
    """``(i, j, equal)``: all pairs of ``(feature_id, s)`` with ``need`` equal cells or more, block by block; a task holds some rows' counts at a time."""
    n = packed.count()
    parts = max(1, -(-n // min(dealt_block(n), max(200, HELD // max(samples, 1)))))
    dealt = packed.withColumn("b", F.pmod(F.xxhash64("feature_id"), F.lit(parts)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = dealt.select("feature_id", F.col("s.sample_id").alias("at"), F.col("s.value").alias("value"), "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        names, block = (table.column(c).to_numpy() for c in ("feature_id", "b"))
        lists = table.column("at").combine_chunks()
        rows = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = pd.factorize(lists.flatten().to_pandas())[0]
        codes = pd.factorize(table.column("value").combine_chunks().flatten().to_pandas(), use_na_sentinel=False)[0] + 2
        left, right = (block == table.column(c)[0].as_py() for c in ("bi", "bj"))
        wide = np.zeros((at.max(initial=0) + 1, len(names)), np.min_scalar_type(codes.max(initial=0)))
        wide[at, rows] = codes
        u, v = np.ascontiguousarray(wide[:, left].T), np.ascontiguousarray(wide[:, right])
        v[v == 0] = 1  # missing cells equal nothing
        a, b, one = names[left], names[right], table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        step = max(1, HELD // 4 // max(len(b), 1))
        for first in range(0, len(a) if len(b) else 0, step):
            part, own = u[first : first + step], a[first : first + step]
            equal = np.zeros((len(own), len(b)), np.min_scalar_type(len(v)))
            for s in range(len(v)):
                equal += part[:, s, None] == v[s]
            x, y = np.nonzero(equal >= need)
            i, j, e = own[x], b[y], equal[x, y].astype(np.int64)
            keep = i < j if one else np.ones(len(i), bool)
            i, j, e = i[keep], j[keep], e[keep]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(e)], ["i", "j", "equal"])

    return placed.groupBy("bi", "bj").applyInArrow(pairs, "i long, j long, equal long")


def cross_source_duplicates(features: DataFrame, dm: float, dt: float, source: str = "source", mass: str = "mass", rtime: str = "rtime") -> DataFrame:
    """Pairs of distinct keys of different sources within tolerance, with the actual differences."""
    keys = features.select(source, mass, rtime).distinct()
    side = lambda s: [F.col(source).alias(f"source_{s}"), F.col(mass).alias(f"m_{s}"), F.col(rtime).alias(f"t_{s}")]
    left = _bands(_bands(keys, mass, dm, "__bm", True), rtime, dt, "__bt", True).select("__bm", "__bt", *side("l"))
    right = _bands(_bands(keys, mass, dm, "__bm", False), rtime, dt, "__bt", False).select("__bm", "__bt", *side("r"))
    d_m, d_t = F.col("m_l") - F.col("m_r"), F.col("t_l") - F.col("t_r")
    met = _dealt_join(left, right, ["__bm", "__bt"]).where((F.col("source_l") < F.col("source_r")) & (F.abs(d_m) <= dm) & (F.abs(d_t) <= dt))
    return met.drop("__bm", "__bt").withColumns({"dm": d_m, "dt": d_t})


def proximity_pairs(df: DataFrame, col: str, tol: float, key: str, soft: bool = False, mult: float = 1.0) -> DataFrame:
    """Pairs i < j within ``tol`` on one axis; weight 1, or ``max(0, 1 - mult * distance)``."""
    left = _bands(df, col, tol, "__b", True).select("__b", F.col(key).alias("i"), F.col(col).alias("x"))
    right = _bands(df, col, tol, "__b", False).select("__b", F.col(key).alias("j"), F.col(col).alias("y"))
    d = F.abs(F.col("x") - F.col("y"))
    weight = F.greatest(F.lit(0.0), 1 - mult * d) if soft else F.lit(1.0)
    return _dealt_join(left, right, ["__b"]).where((F.col("i") < F.col("j")) & (d <= tol)).select("i", "j", d.alias("distance"), weight.alias("weight"))


def map_cluster_ids(tests: DataFrame, clusters: DataFrame, on: str = "feature_id") -> DataFrame:
    """Cluster ids on test rows; tests outside all clusters get null."""
    return tests.join(clusters, on, "left")


#: Distances that a task holds at a time (32 MB).
HELD = 4_000_000
#: Rows of a block that give its queries their first bounds.
SEEDS = 2048
#: Near pairs that a task holds (16 MB) before it measures them and drops all but the k nearest of each query.
NEAR_PAIRS = 1_000_000
#: Pairs that are measured at a time (8 MB of 64 numbers each).
MEASURED = 16_384


class _Best:
    """The k nearest of the rows ``v`` for every query ``u``, out of the pairs added.

    ``bound`` is what a pair's closeness must reach: that of k rows known by then, the query's own row left out.
    """

    def __init__(self, own: np.ndarray, u: np.ndarray, names: np.ndarray, v: np.ndarray, k: int, metric: str, far: np.ndarray | None = None) -> None:
        self.own, self.u, self.names, self.v, self.k, self.metric = own, u, names, v, k, metric
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if far is not None:  # distances within which k rows are known, NaN where they aren't
            self.bound = np.where(np.isnan(far), -np.inf, self.closeness(far))
            return
        some = slice(None, None, max(1, len(v) // SEEDS))
        right = _right(v[some], metric, -1)
        n = len(right)
        self.bound = np.full(len(u), -np.inf)
        if n >= k:
            for x in range(0, len(u), blocks.TILE[0]):
                s = _left(u[x : x + blocks.TILE[0]], metric, -1) @ right.T
                s[(own[x : x + len(s), None] == names[None, some]) | np.isnan(s)] = -np.inf
                self.bound[x : x + len(s)] = np.partition(s, n - k, axis=1)[:, n - k]

    def closeness(self, d: np.ndarray) -> np.ndarray:
        return 1 - d if self.metric == "cosine" else -0.5 * d**2

    def add(self, query: np.ndarray, row: np.ndarray) -> None:
        self.new.append((query, row))
        self.held += len(query)
        if self.held > NEAR_PAIRS:
            self.measure()

    def measure(self) -> None:
        """Distances from the differences, so equal rows tie exactly; ties go to the smaller key."""
        if not self.new:
            return
        q, r = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new, self.held = [], 0
        other = self.own[q] != self.names[r]
        q, r = q[other], r[other]
        d = np.empty(len(q))
        for x in range(0, len(q), MEASURED):
            a, b = self.u[q[x : x + MEASURED]], self.v[r[x : x + MEASURED]]
            if self.metric == "cosine":
                d[x : x + MEASURED] = 1 - (a * b).sum(1)
            else:
                a -= b
                a *= a
                d[x : x + MEASURED] = np.sqrt(a.sum(1))
        real = np.isfinite(d)
        q, r, d = (np.concatenate(x) for x in zip(self.kept, (q[real], r[real], d[real]), strict=True))
        order = np.lexsort((r, d, q))  # rows lie in the order of their keys
        q, r, d = q[order], r[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept = tuple(x[rank < self.k] for x in (q, r, d))
        last = rank == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], self.closeness(d[last]))

    def found(self) -> pa.RecordBatch:
        self.measure()
        q, r, d = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.own[q], pa.int64()), pa.array(self.names[r], pa.int64()), pa.array(d)], ["key", "neighbour", "distance"])


def _share(m: np.ndarray, metric: str, sign: int, kind: type = float) -> np.ndarray:
    """What a row adds to a pair's closeness beside the product; ``sign`` times all that rounding to ``kind`` can change is added."""
    square = (m * m).sum(1)
    return sign * 2 * (m.shape[1] + 8) * np.finfo(kind).eps * square - (0 if metric == "cosine" else square / 2)


def _left(m: np.ndarray, metric: str, sign: int, kind: type = float) -> np.ndarray:
    return np.column_stack([m, np.ones(len(m)), _share(m, metric, sign, kind)]).astype(kind)


def _right(m: np.ndarray, metric: str, sign: int, kind: type = float) -> np.ndarray:
    return np.column_stack([m, _share(m, metric, sign, kind), np.ones(len(m))]).astype(kind)


def _kind(u: np.ndarray, v: np.ndarray, best: _Best) -> type:
    """Single precision for tiles where it holds the squares and its rounding is small beside the distances looked for."""
    squares = np.concatenate([(m * m).sum(1) for m in (u, v)])
    some = squares[squares != 0]
    if not len(some) or not (np.isfinite(some).all() and some.max() < 1e30 and some.min() > 1e-20):
        return float
    known = best.bound[np.isfinite(best.bound)]
    least = np.median(1 - known if best.metric == "cosine" else -known) if len(known) else 0.0
    return np.float32 if least > 200 * (u.shape[1] + 8) * np.finfo(np.float32).eps * some.max() else float


def _floor(bound: np.ndarray, kind: type) -> np.ndarray:
    return bound if kind is float else np.nextafter(bound.astype(kind), kind(-np.inf))


def _places(hit: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a matrix with few hits, eight cells at a time."""
    flat = hit.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    word, at = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + at


def _met(own: np.ndarray, u: np.ndarray, names: np.ndarray, v: np.ndarray, k: int, metric: str, both: bool = False, far: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """The k nearest of the rows ``v`` for every query ``u``, keys ascending on each side; with ``both`` also the nearest of ``u`` for every ``v``.

    A tile's products (less half the squares: minus half the squared distance) are compared with the queries' bounds, and
    only pairs that reach them are measured; rounding is allowed for, so none is lost.  ``far`` has both sides'
    distances within which k rows are known; pairs beyond are left out.
    """
    if metric == "cosine":
        u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (u, v))
    far = far or (None, None)
    with np.errstate(all="ignore"):
        rows, columns = _Best(own, u, names, v, k, metric, far[0]), _Best(names, v, own, u, k, metric, far[1]) if both else None
        kind = _kind(u, v, rows)
        left, right = _left(u, metric, 1, kind), _right(v, metric, 1, kind)
        for x, y in blocks.tiles(len(u), len(v), False):
            s = left[x] @ right[y].T
            q, r = np.divmod(_places(s >= _floor(rows.bound[x, None], kind)), s.shape[1])
            rows.add(q + x.start, r + y.start)
            if columns:
                r, q = np.divmod(_places(s >= _floor(columns.bound[None, y], kind)), s.shape[1])
                columns.add(q + y.start, r + x.start)
        yield rows.found()
        if columns:
            yield columns.found()


def _nearest(k: int, metric: str):  # noqa: ANN202
    """A task's k nearest ``y`` rows (``q`` false) of every ``x`` row (``q`` true)."""

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = (table.filter(c).sort_by("key") for c in (table.column("q"), pc.invert(table.column("q"))))
        del table
        if a.num_rows and b.num_rows:
            yield from _met(a.column("key").to_numpy(), blocks.matrix(a), b.column("key").to_numpy(), blocks.matrix(b), k, metric)

    def nearest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(rows, pd.DataFrame):  # a group in pandas, its neighbours in their order
            found = pa.Table.from_batches(met(pa.Table.from_pandas(rows, preserve_index=False)))
            return found.to_pandas().sort_values(["key", "distance", "neighbour"], ignore_index=True)
        return met(pa.Table.from_batches(list(rows)))

    return nearest


def _nearest_of_both(k: int, metric: str):  # noqa: ANN202
    """The same where queries and rows are one table: two blocks meet once, for the queries of both, within their distances ``far``."""

    def nearest(first: pa.Table, second: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        a, b = ((t.column("k").to_numpy(), blocks.matrix(t)) for t in (first, second))
        far = None if same else tuple(t.column("far").to_numpy() for t in (first, second))
        yield from _met(*a, *b, k, metric, not same, far)

    return nearest


def _knn_of_one(rows: DataFrame, k: int, metric: str, block: int | None) -> DataFrame:
    """``knn`` of rows ``(k, v)`` among themselves: first inside each block, then between blocks within the distances found there."""
    if block is None:
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        block = blocks.block_rows(n, width or 1)
    own = materialize(blocks.met_in_blocks(rows, _nearest_of_both(k, metric), _NEAR, block=block, own=True), "own-block")
    known = own.groupBy(F.col("key").alias("k")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("far"))
    bounded = materialize(rows.join(known, "k", "left"), "bounded")
    return _first(own.unionByName(blocks.met_in_blocks(bounded, _nearest_of_both(k, metric), _NEAR, block=block, own=False)), k)


def _distances(u: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (u, v))
        return 1 - u @ v.T
    return np.sqrt(np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * u @ v.T, 0))


_NEAR = "key long, neighbour long, distance double"


def _first(part: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(x: DataFrame, y: DataFrame, k: int, metric: str = "euclid", key: str = "vec_id", vec: str = "embedding", block: int | None = None) -> DataFrame:
    """The k nearest rows of ``y`` for every row of ``x``: ``(key, neighbour, distance, rank)``.

    Exact, so all pairs are computed: ``y`` is dealt into blocks and ``x`` into
    blocks (``dealt_block`` rows each by default); a task multiplies one pair of blocks, tile by
    tile, and keeps k rows of each query, so what is shuffled after it is k rows per query and block.  Where ``x``
    is ``y`` itself, two blocks meet once for both.  Ties go to the smaller key.  ``knn_by_cells`` looks at near rows only.
    """
    if x is y:
        rows = x.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
        return _knn_of_one(rows, k, metric, block)

    def deal(df: DataFrame, side: str) -> tuple[DataFrame, int]:
        n = df.count()
        parts = max(1, -(-n // (block or dealt_block(n))))
        return df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(side)), parts

    left, nl = deal(x, "bx")
    right, nr = deal(y, "by")
    left = left.withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("q", F.lit(True))
    right = right.withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).withColumn("q", F.lit(False))
    return _first(left.unionByName(right).groupBy("bx", "by").applyInArrow(_nearest(k, metric), _NEAR), k)


def knn_by_cells(x: DataFrame, y: DataFrame, k: int, probes: int, metric: str = "euclid", key: str = "vec_id", vec: str = "embedding", cells: int | None = None, block: int = 2000, seed: int = 1) -> DataFrame:
    """J7 approximately: ``knn`` among the rows of ``y`` in the ``probes`` cells nearest to a query.

    The cells are those of keyed rows of ``y`` as centres, by default about the
    root of their number.  Work grows with rows x root x probes instead of rows x rows; recall grows with
    ``probes`` and is 1 when all cells are probed.  Large cells are dealt into blocks on both sides.
    """
    y = materialize(y.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")), "cells")
    count = y.count()
    wanted = cells or max(1, int(np.sqrt(count)))
    drawn = y.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(wanted).select("v").collect()
    if not drawn:
        return x.select(F.col(key).cast("long").alias("key"), F.lit(0).cast("long").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    centres = x.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in drawn]))

    def placed(df: DataFrame, near: int) -> DataFrame:
        def place(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                if len(pdf):
                    d = _distances(np.stack(pdf.v.to_numpy()), centres.value, metric)
                    yield pd.DataFrame({"key": pdf["key"], "v": pdf["v"], "cell": list(np.argsort(d, axis=1, kind="stable")[:, :near])})

        return df.mapInPandas(place, "key long, v array<double>, cell array<int>").select("key", "v", F.explode("cell").alias("cell"))

    left = materialize(placed(x.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")), min(probes, len(drawn))), "queries")
    right = materialize(placed(y, 1), "placed")
    return _met_in_cells(left, right, k, metric, block)


def _met_in_cells(left: DataFrame, right: DataFrame, k: int, metric: str, block: int) -> DataFrame:
    """``knn`` of queries ``(key, v, cell)``, a row a cell looked at, among rows ``(key, v, cell)``; large cells are dealt into blocks on both sides."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = parts(left, "nx").join(parts(right, "ny"), "cell")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, "cell").select("key", "v", "cell", deal("nx").alias("bx"), every("ny").alias("by"), F.lit(True).alias("q"))
    b = right.join(sizes, "cell").select("key", "v", "cell", every("nx").alias("bx"), deal("ny").alias("by"), F.lit(False).alias("q"))
    return _first(a.unionByName(b).groupBy("cell", "bx", "by").applyInArrow(_nearest(k, metric), _NEAR), k)


#: First-level centres at most (2 MB of 64 numbers each): they are broadcast.
MOST_CELLS = 4096
#: Rows of a first-level cell that one task places in second-level cells.
PLACED_ROWS = 20_000


def _to_first_level(df: DataFrame, centres: np.ndarray, near: int, metric: str) -> DataFrame:
    """``(key, v, top)``, a row for each of the ``near`` nearest first-level centres."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def place(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                d = _distances(np.stack(pdf.v.to_numpy()), shared.value, metric)
                yield pd.DataFrame({"key": pdf["key"], "v": pdf["v"], "top": list(np.argsort(d, axis=1, kind="stable")[:, :near])})

    return df.mapInPandas(place, "key long, v array<double>, top array<int>").select("key", "v", F.explode("top").alias("top"))


def _to_second_level(df: DataFrame, centres: DataFrame, near: int, metric: str) -> DataFrame:
    """``(key, v, cell)``: rows ``(key, v, top)`` in the ``near`` nearest second-level cells of their first-level cell.

    A cell's rows are dealt over as many tasks as they need, each with the cell's centres ``(top, id, c)``.
    """
    parts = df.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / PLACED_ROWS).cast("int").alias("parts"))
    rows = df.join(parts, "top").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    copies = centres.join(parts, "top").select(F.col("top").alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of"), "id", "c")

    def place(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if own.empty or cells.empty:
            return pd.DataFrame({"key": [], "v": [], "cells": []}).astype({"key": "int64", "v": "object", "cells": "object"})
        cells = cells.sort_values("id")
        ids, centre, u, found = cells.id.to_numpy(np.int64), np.stack(cells.c.to_numpy()), np.stack(own.v.to_numpy()), []
        step = max(1, HELD // len(ids))
        for at in range(0, len(u), step):
            nearest = np.argsort(_distances(u[at : at + step], centre, metric), axis=1, kind="stable")[:, :near]
            found.extend((np.int64(own.top.iloc[0]) << 32) + ids[nearest])
        return pd.DataFrame({"key": own.key, "v": own.v, "cells": found})

    # a row leaves Python once, whatever its cells
    out = rows.groupBy("top", "part").cogroup(copies.groupBy("at", "of")).applyInPandas(place, "key long, v array<double>, cells array<long>")
    return out.select("key", "v", F.explode("cells").alias("cell"))


class TwoLevelIndex(NamedTuple):
    """First-level centres, second-level centres ``(top, id, c)``, and all rows ``(key, v, cell)``."""

    first: np.ndarray
    centres: DataFrame
    rows: DataFrame
    metric: str


def _typed(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v"))


def two_level_index(y: DataFrame, metric: str = "euclid", key: str = "vec_id", vec: str = "embedding", cells: int | None = None, seed: int = 1) -> TwoLevelIndex:
    """An index of two levels over all rows of ``y``.

    First-level centres are keyed rows of ``y``, the cube root of their number and
    ``MOST_CELLS`` at most.  Second-level centres are keyed rows of each first-level cell, about the root
    of its rows, so a row is compared with some 2 N^(1/3) centres.
    """
    rows = materialize(_typed(y, key, vec), "indexed")
    wanted = cells or min(MOST_CELLS, max(1, int(round(rows.count() ** (1 / 3)))))
    first = np.array([r["v"] for r in rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(wanted).select("v").collect()])
    placed = materialize(_to_first_level(rows, first, 1, metric), "first-level")
    share = F.sqrt("n") / F.col("n")
    mark = (F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sizes = placed.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", F.xxhash64("key", F.lit(seed + 1))).alias("least"))
    centres = placed.join(sizes, "top").where((mark < share) | (F.col("key") == F.col("least")))
    # centres of a cell whose ids fall together share one second-level cell
    centres = materialize(centres.select("top", F.pmod(F.xxhash64("key", F.lit(seed + 2)), F.lit(1 << 31)).alias("id"), F.col("v").alias("c")), "second-level")
    return TwoLevelIndex(first, centres, materialize(_to_second_level(placed, centres, 1, metric), "cells"), metric)


def search_index(index: TwoLevelIndex, x: DataFrame, k: int, probes: tuple[int, int], key: str = "vec_id", vec: str = "embedding", block: int = 2000) -> DataFrame:
    """``knn`` among the rows in the second-level cells nearest to a query, ``probes[1]`` in each of its ``probes[0]`` nearest first-level cells.

    Where that copies more rows than comparing all pairs block by block (all cells, say), all pairs are compared.
    """
    if not len(index.first):
        return _typed(x, key, vec).select("key", F.lit(0).cast("long").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    if min(probes[0], len(index.first)) * probes[1] > most_probed(index.rows.count(), x.count()):
        return knn(_typed(x, key, vec), index.rows.select("key", "v"), k, index.metric, "key", "v")
    asked = _to_first_level(_typed(x, key, vec), index.first, min(probes[0], len(index.first)), index.metric)
    return _met_in_cells(materialize(_to_second_level(asked, index.centres, probes[1], index.metric), "queries"), index.rows, k, index.metric, block)


def most_probed(rows: int, queries: int) -> float:
    """Cells a query from which on the index copies four times the rows that ``knn`` copies into its pairs of blocks; 64 at least."""
    parts = lambda n: max(1, -(-n // dealt_block(n)))
    return max(64, 4 * (parts(rows) + rows * parts(queries) / max(queries, 1)))


#: Queries on which the number of probes is measured.
RECALL_QUERIES = 64


def probes_for(index: TwoLevelIndex, x: DataFrame, k: int, recall: float, key: str = "vec_id", vec: str = "embedding", block: int = 2000) -> tuple[int, int]:
    """The first of 4, 8, 16, .. probes a level that reach ``recall`` on ``RECALL_QUERIES`` keyed queries, compared with all rows.

    Numbers at which all queries would be compared with all rows aren't measured: recall is 1 there.
    """
    few = materialize(_typed(x, key, vec).orderBy(F.xxhash64("key", F.lit(3)), "key").limit(RECALL_QUERIES), "recall")
    exact = materialize(knn(few, index.rows.select("key", "v"), k, index.metric, "key", "v"), "exact").select("key", "neighbour")
    want = exact.count()
    largest = index.centres.groupBy("top").count().agg(F.max("count")).first()[0] or 0
    most = most_probed(index.rows.count(), x.count())
    probes = 4
    while probes < max(largest, len(index.first)) and min(probes, len(index.first)) * probes <= most:
        near = search_index(index, few, k, (probes, probes), "key", "v", block)
        if exact.join(near, ["key", "neighbour"]).count() >= recall * want:
            break
        probes *= 2
    return probes, probes


def knn_two_level(x: DataFrame, y: DataFrame, k: int, probes: tuple[int, int] | None = None, metric: str = "euclid", key: str = "vec_id", vec: str = "embedding", cells: int | None = None, block: int = 2000, seed: int = 1, recall: float = 0.95) -> DataFrame:
    """J7 approximately, by ``two_level_index``.

    Recall grows with the probes and is 1 when all cells are looked at.  Without ``probes`` their number is
    measured: the least that finds the share ``recall`` of a bounded sample's exact neighbours.
    """
    index = two_level_index(y, metric, key, vec, cells, seed)
    if probes is None:
        probes = probes_for(index, x, k, recall, key, vec, block) if len(index.first) else (1, 1)
    return search_index(index, x, k, probes, key, vec, block)


def knn_classify(train: DataFrame, test: DataFrame, k: int, metric: str = "euclid", key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """Majority vote of the k nearest training rows; ties go to the smaller label."""
    near = knn(test, train, k, metric, key, vec)
    votes = near.join(train.select(F.col(key).alias("neighbour"), F.col(label).alias("vote")), "neighbour").groupBy("key", "vote").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "vote"))["vote"].alias("predicted"))
    return best.withColumnRenamed("key", key)


#: Numbers of coefficient samples that are broadcast at a time: 8 MB.
COEFFICIENTS = 1_000_000


def uncertainty_predict(rows: DataFrame, coefs: DataFrame, key: str, x: Column) -> DataFrame:
    """Predictions of every row under every coefficient sample ``(rep, beta array)``.

    ``x`` is the row's array of predictors.  The samples are packed in their order into blocks of at most
    ``COEFFICIENTS`` numbers (or one sample); a block is one row, which meets all rows by broadcast.  More
    blocks are more passes over the rows, each beside an output of a block's samples for every row.
    """
    size = coefs.agg(F.max(F.size("beta")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    each = max(1, COEFFICIENTS // max(size["width"] or 1, 1))  # samples in a block
    cast = coefs.select("rep", F.col("beta").cast("array<double>").alias("beta"))
    held = materialize(global_rank(cast, [F.col("rep"), F.col("beta")], "__n").select("rep", "beta", F.floor((F.col("__n") - 1) / each).alias("__block")), "samples")
    dot = F.aggregate(F.zip_with("__x", "__c.beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    base, out = rows.select(key, x.alias("__x")), None
    for b in range(max(1, math.ceil(size["n"] / each))):
        block = held.where(F.col("__block") == b).agg(F.collect_list(F.struct("rep", "beta")).alias("__s"))
        met = base.crossJoin(F.broadcast(block)).select(key, "__x", F.explode("__s").alias("__c"))
        one = met.select(key, F.col("__c.rep").alias("rep"), dot.alias("prediction"))
        out = one if out is None else out.unionByName(one)
    return out


def _next(tol: float) -> Callable[[pa.Table], pa.Table]:
    """Each value's next leader in its block and group (``nx``, its number); where the group goes on behind the block, what it must reach (``pos``)."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, v = (table.column(c).to_numpy() for c in ("i", "v"))
        g = table.column("g").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        pos, n = first_beyond(v, tol), len(v)
        order = np.lexsort((np.repeat([0, 1], n), np.concatenate([pos, v]), np.concatenate([g, g])))
        at = np.empty(2 * n, np.int64)
        at[order] = np.cumsum(order >= n)  # values before a reach, in the order of groups and values
        at = at[:n]
        held = (at < n) & (g[np.minimum(at, n - 1)] == g)
        return table.append_column("nx", pa.array(np.where(held, i[np.minimum(at, n - 1)], 0))).append_column("pos", pa.array(pos, mask=held | (g != g[-1]) | np.isnan(pos)))

    return find


def _leaving(n: int) -> Callable[[pa.Table], pa.Table]:
    """``(i, out)`` of a block of ``n`` values: where the leaders that follow from a value first leave the block; 0 if they end."""

    def leaving(table: pa.Table) -> pa.Table:
        i, to, at = _steps(table, n)
        while (inside := at >= 0).any():
            to[inside], at[inside] = to[at[inside]], at[at[inside]]
        return pa.table({"i": i, "out": to})

    return leaving


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def _steps(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's values in order: their numbers, the next leaders' numbers and their places in the block, or -1."""
    i, to = (table.column(c).to_numpy() for c in ("i", "nx"))
    order = np.argsort(i)
    i, to = i[order], to[order]
    at = np.where((to > 0) & (to < (i[0] - 1) // n * n + n + 1), to - i[0], -1)
    return i, to.copy(), at


def _led(n: int) -> Callable[[pa.Table], pa.Table]:
    """The leader of each value of a block whose first leaders are flagged; none for values before the first."""

    def led(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        _, _, at = _steps(table, n)
        marked = table.column("entry").to_numpy(zero_copy_only=False).copy()
        while (inside := at >= 0).any():  # marks twice as many leaders a round
            marked[at[marked & inside]] = True
            at[inside] = at[at[inside]]
        last = np.maximum.accumulate(np.where(marked, np.arange(len(at)), -1))
        v, i = (table.column(c).to_numpy() for c in ("v", "i"))
        none = last < 0
        out = {"g": table.column("g"), "v": table.column("v"), "block": table.column("block")}
        return pa.table(out | {"at": pa.array(i[last], mask=none), "leader": pa.array(v[last], mask=none)})

    return led


#: Buckets of groups whose rows are counted, to find groups of more rows than a block.
COUNTED = 1 << 16
#: Rows that a task leads at a time, and the groups' types that are dealt by hash (equal ones have equal hashes).
LED_ROWS = 200_000
DEALT_TYPES = ("tinyint", "smallint", "int", "bigint", "string", "date")


def _led_rows(by: str, tol: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns ``__v`` into ``leader`` in rows that lie in the order of (group, value), groups not parted; a group is held until it ends."""

    def lead(table: pa.Table) -> pa.Table:
        v = table.column("__v").to_numpy()
        g = table.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        some = np.flatnonzero(~np.isnan(v))
        v, g = v[some] + 0.0, g[some]
        first = np.ones(len(v), bool)
        first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        which = np.cumsum(first) - 1
        v, g = v[first], g[first]  # distinct, in order
        leader = np.full(table.num_rows, np.nan)
        if len(v):
            steps = _next(tol)(pa.table({"i": np.arange(1, len(v) + 1), "g": g, "v": v}))
            entry = np.ones(len(v), bool)
            entry[1:] = g[1:] != g[:-1]
            led = _led(len(v))(steps.append_column("entry", pa.array(entry)).append_column("block", pa.array(np.zeros(len(v), np.int64))))
            leader[some] = led.column("leader").to_numpy()[which]
        return table.drop_columns(["__v"]).append_column("leader", pa.array(leader, mask=np.isnan(leader)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LED_ROWS:
                table = pa.Table.from_batches(held)
                g = table.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                ends = int(np.searchsorted(g, g[-1])) if len(g) else 0  # codes ascend in the order of the groups
                if ends:
                    yield from lead(table.slice(0, ends)).to_batches(max_chunksize=10_000)
                # a long group is looked at again after as many rows as it has
                held = table.slice(ends).combine_chunks().to_batches()
                rows = 0 if not ends else table.num_rows - ends
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield from lead(table).to_batches(max_chunksize=10_000)

    return task


def leader_groups(df: DataFrame, key: str, col: str, tol: float, by: str | None = None, block: int = 1_000_000) -> DataFrame:
    """Sorted values grouped by leaders: a group takes all values within ``tol`` of its first.

    Groups of up to ``block`` rows are dealt by ``by``, sorted and led in one pass over their rows; larger ones (all rows
    without ``by``) are spread over tasks by ``spread_leaders``.  Rows with a null or NaN value have no leader; a null of ``by`` is a group.
    """
    if by is None or dict(df.dtypes)[by] not in DEALT_TYPES or "leader" in df.columns:
        return spread_leaders(df, key, col, tol, by, block)
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(by), F.lit(COUNTED))
    full = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("b")
    full = [r["b"] for r in full.collect()]  # one a block of rows at most
    large = df.where(bucket.isin(full)).groupBy(F.col(by).alias("__g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("__g") if full else None
    if large is not None:
        large = F.broadcast(materialize(large, "large"))
    same = F.col(by).eqNullSafe(F.col("__g"))
    small = df if large is None else df.join(large, same, "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", leader double"
    dealt = small.withColumn("__v", F.col(col).cast("double")).repartition(parts, by).sortWithinPartitions(by, "__v")
    led = dealt.mapInArrow(_led_rows(by, tol), out)
    return led if large is None else led.unionByName(spread_leaders(df.join(large, same, "left_semi"), key, col, tol, by, block))


def spread_leaders(df: DataFrame, key: str, col: str, tol: float, by: str | None = None, block: int = 1_000_000) -> DataFrame:
    """Sorted values grouped by leaders: a group takes all values within ``tol`` of its first.

    Distinct values are numbered in order, and each gets the next leader if it were one: the first value
    further than ``tol``, found in its block of ``block`` values or else by a minimum over range partitions.
    Tasks follow these steps to the end of a block, pointer doubling over the steps between blocks finds the blocks'
    first leaders, and tasks mark the others.  An axis of any density is spread evenly.  Rows with a
    null or NaN value have no leader; a null of ``by`` is a group.
    """
    value = F.col(col).cast("double")
    group = F.col(by) if by else F.lit(0)
    values = df.select(group.alias("g"), value.alias("v")).where("v is not null and not isnan(v)").distinct()
    ranked = materialize(global_rank(values, [F.col("g"), F.col("v")], "i").select("g", "v", F.col("i").cast("long").alias("i")), "values")
    kind = f"struct<i:bigint,g:{dict(ranked.dtypes)['g']}>"
    blocks = ranked.withColumn("block", F.floor((F.col("i") - 1) / block).cast("long"))
    found = materialize(blocks.groupBy("block").applyInArrow(_next(tol), f"{_ddl(blocks)}, nx long, pos double"), "steps")
    chain = found
    last = found.agg(F.max("block")).first()[0]
    asked = found.where((F.col("block") < F.lit(last)) & F.col("pos").isNotNull()).select("i", "g", "pos", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("own"))
    if not asked.isEmpty():
        given = ranked.select("i", "g", F.col("v").alias("pos"), F.lit(1).alias("kind"), F.struct("i", "g").alias("own"))
        met = suffix_min(asked.unionByName(given), F.struct("g", "pos", "kind"), F.col("own"), "met").where("kind = 0")
        further = met.where(F.col("met.g").eqNullSafe(F.col("g"))).select("i", F.col("met.i").alias("__n"))
        chain = materialize(found.join(further, "i", "left").select("g", "v", "i", "block", F.coalesce("__n", "nx").alias("nx")), "steps")

    hops = materialize(chain.groupBy("block").applyInArrow(_leaving(block), "i long, out long").where("out > 0"), "hops")
    reached = materialize(chain.groupBy("g").agg(F.min("i").alias("i")).select("i"), "leaders")
    entries = reached.union(hops.select("out")).distinct()
    jump = materialize(hops.join(entries, "i"), "jumps")
    while not jump.isEmpty():
        reached = materialize(reached.union(reached.join(jump, "i").select("out")).distinct(), "leaders")
        jump = materialize(jump.select("i", F.col("out").alias("__o")).join(jump.select(F.col("i").alias("__o"), "out"), "__o").select("i", "out"), "jumps")

    flagged = chain.join(reached.withColumn("entry", F.lit(True)), "i", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    schema = f"{_ddl(chain.select('g', 'v', 'block'))}, at long, leader double"
    led = materialize(flagged.groupBy("block").applyInArrow(_led(block), schema), "led")
    before = F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    held = led.groupBy("block").agg(F.max(F.struct("at", "leader")).alias("last")).select("block", before["leader"].alias("held"))
    groups = led.join(F.broadcast(held), "block").select(F.col("g").alias("__g"), F.col("v").alias("__v"), F.coalesce("leader", "held").alias("__l"))
    out = df.join(groups, group.eqNullSafe(F.col("__g")) & (value == F.col("__v")), "left")
    return out.select(*df.columns, F.col("__l").alias("leader"))
