"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are word counts.  Source targets are a weighted share of ``amount``
times all sizes, stopped at ``most`` times a source's own size; the excess is
shared again among the others (water filling).  A source's factor, target
over size, is split for each of its documents into whole copies and a
fractional copy.

The fractional parts are rounded by pivotal sampling: two documents meet, and
mass moves between them - one up, one down, at equal words - in a random
direction whose odds keep each document's expectation, until one of them is 0
or 1.  The other goes on to the next meeting.  A block of documents leaves at
most one document undecided; the residuals of many blocks meet in the next
level of a reduction tree, until a source has one left, which is rounded by a
last draw.  So a source's taken words differ from its target by less than one
document, and no task sees more than a block.

Equal rows (same id, source and text) are one member of a block, whatever
their number: their common fraction, times their number, gives whole further
copies, and what is left over is rounded as one document's fraction.

The draws come from a generator keyed by seed, level, source and block, and
rows meet in the order of their digests: reruns agree on any cluster.

Edge cases: a null text has size 0 and is never taken; a null source is the
last source; repeated rows are rows of their own, made in parts of ``STEP``; a
source without words has target 0; very long texts are counted by Spark and
never cut; an empty table gives no rows; columns of other names stay untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.llm.common import digest_of, fresh, materialize, quoted

#: Documents that meet in one task of a level.
BLOCK = 8192
#: Copies of a repeated row that one place makes; so many rows of one key are dealt over the cluster.
STEP = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), amount: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, docs, target)`` from rows ``(source, size)``.

    One row per source is ranked in one task; their number does not grow with
    the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # sources fill up in the order of cap / weight; the first that does not sets the level for the rest
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * float(amount) - before) / rest
    step = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return step.withColumn("final", final).select("source", "source_size", "docs", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def pivotal_block(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions in the given order; returns them and the undecided place (-1: none).

    The sum of ``p * size`` is kept by every meeting.
    """
    out = p.astype(np.float64).copy()
    draw = rng.random(len(out))
    eps = 1e-12
    held = -1
    for i in range(len(out)):
        if not eps < out[i] < 1 - eps:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = out[held], out[i], size[held], size[i]
        up = min((1 - a) * sa, b * sb)  # words from i to the held one
        down = min(a * sa, (1 - b) * sb)  # words the other way
        moved = up if draw[i] * (up + down) < down else -down
        a, b = a + moved / sa, b - moved / sb
        a_open, b_open = eps < a < 1 - eps, eps < b < 1 - eps
        out[held], out[i] = (a if a_open else round(a)), (b if b_open else round(b))
        if not a_open:
            held = i if b_open else -1
    return out, held


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    amount: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    block: int = BLOCK,
) -> DataFrame:
    """Rows ``doc_id, size, source_size, target, copies, taken``, one per document."""
    plan = _mixed(docs, weights, amount, most, seed, block)
    several = _numbered(plan.where("rows > 1"), "key", "rows", "part", "nth")
    each = plan.where("rows = 1").withColumn("nth", F.lit(1).cast("long")).unionByName(several)
    copies = F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), amount: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with its columns and ``copy`` from 1.

    Equal rows (same id, source and text) share their copies.  A column
    named ``copy`` stays; the number is then called ``copy_``.
    """
    plan = _mixed(docs, weights, amount, most, seed, block).select("key", F.col("rows").alias("rows"), (F.col("whole") * F.col("rows") + F.col("more")).alias("times")).where("times > 0")
    copy, key, rows, times, part = fresh(docs, "copy", "key", "rows", "times", "part")
    kept = docs.withColumn(key, _key()).join(plan.toDF(key, rows, times), key)
    once = kept.where(F.col(rows) == 1).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    several = _numbered(kept.where(F.col(rows) > 1).dropDuplicates([key]), key, times, part, copy)
    return once.unionByName(several).select(*quoted(docs), F.col(copy))


def _numbered(df: DataFrame, key: str, times: str, part: str, name: str, step: int = STEP) -> DataFrame:
    """Every row ``times`` times, numbered from 1 in ``name``; ``step`` of them are made in one place."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that adaptive execution doesn't lay small parts together again
    parts = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) DIV {step}")))).repartition(tasks, key, part)
    first = F.col(part) * step + 1
    return parts.withColumn(name, F.explode(F.sequence(first, F.least(F.col(times).cast("long"), first + step - 1)))).drop(part)


def _key() -> Column:
    return digest_of(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], amount: float, most: float, seed: int, block: int) -> DataFrame:
    """One line per distinct row: ``key, doc_id, size, source_size, target, rows, whole, more``.

    Each of the ``rows`` equal rows is taken ``whole`` times, ``more`` of them once again.
    """
    rows = docs.select(
        _key().alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sized = materialize(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    targets = source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, amount, most)
    largest = targets.agg(F.max("docs").alias("m")).first()["m"] or 0
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.when(F.col("size") > 0, factor).otherwise(F.lit(0.0))
    start = (
        sized.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.key", "s.doc_id", "s.source", "s.size", "s.rows", "t.source_size", "t.target", "t.docs", copies.alias("copies"))
        .withColumn("whole", F.floor("copies"))
        .withColumn("mass", (F.col("copies") - F.col("whole")) * F.col("rows"))
        .withColumn("more", F.floor("mass"))
        .withColumn("part", F.col("mass") - F.col("more"))
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("docs") / block).cast("long")))
        .drop("docs", "copies", "mass")
    )
    schema = "key binary, doc_id long, source string, size long, rows long, source_size long, target double, whole long, more long, part double, block long, open boolean"
    pending, decided, level, blocks = start, [], 0, max(1, -(-largest // block))
    while True:
        last = blocks <= 1
        met = materialize(pending.groupBy("source", "block").applyInArrow(_meeting(seed, level, last), schema), f"mix{level}")
        decided.append(met.where("not open").drop("open"))
        if last:
            break
        pending = met.where("open").drop("open").withColumn("block", F.floor(F.col("block") / block).cast("long"))
        blocks, level = -(-blocks // block), level + 1
    done = decided[0]
    for later in decided[1:]:
        done = done.unionByName(later)
    return done.select("key", "doc_id", "size", "source_size", "target", "rows", "whole", (F.col("more") + F.round("part").cast("long")).alias("more"))


def _meeting(seed: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """The meetings of one block at one level; at the last one no document stays open."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        source = table.column("source")[0].as_py()
        name = zlib.crc32(b"\0" if source is None else source.encode())
        rng = np.random.Generator(np.random.PCG64([seed, level, name, table.column("block")[0].as_py()]))
        part, held = pivotal_block(table.column("part").to_numpy(), np.maximum(table.column("size").to_numpy(), 1), rng)
        if held >= 0 and last:
            part[held] = float(rng.random() < part[held])
            held = -1
        table = table.set_column(table.schema.names.index("part"), "part", pa.array(part))
        return table.append_column("open", pa.array(np.arange(len(part)) == held))

    return meet
