"""Sums of arrays that every partition holds a part of, added up in tasks.

The parts are split into rows and meet in three grouped rounds: those of ``FAN``
partitions each, then of ``FAN`` such sums, then what is left: fewer than 100
rows for a million partitions.  One job does it, and the driver gets one copy
of the total.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of parts: the group, the row of its array, the row's numbers.
PART = "g long, i long, v array<double>"
#: Partitions, and sums of them, that one task adds up in the first two rounds.
FAN = 128


def parts(named: Iterable[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    """Rows of ``PART`` from (group, row, numbers)."""
    rows = list(named)
    return pd.DataFrame({"g": [r[0] for r in rows], "i": [r[1] for r in rows], "v": [r[2] for r in rows]})


def _add(keys: list[str]):  # noqa: ANN202
    def add(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        total = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).sum(axis=0)
        first = table.slice(0, 1)
        named = {"g": first.column("g"), "i": first.column("i"), "v": pa.array([total], pa.list_(pa.float64()))}
        return pa.table(named | {k: first.column(k) for k in keys})

    return add


def added(df: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """``{(group, row): sum}`` over the rows of ``PART`` from all partitions."""
    slotted = df.withColumn("slot", F.floor(F.spark_partition_id() / FAN).cast("long"))
    some = slotted.groupBy("g", "i", "slot").applyInArrow(_add(["g", "i", "slot"]), f"{PART}, slot long")
    some = some.withColumn("slot", F.floor(F.col("slot") / FAN).cast("long")).groupBy("g", "i", "slot").applyInArrow(_add(["g", "i"]), PART)
    whole = some.groupBy("g", "i").applyInArrow(_add(["g", "i"]), PART)
    return {(r["g"], r["i"]): np.array(r["v"]) for r in whole.collect()}
