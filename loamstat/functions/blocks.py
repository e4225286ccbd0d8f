"""All pairs of rows met block by block, in tasks that hold two blocks and one tile of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile: its cells (4 MB of doubles) are all that a task holds beside its two blocks.
TILE = (256, 2048)
#: Numbers of a block (10 MB): blocks of wide rows have fewer of them, down to ``LEAST`` rows.
BLOCK_NUMBERS = 1_280_000
LEAST = 1000


def dealt_block(n: int) -> int:
    """Rows of a block where all pairs of ``n`` rows meet block by block: at most 10 blocks up to 200,000 rows, 20,000 rows a block beyond."""
    return min(20_000, max(2_000, -(-n // 10)))


def block_rows(n: int, width: int) -> int:
    """``dealt_block`` for rows of ``width`` numbers."""
    return min(dealt_block(n), max(LEAST, BLOCK_NUMBERS // max(width, 1)))


def met_in_blocks(rows: DataFrame, meet: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, by: tuple[str, ...] = (), block: int | None = None, own: bool | None = None) -> DataFrame:
    """What ``meet`` yields for every two blocks of ``rows`` (``k``, ``v`` and others), inside each group of ``by``.

    A row is copied once a block, so what is shuffled is rows x blocks.  ``meet`` gets both blocks in the order of ``k`` and
    whether they are the same one; what it yields leaves the task at once.  With ``own`` blocks meet only themselves (True) or
    only others (False).
    """
    if block is None:
        n, width = rows.agg(F.count(F.lit(1)) if not by else F.count_distinct("k"), F.max(F.size("v"))).first()
        block = block_rows(n, width or 1)
    else:
        n = rows.select("k").distinct().count() if by else rows.count()
    parts = max(1, -(-n // block))
    others = F.sequence(F.lit(0), F.lit(parts - 1))
    meets = {None: others, True: F.array("b"), False: F.filter(others, lambda o: o != F.col("b"))}[own]
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")).withColumn("o", F.explode(meets))
    placed = dealt.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("o")
    if not by:  # few rows are much work: they are dealt over as many tasks as there are meetings, which stay apart
        pairs = parts if own else parts * (parts + 1) // 2
        placed = placed.repartition(max(pairs, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bi", "bj")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bi, bj = (table.column(c)[0].as_py() for c in ("bi", "bj"))
        side = lambda b: table.filter(pc.equal(table.column("b"), b)).sort_by("k")
        first = side(bi)
        second = first if bi == bj else side(bj)
        del table
        if first.num_rows and second.num_rows:
            yield from meet(first, second, bi == bj)

    return placed.groupBy(*by, "bi", "bj").applyInArrow(task, schema)


def matrix(table: pa.Table) -> np.ndarray:
    """The arrays ``v`` of a block as rows."""
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def tiles(rows: int, columns: int, upper: bool) -> Iterator[tuple[slice, slice]]:
    """Tiles of a matrix; with ``upper`` only those that reach above the diagonal."""
    for x in range(0, rows, TILE[0]):
        for y in range(0, columns, TILE[1]):
            if not upper or x < y + TILE[1]:
                yield slice(x, min(x + TILE[0], rows)), slice(y, min(y + TILE[1], columns))
