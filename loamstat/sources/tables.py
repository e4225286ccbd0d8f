"""Readers and writers of the delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feature_matrix(spark: SparkSession, path: str | list[str], n_header: int = 3, n_meta: int = 8, n_samples: int = 40, group_row: int = 0, name_row: int | None = 2, head_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """IO1: a ``;`` matrix without a header line whose first ``n_header`` lines describe the samples.

    Returns ``(features, samples)``: metadata ``m0..``, areas ``a0..`` and gap codes ``g0..`` per
    feature (with its source file), and ``(sample_id, grp, replicate, position)``.  Lines are told
    apart by an empty name in the first column or, for the head of a file, by their place in it:
    header lines leave the mass column (4) empty or non-numeric.  ``head_path`` names the file with the
    header lines where they aren't at the head of ``path``.
    """
    width = n_meta + 3 * n_samples
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(path, sep=";", schema=schema, header=False).withColumn("source", F.col("_metadata.file_name"))
    is_feature = F.expr("try_cast(c4 AS double)").isNotNull()
    areas = [F.col(f"c{n_meta + i}").cast("double").alias(f"a{i}") for i in range(n_samples)]
    gaps = [F.expr(f"try_cast(c{n_meta + 2 * n_samples + i} AS int)").alias(f"g{i}") for i in range(n_samples)]
    features = raw.where(is_feature).select("source", *[F.col(f"c{i}").alias(f"m{i}") for i in range(n_meta)], *areas, *gaps)
    # the head of the first file: a few lines, in the order of the file
    head = spark.read.csv(head_path or path, sep=";", schema=schema, header=False).limit(n_header).collect()
    rows, seen = [], {}
    for i in range(n_samples):
        grp = head[group_row][n_meta + i]
        name = head[name_row][n_meta + i] if name_row is not None else None
        seen[grp] = seen.get(grp, 0) + 1
        rows.append((f"a{i}", grp, seen[grp], i, name))
    return features, spark.createDataFrame(rows, "sample_id string, grp string, replicate int, position int, file string")


def read_tagged(spark: SparkSession, paths: list[str], schema: T.StructType | str, sep: str = ";", header: bool = True) -> DataFrame:
    """IO3: many files in one read, each row with its ``source`` file name."""
    return spark.read.csv(paths, sep=sep, schema=schema, header=header).withColumn("source", F.col("_metadata.file_name"))


def read_delimited(spark: SparkSession, path: str, sep: str, schema: T.StructType | str) -> DataFrame:
    """IO4: a delimited file with a header line and a declared schema."""
    return spark.read.csv(path, sep=sep, schema=schema, header=True)


def read_pairs(spark: SparkSession, path: str, reverse: bool = True) -> DataFrame:
    """IO5: ``(pair_id, src, tgt)`` from one tab-separated pair per line, perhaps reversed.

    Ids follow the lines of a file; they are unique but not dense over several files.
    """
    lines = spark.read.text(path).where(F.instr("value", "\t") > 0)
    a, b = F.split("value", "\t")[0], F.split("value", "\t")[1]
    return lines.select(F.monotonically_increasing_id().alias("pair_id"), (b if reverse else a).alias("src"), (a if reverse else b).alias("tgt"))


def significant(tests: DataFrame, fc_min: float = 0.0, alpha: float = 0.05, p: str = "p_fdr_by") -> DataFrame:
    """Rows under ``alpha`` whose fold change is ``fc_min`` or more, ordered by corrected p."""
    return tests.where((F.col(p) < alpha) & (F.abs("fc") >= fc_min)).orderBy(p, "feature_id", "contrast")


def write_tests(tests: DataFrame, path: str, sep: str = ";", fc_min: float = 0.0, alpha: float = 0.05, p: str = "p_fdr_by") -> None:
    """IO6: significant tests ordered by corrected p (a range sort: part files follow the order)."""
    flat = [c for c, t in tests.dtypes if not t.startswith(("array", "struct", "map"))]
    significant(tests, fc_min, alpha, p).select(*flat).write.csv(path, sep=sep, header=True, mode="overwrite")


def write_by_source(df: DataFrame, path: str, key: str = "source", ids: str | None = None) -> None:
    """IO7: rows (or distinct ids) split into a folder per source."""
    (df.select(key, ids).distinct() if ids else df).write.partitionBy(key).csv(path, sep=";", header=True, mode="overwrite")
