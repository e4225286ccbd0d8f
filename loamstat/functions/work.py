"""Work tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where it is absent and Spark runs in one process a temporary folder is
    made and set; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to a work table and read it back (as ``schema``): cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/work/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
