"""Files that queries write and read back: JSON lines and label text, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when the query that wrote them has ended, not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").startswith("local-cluster") or not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, so that loops do not grow their plans; the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_json_lines(df: DataFrame, path: str, *partitions: str) -> None:
    """One JSON object a line with its keys in order, in a folder for each value of ``partitions``; rows of a folder in order of all keys, from file to file."""
    names = sorted(c for c in df.columns if c not in partitions)
    lines = df.select(*partitions, F.to_json(F.struct(*names)).alias("value"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(names)))
    lines = lines.repartitionByRange(*partitions, "value")  # a folder's rows go to as many tasks as they fill
    lines.sortWithinPartitions(*partitions, "value").select(*partitions, "value").write.partitionBy(*partitions).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines by an explicit schema; partition folders become columns, and filters on them prune folders."""
    return spark.read.schema(schema).json(path)
