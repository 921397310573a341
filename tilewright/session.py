"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it.

    On a cluster without a common install, pass the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([_ROOT, *paths])
    return spark
