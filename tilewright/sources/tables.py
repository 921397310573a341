"""Source tables, and tiles with their components derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(spark: SparkSession, sf_dir: str, config: Config = DEFAULT) -> DataFrame:
    """One row per component: an order is a tile, a line a rectangle in it.

    One exchange on the tile; all windows and self-joins further on use its partitioning.
    """
    big = lambda c: F.col(c).cast("bigint")
    line = Window.partitionBy("tile_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("tile_id", F.col("l_orderkey"))
    rows = rows.select("tile_id", F.row_number().over(line).alias("component_id"), big("l_partkey").alias("p"), big("l_suppkey").alias("s"), big("l_linenumber").alias("n"), F.floor("l_quantity").alias("q"), F.floor("l_extendedprice").alias("e"))
    p, s, n, q, e, w, h = map(F.col, "psnqewh")
    large = (p + q) % 89 == 0
    rows = rows.withColumns({"w": F.when(large, 260 + s % 40).otherwise(8 + (p * 7 + q) % 73), "h": F.when(large, 240 + s % 40).otherwise(8 + (s * 11 + p * 3 + q) % 67)})
    rows = rows.withColumns({"x0": F.when((n + q) % 11 == 0, 0).otherwise((p * 37 + n * 71 + e) % (513 - w)), "y0": F.when((n + s) % 13 == 0, 512 - h).otherwise((s * 53 + q * 29 + e) % (513 - h))})
    x0, y0 = F.col("x0"), F.col("y0")
    return rows.select(
        "tile_id",
        "component_id",
        *(c.cast("int").alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x0 + w - 1), ("y1", y0 + h - 1), ("w", w), ("h", h))),
        (w * h).alias("area_px"),
        (x0.cast("double") + (w - 1).cast("double") / 2).alias("cx"),
        (y0.cast("double") + (h - 1).cast("double") / 2).alias("cy"),
        ((x0 == 0) | (y0 == 0) | (x0 + w == config.width) | (y0 + h == config.height)).alias("border"),
        ((w * h).cast("double") / float(config.width * config.height) > config.merge_extent).alias("mrg"),
        (w * h < config.tiny_area).alias("tiny"),
        (((p * 31 + n * 17) % 1000) / 1000.0).alias("confidence"),
    )


def split_of(tile_id: str = "tile_id"):
    m = F.col(tile_id) % 5
    return F.when(m == 0, "test").when(m == 1, "val").otherwise("train")
