"""Answers over everything visible: rank first, then ask whether the winner may be named; never substitute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS, SIZES, Config
from .geometry import boundary_gap, pairs, sides
from .relations import direction_columns, eligible, ranked, size_ratio, too_close, union_all

REFERENCE = ("component_id", "x0", "y0", "x1", "y1", "cx", "cy", "border", "mrg", "tiny")


def size_winners(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tile_id, which, target, reason: margin before eligibility."""
    parts = []
    for which in SIZES:
        r = ranked(components, which, only_eligible=False)
        reason = F.when(size_ratio() < config.size_ratio, "semantic_ambiguous").when(~eligible(which), "semantic_target_ineligible")
        parts.append(r.select("tile_id", F.lit(which).alias("which"), F.col("subject").alias("target"), reason.alias("reason"), "n"))
    return union_all(parts)


def references(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Admissible size winners of tiles with two components at least, with their geometry as r_*."""
    found = size_winners(components, config).where("reason is null and n > 1").select("tile_id", "which", F.col("target").alias("r_component_id"))
    return found.join(sides(components, "r", REFERENCE), ["tile_id", "r_component_id"])


def around(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each reference with every other component b of its tile: which, r_*, b_*, gap."""
    return references(components, config).join(sides(components, "b", REFERENCE), "tile_id").where("b_component_id != r_component_id").withColumn("gap", boundary_gap("r", "b"))


def candidates(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The components that stand in each direction of each reference."""
    rows = around(components, config)
    holds = F.array(*(F.struct(F.lit(d).alias("direction"), direction_columns(d, config, "b", "r")[0].isNull().alias("holds")) for d in DIRECTIONS))
    return rows.withColumn("d", F.explode(holds)).where("d.holds").withColumn("direction", F.col("d.direction")).drop("d")


def winners(rows: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """Nearest of each group of candidates (gap, b_*): target, reason (eligibility before margin), n_admissible."""
    w = Window.partitionBy(*by).orderBy("gap", "b_component_id")
    ok = eligible("nearest", "b")
    ranked_ = rows.withColumns({"rank": F.row_number().over(w), "second": F.lead("gap").over(w)})
    close = too_close(F.col("gap"), F.col("second"), config)
    one = F.when(F.col("rank") == 1, F.struct(F.col("b_component_id").alias("target"), ok.alias("ok"), close.alias("close")))
    found = ranked_.groupBy(*by).agg(F.max(one).alias("top"), F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("b_component_id")).alias("ids"), F.sort_array(F.collect_list(F.when(ok, F.col("b_component_id")))).alias("ok_ids"))
    reason = F.when(~F.col("top.ok"), "semantic_target_ineligible").when(F.col("top.close"), "semantic_margin_fail")
    admissible = F.col("n_ok") - F.when(F.col("top.ok") & F.col("top.close"), 1).otherwise(0)
    return found.select(*by, F.col("top.target").alias("target"), reason.alias("reason"), admissible.alias("n_admissible"), "n", "ids", "ok_ids")


def nearest_visible(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Visible nearest of every component: tile_id, anchor, target, reason."""
    rows = pairs(components).withColumn("gap", boundary_gap()).withColumnRenamed("a_component_id", "anchor")
    return winners(rows, ["tile_id", "anchor"], config)
