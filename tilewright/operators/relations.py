"""Spatial relations over eligible components: directions, extremes, size ranks and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS, EXTREMES, RULES, SIZES, Config
from .geometry import boundary_gap, pairs

_RULES = {r.relation: r for r in RULES}
#: relation -> (coordinate, descending)
KEYS = {"leftmost": ("cx", False), "rightmost": ("cx", True), "topmost": ("cy", False), "bottommost": ("cy", True), "largest": ("area_px", True), "smallest": ("area_px", False)}


def rejection(relation: str, prefix: str = "", anchor: bool = False) -> Column:
    """The first flag that makes a component ineligible, or null."""
    rule = _RULES[relation]
    c = lambda k: F.col(f"{prefix}_{k}" if prefix else k)
    border = rule.border or (anchor and rule.anchor_border)
    tests = [(c(k), name) for k, name, on in (("border", "component_touches_image_border", border), ("mrg", "component_suspected_large_merge", rule.merge), ("tiny", "component_tiny", rule.tiny)) if on]
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in tests), F.lit(None).cast("string")) if tests else F.lit(None).cast("string")


def eligible(relation: str, prefix: str = "", anchor: bool = False) -> Column:
    return rejection(relation, prefix, anchor).isNull()


def direction_columns(relation: str, config: Config = DEFAULT, subject: str = "a", object_: str = "b", preset: str | None = None) -> tuple[Column, Column]:
    """(reason, score) of one direction of a pair; the reason is null where it holds."""
    alpha, tau = config.presets[preset or config.preset]
    dx = (F.col(f"{subject}_cx") - F.col(f"{object_}_cx")) / float(config.width)
    dy = (F.col(f"{subject}_cy") - F.col(f"{object_}_cy")) / float(config.height)
    main, other = (dx, dy) if relation in ("left_of", "right_of") else (dy, dx)
    right_sign = main < 0 if relation in ("left_of", "above") else main > 0
    reason = F.when(~right_sign, "wrong_direction").when(F.abs(main) < alpha * F.abs(other), "axis_not_dominant").when(F.abs(main) < tau, "margin_too_small")
    return reason, main


def directions(components: DataFrame, config: Config = DEFAULT, relations: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """tile_id, relation, subject, object, status, reason, score, margin of every ordered pair."""
    both = pairs(components)
    rows = F.array(*(F.struct(F.lit(r).alias("relation"), *(c.alias(k) for k, c in zip(("reason", "score"), direction_columns(r, config), strict=True))) for r in relations))
    spread = both.select("tile_id", F.col("a_component_id").alias("subject"), F.col("b_component_id").alias("object"), F.inline(rows))
    return spread.select("tile_id", "relation", "subject", "object", F.when(F.col("reason").isNull(), "valid").otherwise("discarded").alias("status"), "reason", "score", F.abs("score").alias("margin"))


def ranked(components: DataFrame, relation: str, only_eligible: bool = True) -> DataFrame:
    """Best and second of each tile: tile_id, subject, best, second, n. Descending ties go to the larger id."""
    key, down = KEYS[relation]
    order = [F.col(key).desc(), F.col("component_id").desc()] if down else [F.col(key), F.col("component_id")]
    w = Window.partitionBy("tile_id").orderBy(*order)
    rows = components.where(eligible(relation)) if only_eligible else components
    rows = rows.withColumns({"rank": F.row_number().over(w), "second": F.lead(key).over(w), "second_id": F.lead("component_id").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("tile_id"))})
    return rows.where("rank = 1").withColumnRenamed("component_id", "subject").withColumn("best", F.col(key))


def extremes(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The four extremes of each tile."""
    parts = []
    for relation in EXTREMES:
        r = ranked(components, relation).withColumn("margin", F.abs(F.col("second") - F.col("best")))
        reason = F.when(F.col("n") < 2, "too_few_eligible_candidates").when(F.col("margin") < config.extreme_margin, "ambiguous")
        parts.append(r.select("tile_id", F.lit(relation).alias("relation"), "subject", reason.alias("reason"), F.col("best").cast("double").alias("score"), F.col("margin").cast("double").alias("margin")))
    return union_all(parts)


def size_ratio() -> Column:
    larger, smaller = F.greatest("best", "second"), F.least("best", "second")
    return larger / F.greatest(smaller, F.lit(1))


def sizes(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Largest and smallest of the eligible components of each tile that has any."""
    parts = []
    for relation in SIZES:
        r = ranked(components, relation).withColumn("margin", size_ratio())
        reason = F.when(F.col("n") < 2, "too_few_eligible_candidates").when(F.col("margin") < config.size_ratio, "ambiguous")
        parts.append(r.select("tile_id", F.lit(relation).alias("relation"), "subject", reason.alias("reason"), F.col("best").cast("double").alias("score"), "margin"))
    return union_all(parts)


def too_close(first: Column, second: Column, config: Config = DEFAULT) -> Column:
    """Whether a nearest neighbour does not stand out; false without a second."""
    d = second - first
    return F.coalesce((d / config.diagonal < config.nearest_share) | (d < config.nearest_px), F.lit(False))


def nearest(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The nearest eligible neighbour of every component: tile_id, anchor, object, reason, score (gap), margin."""
    gaps = pairs(components).where(eligible("nearest", "b")).select("tile_id", F.col("a_component_id").alias("anchor"), F.struct(boundary_gap().alias("gap"), F.col("b_component_id").alias("id")).alias("near"))
    two = gaps.groupBy("tile_id", "anchor").agg(F.slice(F.sort_array(F.collect_list("near")), 1, 2).alias("near"))
    rows = components.select("tile_id", F.col("component_id").alias("anchor"), eligible("nearest", anchor=True).alias("ok")).join(two, ["tile_id", "anchor"], "left")
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    margin = second["gap"] - first["gap"]
    reason = F.when(~F.col("ok"), "anchor_not_eligible").when(F.col("near").isNull(), "too_few_eligible_candidates").when(too_close(first["gap"], second["gap"], config), "ambiguous")
    known = F.col("ok")
    return rows.select("tile_id", "anchor", F.when(known, first["id"]).alias("object"), reason.alias("reason"), F.when(known, first["gap"]).alias("score"), F.when(known, margin).alias("margin"))


def all_relations(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every result of every tile: relation, subject, object, status, reason."""
    of = lambda df, s, o: df.select("tile_id", "relation", s.alias("subject"), o.alias("object"), F.when(F.col("reason").isNull(), "valid").when(F.col("reason") == "ambiguous", "ambiguous").otherwise("discarded").alias("status"), "reason")
    none = F.lit(None).cast("int")
    return union_all(
        [
            of(directions(components, config), F.col("subject"), F.col("object")),
            of(extremes(components, config), F.col("subject"), none),
            of(sizes(components, config), F.col("subject"), none),
            of(nearest(components, config).withColumn("relation", F.lit("nearest")), F.col("anchor"), F.col("object")),
        ]
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
