"""Question generation: the three levels, discard reasons, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS, EXTREMES, SIZES, Config
from ..operators.relations import eligible, extremes, union_all
from ..operators.semantic import around, candidates, references, size_winners, winners

C = F.col
COLUMNS = ("tile_id", "level", "query_type", "reference", "target", "reason", "trivial")


def _rows(df: DataFrame, level: int, query_type, reference, target, reason, trivial=None) -> DataFrame:
    return df.select("tile_id", F.lit(level).alias("level"), query_type.alias("query_type"), reference.cast("int").alias("reference"), F.when(reason.isNull(), target).cast("int").alias("target"), reason.alias("reason"), (F.lit(False) if trivial is None else trivial).alias("trivial"))


def level1(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    none = F.lit(None)
    ends = extremes(components, config).where("reason is null or reason != 'too_few_eligible_candidates'")
    size = size_winners(components, config).where("n > 1")
    return _rows(ends, 1, F.col("relation"), none, F.col("subject"), F.col("reason")).unionByName(_rows(size, 1, F.col("which"), none, F.col("target"), F.col("reason")))


def _without_reference(components: DataFrame, config: Config) -> DataFrame:
    return size_winners(components, config).where("n > 1 and reason is not null")


def level2(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reference to nearest, and reference to the only component in a direction."""
    none = F.lit(None).cast("int")
    refs = references(components, config)
    ok = eligible("nearest", "r", anchor=True)
    barred = _rows(refs.where(~ok), 2, F.concat("which", F.lit("_to_nearest")), F.col("r_component_id"), none, F.lit("border_ineligible"))
    near = winners(around(components, config).where(ok), ["tile_id", "which", "r_component_id"], config)
    why = F.when(F.col("reason") == "semantic_target_ineligible", "nearest_semantic_ineligible").when(F.col("reason").isNotNull(), "nearest_margin_fail")
    near = _rows(near, 2, F.concat("which", F.lit("_to_nearest")), F.col("r_component_id"), F.col("target"), why)
    sides_ = refs.select("tile_id", "which", "r_component_id", F.explode(F.array(*map(F.lit, DIRECTIONS))).alias("direction"))
    found = candidates(components, config).groupBy("tile_id", "which", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("b_component_id").alias("only"))
    toward = sides_.join(found, ["tile_id", "which", "direction"], "left")
    why = F.when(F.col("n").isNull(), "no_direction_candidate").when(F.col("n") > 1, "multiple_direction_candidates")
    toward = _rows(toward, 2, F.concat_ws("_to_", "which", "direction"), F.col("r_component_id"), F.col("only"), why)
    lost = _without_reference(components, config).select("tile_id", "reason", F.explode(F.array(*(F.concat("which", F.lit(f"_to_{d}")) for d in ("nearest", *DIRECTIONS)))).alias("query_type"))
    return union_all([barred, near, toward, _rows(lost, 2, F.col("query_type"), none, none, F.col("reason"))])


def level3(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Largest, then a direction, then the nearest of those."""
    none = F.lit(None).cast("int")
    name = F.concat("which", F.lit("_to_"), "direction", F.lit("_to_nearest"))
    refs = references(components, config).where("which = 'largest'")
    ok = eligible("nearest", "r", anchor=True)
    sides_ = refs.select("tile_id", "which", "r_component_id", ok.alias("ok"), F.explode(F.array(*map(F.lit, DIRECTIONS))).alias("direction"))
    found = winners(candidates(components, config).where("which = 'largest'"), ["tile_id", "which", "direction"], config).select("tile_id", "which", "direction", "target", F.col("reason").alias("why"), "n_admissible")
    rows = sides_.join(found, ["tile_id", "which", "direction"], "left")
    reason = F.when(~F.col("ok"), "border_ineligible").when(F.col("n_admissible").isNull(), "no_direction_candidate").when(F.col("why") == "semantic_target_ineligible", "level3_nearest_semantic_ineligible").when(F.col("why").isNotNull(), "nearest_margin_fail")
    rows = _rows(rows, 3, name, F.col("r_component_id"), F.col("target"), reason, F.coalesce(reason.isNull() & (F.col("n_admissible") == 1), F.lit(False)))
    lost = _without_reference(components, config).where("which = 'largest'").withColumn("direction", F.explode(F.array(*map(F.lit, DIRECTIONS))))
    return rows.unionByName(_rows(lost, 3, name, none, none, F.col("reason")))


def all_levels(components: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return union_all([level1(components, config), level2(components, config), level3(components, config)])


def quota_key(config: Config = DEFAULT):
    """The order of selection: a digest over seed, tile, level, type and the digest of tile, canonical program and answer."""
    tile, target = C("tile_id").cast("string"), C("target").cast("string")
    semantic = F.sha2(F.concat_ws("|", tile, F.regexp_replace("query_type", "_to_nearest$", ""), target), 256)
    return F.sha2(F.concat_ws("|", F.lit(str(config.seed)), tile, C("level").cast("string"), "query_type", semantic), 256)


def with_quotas(queries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Admitted queries with their rank by key within tile and level, and whether the level's quota takes them."""
    w = Window.partitionBy("tile_id", "level").orderBy("key", "query_type")
    most = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in config.quotas.items()))
    rows = queries.where("reason is null").withColumn("key", quota_key(config)).withColumn("rank", F.row_number().over(w))
    return rows.withColumn("kept", F.col("rank") <= most)


__all__ = ["COLUMNS", "DIRECTIONS", "EXTREMES", "SIZES", "all_levels", "level1", "level2", "level3", "quota_key", "with_quotas"]
