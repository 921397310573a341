"""Queries of scans, projections, geometry, relations, semantics, programs and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS, PROGRAMS, SIZES
from ..operators import geometry as G
from ..operators import relations as R
from ..operators import semantic as S
from ..queries import query, twin
from ..sources.tables import components, split_of
from . import generate, programs


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d)


@query("proj_components", twin("select tile_id, component_id, x0, y0, x1, y1, w, h, area_px, cx, cy from comp"))
def proj_components(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", "x0", "y0", "x1", "y1", "w", "h", "area_px", "cx", "cy")


@query("proj_component_metrics", twin("select tile_id, component_id, w / h as aspect, sqrt(area_px) as scale, area_px / (w * h) as fill, cast(w * h as double) / 262144.0::double as extent from comp"))
def proj_component_metrics(spark, d):
    c = tiles(spark, d)
    box = F.col("w") * F.col("h")
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(F.lit(float("inf")))
    return c.select("tile_id", "component_id", aspect.alias("aspect"), F.sqrt("area_px").alias("scale"), (F.col("area_px") / box).alias("fill"), (box.cast("double") / float(DEFAULT.width * DEFAULT.height)).alias("extent"))


@query("proj_tile_metrics", twin("select tile_id, count(*) as n_components, 262144 as area, sqrt(524288.0::double) as diagonal, 255.5::double as center_x, 255.5::double as center_y from comp group by tile_id"))
def proj_tile_metrics(spark, d):
    return tiles(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_components")).select("*", F.lit(DEFAULT.width * DEFAULT.height).alias("area"), F.lit(DEFAULT.diagonal).alias("diagonal"), F.lit((DEFAULT.width - 1) / 2).alias("center_x"), F.lit((DEFAULT.height - 1) / 2).alias("center_y"))


@query("flt_quality_flags", twin("select tile_id, component_id, border, mrg, tiny, not (border or mrg or tiny) as is_valid from comp"))
def flt_quality_flags(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", "border", "mrg", "tiny", (~(F.col("border") | F.col("mrg") | F.col("tiny"))).alias("is_valid"))


@query("agg_quality_counts", twin("select tile_id, count(*) as n, count(*) filter (border) as n_border, count(*) filter (mrg) as n_merge, count(*) filter (tiny) as n_tiny from comp group by tile_id"))
def agg_quality_counts(spark, d):
    return tiles(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"n_{k}") for c, k in (("border", "border"), ("mrg", "merge"), ("tiny", "tiny"))))


_RULE_SQL = "case when rborder and border then 'component_touches_image_border' when rmerge and mrg then 'component_suspected_large_merge' when rtiny and tiny then 'component_tiny' end"
_RULES_SQL = "(values ('left_of', false, false, false), ('right_of', false, false, false), ('above', false, false, false), ('below', false, false, false), ('leftmost', false, false, false), ('rightmost', false, false, false), ('topmost', false, false, false), ('bottommost', false, false, false), ('nearest', true, true, true), ('largest', true, true, false), ('smallest', true, true, true)) u(relation, rborder, rmerge, rtiny)"


def rule_rows(spark, d):
    kinds = F.array(*(F.struct(F.lit(r.relation).alias("relation"), R.rejection(r.relation).alias("reason"), R.rejection(r.relation, anchor=True).alias("anchor_reason")) for r in R.RULES))
    return tiles(spark, d).select("tile_id", "component_id", F.inline(kinds))


@query("flt_eligibility", twin(f"select tile_id, component_id, relation, {_RULE_SQL} as reason, {_RULE_SQL} as anchor_reason from comp, {_RULES_SQL}"))
def flt_eligibility(spark, d):
    return rule_rows(spark, d)


@query("agg_eligible_ids", twin(f"select tile_id, relation, coalesce(string_agg(cast(component_id as varchar), ',' order by component_id) filter ({_RULE_SQL} is null), '') as ids from comp, {_RULES_SQL} group by tile_id, relation"))
def agg_eligible_ids(spark, d):
    ids = F.sort_array(F.collect_list(F.when(F.col("reason").isNull(), F.col("component_id"))))
    return rule_rows(spark, d).groupBy("tile_id", "relation").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("map_rejections", twin(f"select tile_id, relation, string_agg(component_id || ':' || why, ',' order by component_id) as rejected from (select tile_id, relation, component_id, {_RULE_SQL} as why from comp, {_RULES_SQL}) where why is not null group by tile_id, relation"))
def map_rejections(spark, d):
    rows = rule_rows(spark, d).where("reason is not null").groupBy("tile_id", "relation").agg(F.map_from_entries(F.collect_list(F.struct("component_id", "reason"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"]))
    return rows.select("tile_id", "relation", F.array_join(entries, ",").alias("rejected"))


def both(spark, d, unordered: bool = False) -> DataFrame:
    return G.pairs(tiles(spark, d), unordered)


def ids() -> list:
    return ["tile_id", F.col("a_component_id").alias("aid"), F.col("b_component_id").alias("bid")]


@query("geo_centroid_distance", twin("select tile_id, aid, bid, sqrt((acx - bcx) * (acx - bcx) + (acy - bcy) * (acy - bcy)) as distance from pr"))
def geo_centroid_distance(spark, d):
    dx, dy = F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")
    return both(spark, d).select(*ids(), F.sqrt(dx * dx + dy * dy).alias("distance"))


@query("geo_delta", twin("select tile_id, aid, bid, bcx - acx as to_x, bcy - acy as to_y, acx - bcx as from_x, acy - bcy as from_y from pr"))
def geo_delta(spark, d):
    a, b = (lambda k: F.col(f"a_{k}")), (lambda k: F.col(f"b_{k}"))
    return both(spark, d).select(*ids(), *((b(k) - a(k)).alias(f"to_{k[1]}") for k in ("cx", "cy")), *((a(k) - b(k)).alias(f"from_{k[1]}") for k in ("cx", "cy")))


@query("geo_bbox_gap", twin("select tile_id, aid, bid, bgap as gap, greatest(0.0::double, bgap - 1) as lower_bound from pg"))
def geo_bbox_gap(spark, d):
    return both(spark, d).select(*ids(), G.box_gap().alias("gap"), F.greatest(F.lit(0.0), G.box_gap() - 1).alias("lower_bound"))


@query("geo_gap", twin("select tile_id, aid, bid, gap from pg where aid < bid"))
def geo_gap(spark, d):
    return both(spark, d, True).select(*ids(), G.boundary_gap().alias("gap"))


@query("geo_border_distance", twin("select tile_id, component_id, least(x0, y0, 511 - x1, 511 - y1) as distance from comp"))
def geo_border_distance(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", F.least("x0", "y0", DEFAULT.width - 1 - F.col("x1"), DEFAULT.height - 1 - F.col("y1")).alias("distance"))


@query("win_rank", twin("select tile_id, component_id, row_number() over (partition by tile_id order by area_px, component_id) as ascending_rank, row_number() over (partition by tile_id order by area_px desc, component_id desc) as descending_rank from comp"))
def win_rank(spark, d):
    w = Window.partitionBy("tile_id")
    return tiles(spark, d).select("tile_id", "component_id", F.row_number().over(w.orderBy("area_px", "component_id")).alias("ascending_rank"), F.row_number().over(w.orderBy(F.desc("area_px"), F.desc("component_id"))).alias("descending_rank"))


@query("win_margin", twin("select tile_id, relation, subject, score as best, margin from ext where margin is not null"))
def win_margin(spark, d):
    return R.extremes(tiles(spark, d)).where("margin is not null").select("tile_id", "relation", "subject", F.col("score").alias("best"), "margin")


@query("rel_direction", twin("select tile_id, relation, aid as subject, bid as object, case when reason is null then 'valid' else 'discarded' end as status, reason, m as score, abs(m) as margin from dir"))
def rel_direction(spark, d):
    return R.directions(tiles(spark, d))


@query("rel_symmetry", twin("select tile_id, relation, aid as subject, bid as object, case relation when 'left_of' then 'right_of' when 'right_of' then 'left_of' when 'above' then 'below' else 'above' end as converse, exists (select 1 from dir d2 where d2.tile_id = dir.tile_id and d2.aid = dir.bid and d2.bid = dir.aid and d2.reason is null and d2.relation = case dir.relation when 'left_of' then 'right_of' when 'right_of' then 'left_of' when 'above' then 'below' else 'above' end) as holds from dir where reason is null"))
def rel_symmetry(spark, d):
    valid = R.directions(tiles(spark, d)).where("status = 'valid'").select("tile_id", "relation", "subject", "object")
    turn = F.create_map(*(F.lit(x) for p in (("left_of", "right_of"), ("right_of", "left_of"), ("above", "below"), ("below", "above")) for x in p))
    left = valid.withColumn("converse", turn[F.col("relation")])
    right = valid.select("tile_id", F.col("relation").alias("converse"), F.col("subject").alias("object"), F.col("object").alias("subject"), F.lit(True).alias("found"))
    return left.join(right, ["tile_id", "converse", "subject", "object"], "left").select("tile_id", "relation", "subject", "object", "converse", F.coalesce("found", F.lit(False)).alias("holds"))


@query("rel_contradiction", twin("select a.tile_id, a.aid as subject, a.bid as object, a.relation as relation_a, b.relation as relation_b from dir a join dir b on a.tile_id = b.tile_id and a.aid = b.aid and a.bid = b.bid and a.relation < b.relation where a.reason is null and b.reason is null"))
def rel_contradiction(spark, d):
    valid = R.directions(tiles(spark, d)).where("status = 'valid'")
    return valid.groupBy("tile_id", "subject", "object").agg(F.sort_array(F.collect_list("relation")).alias("r")).where("size(r) > 1").select("tile_id", "subject", "object", F.col("r")[0].alias("relation_a"), F.col("r")[1].alias("relation_b"))


@query("rel_extreme", twin("select tile_id, relation, subject, reason, score, margin from ext"))
def rel_extreme(spark, d):
    return R.extremes(tiles(spark, d))


@query("rel_size", twin("select tile_id, relation, subject, reason, score, margin from siz"))
def rel_size(spark, d):
    return R.sizes(tiles(spark, d))


@query("rel_nearest", twin("select tile_id, anchor, object, reason, score, margin from nr"))
def rel_nearest(spark, d):
    return R.nearest(tiles(spark, d))


@query("rel_nearest_within", twin("select tile_id, which, direction, max(case when q = 1 then cid end) as nearest, count(*) as n_eligible, count(*) = 1 as is_trivial from (select *, row_number() over (partition by tile_id, which, direction order by gap, cid) q from candg where ok) group by 1, 2, 3"))
def rel_nearest_within(spark, d):
    rows = S.candidates(tiles(spark, d)).where(R.eligible("nearest", "b"))
    return rows.groupBy("tile_id", "which", "direction").agg(F.min_by("b_component_id", F.struct("gap", "b_component_id")).alias("nearest"), F.count(F.lit(1)).alias("n_eligible")).withColumn("is_trivial", F.col("n_eligible") == 1)


_STATUS = "case when reason is null then 'valid' when reason = 'ambiguous' then 'ambiguous' else 'discarded' end"
_ALL = f"""select tile_id, relation, aid subject, bid object, {_STATUS} status, reason from dir
union all select tile_id, relation, subject, null, {_STATUS}, reason from ext union all select tile_id, relation, subject, null, {_STATUS}, reason from siz
union all select tile_id, 'nearest', anchor, object, {_STATUS}, reason from nr"""


@query("rel_all", twin(_ALL))
def rel_all(spark, d):
    return R.all_relations(tiles(spark, d))


@query("agg_relation_status", twin(f"select relation, status, count(*) as n from ({_ALL}) group by 1, 2"))
def agg_relation_status(spark, d):
    return R.all_relations(tiles(spark, d)).groupBy("relation", "status").agg(F.count(F.lit(1)).alias("n"))


@query("rel_preset_sweep", twin("""select p.preset, relation, count(*) as n_valid from (select * from dir where (case when relation in ('left_of', 'above') then m < 0 else m > 0 end)),
 (values ('strict', 2.0::double, 0.06::double), ('medium', 1.2::double, 0.04::double), ('loose', 1.0::double, 0.02::double)) p(preset, alpha, tau)
 where not abs(m) < alpha * abs(o) and not abs(m) < tau group by 1, 2"""))
def rel_preset_sweep(spark, d):
    kinds = F.array(*(F.struct(F.lit(p).alias("preset"), F.lit(r).alias("relation"), R.direction_columns(r, preset=p)[0].isNull().alias("holds")) for p in DEFAULT.presets for r in DIRECTIONS))
    return both(spark, d).select(F.inline(kinds)).where("holds").groupBy("preset", "relation").agg(F.count(F.lit(1)).alias("n_valid"))


@query("str_predicate", twin("select tile_id, aid as subject, bid as object, 'component ' || aid || ' is ' || replace(relation, '_', ' ') || ' component ' || bid as sentence from dir where reason is null"))
def str_predicate(spark, d):
    rows = R.directions(tiles(spark, d)).where("status = 'valid'")
    return rows.select("tile_id", "subject", "object", F.format_string("component %d is %s component %d", "subject", F.translate("relation", "_", " "), "object").alias("sentence"))


@query("sem_size", twin("select tile_id, which, target, reason, n from sem"))
def sem_size(spark, d):
    return S.size_winners(tiles(spark, d))


@query("sem_nearest_rank", twin("select tile_id, aid as anchor, bid as candidate, gap, r as rank from sn_r"))
def sem_nearest_rank(spark, d):
    w = Window.partitionBy("tile_id", "a_component_id").orderBy("gap", "b_component_id")
    rows = both(spark, d).withColumn("gap", G.boundary_gap())
    return rows.select("tile_id", F.col("a_component_id").alias("anchor"), F.col("b_component_id").alias("candidate"), "gap", F.row_number().over(w).alias("rank"))


@query("sem_nearest", twin("select tile_id, anchor, target, reason from sn"))
def sem_nearest(spark, d):
    return S.nearest_visible(tiles(spark, d)).select("tile_id", "anchor", "target", "reason")


@query("sem_direction", twin("select tile_id, which, direction, string_agg(cast(cid as varchar), ',' order by cid) as ids from cand group by 1, 2, 3"))
def sem_direction(spark, d):
    rows = S.candidates(tiles(spark, d)).groupBy("tile_id", "which", "direction").agg(F.sort_array(F.collect_list("b_component_id")).alias("i"))
    return rows.select("tile_id", "which", "direction", F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"))


@query("sem_eligible_subset", twin("select tile_id, which, direction, coalesce(string_agg(cast(cid as varchar), ',' order by cid) filter (ok), '') as ids from candg group by 1, 2, 3"))
def sem_eligible_subset(spark, d):
    rows = S.winners(S.candidates(tiles(spark, d)), ["tile_id", "which", "direction"])
    return rows.select("tile_id", "which", "direction", F.array_join(F.col("ok_ids").cast("array<string>"), ",").alias("ids"))


@query("sem_trivial", twin("select tile_id, which, direction, n_ok - case when top_ok and top_close then 1 else 0 end as n_admissible from l3"))
def sem_trivial(spark, d):
    return S.winners(S.candidates(tiles(spark, d)), ["tile_id", "which", "direction"]).select("tile_id", "which", "direction", "n_admissible")


_PROGRAMS = ", ".join(f"'{p}'" for p in PROGRAMS)


@query("prog_catalog", twin(f"""select p as program, case when len(s) = 1 then 1 when len(s) = 3 and s[-1] = 'nearest' then 3 else 2 end as level, len(s) as n_steps, s[1] as first_step, array_to_string(s[2:3], '>') as rest,
 coalesce(n_samples, 0) as n_samples, coalesce(n_trivial, 0) as n_trivial, coalesce(n_tiles, 0) as n_tiles
 from (select p, string_split(p, '_to_') s from (select unnest([{_PROGRAMS}]) p)) left join (select query_type, count(*) as n_samples, count(*) filter (trivial) as n_trivial, count(distinct tile_id) as n_tiles from smp group by 1) on query_type = p"""))
def prog_catalog(spark, d):
    """The programs of the vocabulary and how the samples use each."""
    used = samples(spark, d).groupBy(F.col("query_type").alias("program")).agg(F.count("*").alias("n_samples"), F.count_if("trivial").alias("n_trivial"), F.countDistinct("tile_id").alias("n_tiles"))
    return programs.catalog(spark).join(used, "program", "left").fillna(0, ["n_samples", "n_trivial", "n_tiles"])


_EXEC = """,
tl as (select distinct tile_id from comp),
pool as (select tile_id, relation which, component_id rid from siz_r where r = 1),
base as (select tl.tile_id, w.which, pool.rid from tl cross join (values ('largest'), ('smallest')) w(which) left join pool on pool.tile_id = tl.tile_id and pool.which = w.which),
stp as (
  select pool.tile_id, pool.which, k.direction, pg.bid, pg.gap, not pg.bborder and not pg.bmrg and not pg.btiny ok
  from pool join pg on pg.tile_id = pool.tile_id and pg.aid = pool.rid cross join (values ('any'), ('left_of'), ('right_of'), ('above'), ('below')) k(direction)
  where k.direction = 'any' or exists (select 1 from dir d where d.tile_id = pg.tile_id and d.aid = pg.bid and d.bid = pool.rid and d.relation = k.direction and d.reason is null)),
cnt as (select tile_id, which, direction, count(*) n, min(bid) only_id from stp group by 1, 2, 3),
oks as (select *, row_number() over w r, lead(gap) over w g2 from stp where ok window w as (partition by tile_id, which, direction order by gap, bid)),
fin as (
  select base.tile_id, base.which, k.direction, base.rid, cnt.n, cnt.only_id, oks.bid near_id,
         coalesce((g2 - gap) / sqrt(524288.0::double) < 0.005::double or g2 - gap < 2, false) close_, not c.border and not c.mrg and not c.tiny anchor_ok
  from base cross join (values ('any'), ('left_of'), ('right_of'), ('above'), ('below')) k(direction)
  left join cnt on cnt.tile_id = base.tile_id and cnt.which = base.which and cnt.direction = k.direction
  left join oks on oks.tile_id = base.tile_id and oks.which = base.which and oks.direction = k.direction and oks.r = 1
  left join comp c on c.tile_id = base.tile_id and c.component_id = base.rid),
run as (
  select tile_id, relation program, subject answer, case when reason is not null then 'extreme_relation_invalid' end reason from ext
  union all select tile_id, which, rid, case when rid is null then 'no_eligible_candidates' end from base
  union all select tile_id, which || '_to_' || direction, only_id, case when rid is null or n is null then 'no_eligible_candidates' when n > 1 then 'filter_multi_candidate' end from fin where direction <> 'any'
  union all select tile_id, which || case when direction = 'any' then '' else '_to_' || direction end || '_to_nearest', near_id,
    case when rid is null or (direction <> 'any' and n is null) then 'no_eligible_candidates' when n is null or not anchor_ok or near_id is null or close_ then 'nearest_relation_invalid' end
  from fin where direction = 'any' or which = 'largest'),
ans as (select tile_id, program, case when reason is null then answer end answer, reason from run)
"""


@query("prog_execute", twin(_EXEC + "select tile_id, program, answer, reason from ans"))
def prog_execute(spark, d):
    return programs.execute(tiles(spark, d))


@query("prog_score", twin(_EXEC + "select level, count(*) as n, count(*) filter (a.reason is not null) as n_abstained, avg(case when a.answer = g.target then 1.0::double else 0.0::double end) as strict_accuracy, avg(case when a.answer is not null then case when a.answer = g.target then 1.0::double else 0.0::double end end) as conditional_accuracy from gen g join ans a on a.tile_id = g.tile_id and a.program = g.query_type where g.reason is null group by level"))
def prog_score(spark, d):
    c = tiles(spark, d)
    truth = generate.all_levels(c).where("reason is null").select("tile_id", F.col("query_type").alias("program"), "level", "target")
    rows = truth.join(programs.execute(c), ["tile_id", "program"])
    hit = F.when(F.col("answer") == F.col("target"), 1.0).otherwise(0.0)
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("n_abstained"), F.avg(hit).alias("strict_accuracy"), F.avg(F.when(F.col("answer").isNotNull(), hit)).alias("conditional_accuracy"))


@query("prog_feasibility", twin(_EXEC + "select tile_id, count(*) filter (reason is null) as n_answered, count(*) filter (reason is null and program not like '%_to_%') as n_level1, bool_or(reason is null and program like '%_to_%_to_nearest') as has_chain from ans group by tile_id"))
def prog_feasibility(spark, d):
    ok = F.col("reason").isNull()
    return programs.execute(tiles(spark, d)).groupBy("tile_id").agg(F.count_if(ok).alias("n_answered"), F.count_if(ok & ~F.col("program").like("%_to_%")).alias("n_level1"), F.bool_or(ok & F.col("program").like("%_to_%_to_nearest")).alias("has_chain"))


@query("prog_all_resolve", twin("select tile_id, level, query_type, reference, target, reason from gen"))
def prog_all_resolve(spark, d):
    return generate.all_levels(tiles(spark, d)).drop("trivial")


for _k in (1, 2, 3):

    @query(f"gen_level{_k}", twin(f"select tile_id, level, query_type, reference, target, reason, trivial from gen where level = {_k}"))
    def _gen(spark, d, k=_k):
        return (generate.level1, generate.level2, generate.level3)[k - 1](tiles(spark, d))


@query("gen_discards", twin("select level, reason, count(*) as n from gen where reason is not null group by 1, 2"))
def gen_discards(spark, d):
    return generate.all_levels(tiles(spark, d)).where("reason is not null").groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("gen_quotas", twin("select tile_id, level, query_type, key, rk as rank, rk <= case level when 1 then 6 when 2 then 4 else 2 end as kept from gq"))
def gen_quotas(spark, d):
    return generate.with_quotas(generate.all_levels(tiles(spark, d))).select("tile_id", "level", "query_type", "key", "rank", "kept")


def samples(spark, d) -> DataFrame:
    return generate.with_quotas(generate.all_levels(tiles(spark, d))).where("kept").withColumn("split", split_of())


@query("gen_pipeline", twin("select tile_id, split, level, query_type, reference, target, trivial from smp"))
def gen_pipeline(spark, d):
    return samples(spark, d).select("tile_id", "split", "level", "query_type", "reference", "target", "trivial")


FLAGSHIP = "largest_to_right_of_to_nearest"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The chain of size, direction and nearest neighbour, resolved on every tile."""
    return generate.level3(tiles(spark, d)).where(F.col("query_type") == FLAGSHIP)


__all__ = ["SIZES", "flagship", "samples", "tiles"]
