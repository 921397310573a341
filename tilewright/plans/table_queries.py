"""Queries of joins, aggregations, windows, top-k, sets, sampling, metrics, scalar functions and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import relations as R
from ..operators.ranks import running_totals
from ..queries import query, twin
from ..sources.tables import split_of, table
from .base_queries import samples, tiles


# ---- joins ----


@query("join_self_pairs", twin("select tile_id, count(*) as n_pairs from pr group by tile_id"))
def join_self_pairs(spark, d):
    return G.pairs(tiles(spark, d)).groupBy("tile_id").agg(F.count("*").alias("n_pairs"))


@query("join_unordered_pairs", twin("select tile_id, aid, bid from pr where aid < bid"))
def join_unordered_pairs(spark, d):
    return G.pairs(tiles(spark, d), True).select("tile_id", F.col("a_component_id").alias("aid"), F.col("b_component_id").alias("bid"))


@query("join_left_lookup", twin("select l.tile_id, o_orderstatus as status, o_orderkey is null as missing from (select distinct tile_id from comp) l left join (select distinct o_orderkey, min(o_orderstatus) o_orderstatus from orders group by o_orderkey) o on o_orderkey = tile_id"))
def join_left_lookup(spark, d):
    meta = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("tile_id")).agg(F.min("o_orderstatus").alias("status"), F.lit(True).alias("found"))
    return tiles(spark, d).select("tile_id").distinct().join(meta, "tile_id", "left").select("tile_id", "status", F.col("found").isNull().alias("missing"))


_IOU_SQL = "cast(greatest(0, least(ax1, bx1) - greatest(ax0, bx0) + 1) as bigint) * greatest(0, least(ay1, by1) - greatest(ay0, by0) + 1)"


def overlap(a: str = "a", b: str = "b"):
    """Common pixels of two inclusive boxes."""
    c = lambda p, k: F.col(f"{p}_{k}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")) + 1
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")) + 1
    return F.greatest(F.lit(0), w).cast("long") * F.greatest(F.lit(0), h)


def iou(a: str = "a", b: str = "b"):
    both = overlap(a, b)
    return both / (F.col(f"{a}_area_px") + F.col(f"{b}_area_px") - both)


@query("join_bbox_range", twin("select tile_id, aid, bid from pr where aid < bid and ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1"))
def join_bbox_range(spark, d):
    """Boxes that meet, through cells of 128 pixels: large tiles join per cell, not as a whole."""
    cell = 128
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    c = tiles(spark, d).select("tile_id", "component_id", "x0", "y0", "x1", "y1", F.explode(cells("x0", "x1")).alias("u")).select("*", F.explode(cells("y0", "y1")).alias("v"))
    a, b = (c.select("tile_id", "u", "v", *(F.col(k).alias(f"{p}_{k}") for k in ("component_id", "x0", "y0", "x1", "y1"))) for p in "ab")
    met = a.join(b, ["tile_id", "u", "v"]).where("a_component_id < b_component_id and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    # each pair counts in the first cell of its common part alone, so no distinct is needed
    first = (F.col("u") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("v") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    return met.where(first).select("tile_id", F.col("a_component_id").alias("aid"), F.col("b_component_id").alias("bid"))


@query("met_box_iou", twin(f"select tile_id, aid, bid, i / (aarea + barea - i) as iou from (select *, {_IOU_SQL} as i from pr) where aid < bid and i > 0"))
def met_box_iou(spark, d):
    return G.pairs(tiles(spark, d), True).where(overlap() > 0).select("tile_id", F.col("a_component_id").alias("aid"), F.col("b_component_id").alias("bid"), iou().alias("iou"))


@query("join_full_outer_compare", twin("select coalesce(a.tile_id, b.tile_id) as tile_id, coalesce(a.relation, b.which) as kind, a.subject as engine, b.target as semantic, case when a.subject is null then 'only_semantic' when b.target is null then 'only_engine' when a.subject = b.target then 'same' else 'changed' end as status from (select * from siz where reason is null) a full join (select * from sem where reason is null and n > 1) b on a.tile_id = b.tile_id and a.relation = b.which"))
def join_full_outer_compare(spark, d):
    from ..operators.semantic import size_winners

    c = tiles(spark, d)
    old = R.sizes(c).where("reason is null").select("tile_id", F.col("relation").alias("kind"), F.col("subject").alias("engine"))
    new = size_winners(c).where("reason is null and n > 1").select("tile_id", F.col("which").alias("kind"), F.col("target").alias("semantic"))
    status = F.when(F.col("engine").isNull(), "only_semantic").when(F.col("semantic").isNull(), "only_engine").when(F.col("engine") == F.col("semantic"), "same").otherwise("changed")
    return old.join(new, ["tile_id", "kind"], "full").withColumn("status", status)


@query("join_anti_holdout", twin("select distinct tile_id from comp where split = 'val' and tile_id not in (select tile_id from comp where tile_id % 10 = 1)"))
def join_anti_holdout(spark, d):
    t = tiles(spark, d).select("tile_id", split_of().alias("split"))
    return t.where("split = 'val'").select("tile_id").distinct().join(t.where("tile_id % 10 = 1").select("tile_id"), "tile_id", "left_anti")


@query("join_split_view", twin("select tile_id, view, split from (select distinct tile_id, split from comp) join (values (0, 'legacy'), (1, 'disjoint')) v(k, view) on k = tile_id % 2"))
def join_split_view(spark, d):
    views = spark.createDataFrame([(0, "legacy"), (1, "disjoint")], "k int, view string")
    t = tiles(spark, d).select("tile_id", split_of().alias("split")).distinct().withColumn("k", F.col("tile_id") % 2)
    return t.join(F.broadcast(views), "k").select("tile_id", "view", "split")  # two rows


@query("join_semi_candidates", twin("select tile_id, component_id from comp c where exists (select 1 from cand where cand.tile_id = c.tile_id and cand.cid = c.component_id)"))
def join_semi_candidates(spark, d):
    from ..operators.semantic import candidates

    c = tiles(spark, d).select("tile_id", "component_id")
    return c.join(candidates(tiles(spark, d)).select("tile_id", F.col("b_component_id").alias("component_id")), ["tile_id", "component_id"], "left_semi")


@query("join_cf_pairs", twin("select a.tile_id, a.reference, a.query_type as type_a, b.query_type as type_b, a.target as target_a, b.target as target_b from smp a join smp b on a.tile_id = b.tile_id and a.reference = b.reference and a.query_type < b.query_type and a.target <> b.target"))
def join_cf_pairs(spark, d):
    s = samples(spark, d)
    a, b = (s.select("tile_id", "reference", F.col("query_type").alias(f"type_{k}"), F.col("target").alias(f"target_{k}")) for k in "ab")
    return a.join(b, ["tile_id", "reference"]).where("type_a < type_b and target_a != target_b")


@query("join_level_pairs", twin("select a.tile_id, a.query_type as type_1, b.query_type as type_3, a.target as target_1, b.target as target_3 from smp a join smp b on a.tile_id = b.tile_id and a.level = 1 and b.level = 3 and a.target <> b.target"))
def join_level_pairs(spark, d):
    s = samples(spark, d)
    a, b = (s.where(f"level = {k}").select("tile_id", F.col("query_type").alias(f"type_{k}"), F.col("target").alias(f"target_{k}")) for k in (1, 3))
    return a.join(b, "tile_id").where("target_1 != target_3")


# ---- aggregations ----


@query("agg_grouping_sets", twin("select split, level, query_type, count(*) as n from smp group by grouping sets ((split), (level), (query_type), (split, level), (split, query_type))"))
def agg_grouping_sets(spark, d):
    s, c = samples(spark, d), [F.col(k) for k in ("split", "level", "query_type")]
    return s.groupingSets([[c[0]], [c[1]], [c[2]], [c[0], c[1]], [c[0], c[2]]], *c).agg(F.count("*").alias("n"))


@query("agg_cube", twin("select split, level, count(*) as n, count(distinct query_type) as n_types from smp group by cube (split, level)"))
def agg_cube(spark, d):
    return samples(spark, d).cube("split", "level").agg(F.count("*").alias("n"), F.countDistinct("query_type").alias("n_types"))


_P = (0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99)


@query("agg_percentiles", twin("select split, count(*) as n, min(area_px) as lo, max(area_px) as hi, avg(area_px) as mean, " + ", ".join(f"quantile_cont(area_px, {p}) as p{round(p * 100)}" for p in _P) + " from comp group by split"))
def agg_percentiles(spark, d):
    c = tiles(spark, d).withColumn("split", split_of())
    return c.groupBy("split").agg(F.count("*").alias("n"), F.min("area_px").alias("lo"), F.max("area_px").alias("hi"), F.avg("area_px").alias("mean"), *(F.percentile("area_px", p).alias(f"p{round(p * 100)}") for p in _P))


@query("agg_histogram", twin("select case when n = 1 then '1' when n < 4 then '2-3' when n < 8 then '4-7' else '8+' end as bucket, count(*) as tiles from (select tile_id, count(*) n from comp group by tile_id) group by 1"))
def agg_histogram(spark, d):
    n = F.col("n")
    return tiles(spark, d).groupBy("tile_id").agg(F.count("*").alias("n")).groupBy(F.when(n == 1, "1").when(n < 4, "2-3").when(n < 8, "4-7").otherwise("8+").alias("bucket")).agg(F.count("*").alias("tiles"))


@query("agg_proportions", twin("select query_type, round(count(*) / greatest(sum(count(*)) over (), 1), 6) as share from smp group by query_type"))
def agg_proportions(spark, d):
    n = samples(spark, d).groupBy("query_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.join(F.broadcast(total)).select("query_type", F.round(F.col("n") / F.greatest(F.col("all"), F.lit(1)), 6).alias("share"))  # one row


@query("agg_pivot", twin("select relation, count(*) filter (reason is null) as valid, count(*) filter (reason is not null) as other from ext group by relation"))
def agg_pivot(spark, d):
    rows = R.extremes(tiles(spark, d)).withColumn("status", F.when(F.col("reason").isNull(), "valid").otherwise("other"))
    return rows.groupBy("relation").pivot("status", ["valid", "other"]).count().na.fill(0)


@query("agg_border_table", twin("select border, count(*) filter (not border and not mrg) as eligible, count(*) filter (border or mrg) as rejected from comp group by border"))
def agg_border_table(spark, d):
    ok = R.eligible("largest")
    return tiles(spark, d).groupBy("border").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("rejected"))


@query("agg_strict_conditional", twin("select split, avg(coalesce(score, 0)) as strict, avg(score) as conditional, count(*) - count(score) as n_abstained from (select case when reason is null then score end score, case tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end split from nr) group by split"))
def agg_strict_conditional(spark, d):
    rows = R.nearest(tiles(spark, d)).select(split_of().alias("split"), F.when(F.col("reason").isNull(), F.col("score")).alias("score"))
    return rows.groupBy("split").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("strict"), F.avg("score").alias("conditional"), F.count_if(F.col("score").isNull()).alias("n_abstained"))


@query("agg_breakdown", twin("select split, level, count(*) as n, avg(case when trivial then 1.0::double else 0.0::double end) as trivial_rate, count(distinct tile_id) as n_tiles from smp group by split, level"))
def agg_breakdown(spark, d):
    return samples(spark, d).groupBy("split", "level").agg(F.count("*").alias("n"), F.avg(F.when(F.col("trivial"), 1.0).otherwise(0.0)).alias("trivial_rate"), F.countDistinct("tile_id").alias("n_tiles"))


@query("agg_geometry_report", twin("select avg(cx) as mean_x, median(cx) as median_x, stddev_pop(cx) as sd_x, avg(cy) as mean_y, median(cy) as median_y, stddev_pop(cy) as sd_y from comp"))
def agg_geometry_report(spark, d):
    return tiles(spark, d).agg(*(f(c).alias(f"{k}_{c[1]}") for c in ("cx", "cy") for k, f in (("mean", F.avg), ("median", F.median), ("sd", F.stddev_pop))))


@query("agg_collect_set", "select t as text, string_agg(distinct role, ',' order by role) as roles from (select lower(trim(text)) t, role from conversations) group by t")
def agg_collect_set(spark, d):
    rows = table(spark, d, "conversations").select(F.lower(F.trim("text")).alias("text"), "role")
    return rows.groupBy("text").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


@query("agg_distinct", twin("select split, count(*) as n, count(distinct tile_id) as n_tiles, max(k) as most from (select *, count(*) over (partition by tile_id) k from smp) group by split"))
def agg_distinct(spark, d):
    per = samples(spark, d).groupBy("split", "tile_id").agg(F.count("*").alias("k"))
    return per.groupBy("split").agg(F.sum("k").alias("n"), F.count("*").alias("n_tiles"), F.max("k").alias("most"))


@query("agg_seed_stats", twin("select relation, avg(score) as mean, stddev_samp(score) as sd, count(*) as n from siz group by relation"))
def agg_seed_stats(spark, d):
    return R.sizes(tiles(spark, d)).groupBy("relation").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"))


@query("agg_flag_distribution", twin("select level, count(*) filter (border) as n_border, count(*) filter (tiny) as n_tiny, count(*) as n from smp join comp on comp.tile_id = smp.tile_id and component_id = target group by level"))
def agg_flag_distribution(spark, d):
    c = tiles(spark, d).select("tile_id", F.col("component_id").alias("target"), "border", "tiny")
    return samples(spark, d).join(c, ["tile_id", "target"]).groupBy("level").agg(F.count_if("border").alias("n_border"), F.count_if("tiny").alias("n_tiny"), F.count("*").alias("n"))


@query("agg_margin_split", twin("select relation, corr(score, margin) as correlation, avg(margin) filter (reason is null) as valid_margin, avg(margin) filter (reason is not null) as other_margin from siz where margin is not null group by relation"))
def agg_margin_split(spark, d):
    rows = R.sizes(tiles(spark, d)).where("margin is not null")
    return rows.groupBy("relation").agg(F.corr("score", "margin").alias("correlation"), F.avg(F.when(F.col("reason").isNull(), F.col("margin"))).alias("valid_margin"), F.avg(F.when(F.col("reason").isNotNull(), F.col("margin"))).alias("other_margin"))


@query("agg_nearest_rank", "select event_type, list_sort(list(value))[cast(round_even(0.9 * (count(*) - 1), 0) as int) + 1] as p90 from events group by event_type")
def agg_nearest_rank(spark, d):
    """The value at index round half even of 0.9 (n - 1), by running counts of distinct values."""
    by = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    ranked = running_totals(by, ["event_type"], "value", ["n"])
    place = F.bround(0.9 * (F.col("all_n") - 1)).cast("long")
    return ranked.where((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))).select("event_type", F.col("value").alias("p90"))


# ---- windows ----


@query("win_share", twin("select tile_id, component_id, area_px / max(area_px) over (partition by tile_id) as share from comp"))
def win_share(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", (F.col("area_px") / F.max("area_px").over(Window.partitionBy("tile_id"))).alias("share"))


@query("win_rank_multi", twin("select tile_id, component_id, row_number() over (partition by tile_id order by area_px desc, confidence desc, component_id) as rank from comp"))
def win_rank_multi(spark, d):
    w = Window.partitionBy("tile_id").orderBy(F.desc("area_px"), F.desc("confidence"), "component_id")
    return tiles(spark, d).select("tile_id", "component_id", F.row_number().over(w).alias("rank"))


@query("win_avg_rank", twin("select tile_id, component_id, rank() over (partition by tile_id order by h) + (count(*) over (partition by tile_id, h) - 1) / 2.0::double as avg_rank from comp"))
def win_avg_rank(spark, d):
    ties = F.count("*").over(Window.partitionBy("tile_id", "h"))
    return tiles(spark, d).select("tile_id", "component_id", (F.rank().over(Window.partitionBy("tile_id").orderBy("h")) + (ties - 1) / 2).alias("avg_rank"))


@query("win_cumulative", twin("select tile_id, component_id, sum(case when border then 0 else 1 end) over w / row_number() over w as precision from comp window w as (partition by tile_id order by confidence desc, component_id rows unbounded preceding)"))
def win_cumulative(spark, d):
    w = Window.partitionBy("tile_id").orderBy(F.desc("confidence"), "component_id")
    hits = F.sum(F.when(F.col("border"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tiles(spark, d).select("tile_id", "component_id", (hits / F.row_number().over(w)).alias("precision"))


@query("win_round_robin", twin("select tile_id, component_id, row_number() over (partition by split, border order by tile_id, component_id) as k from comp"))
def win_round_robin(spark, d):
    """Numbers within (split, border): within slices of tiles first, then the counts of the slices before are added, so no group is ranked in one task."""
    by = ["split", "border"]
    rows = tiles(spark, d).select("tile_id", "component_id", split_of().alias("split"), "border", F.floor(F.col("tile_id") / 4096).alias("slice"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "slice").agg(F.count("*").alias("n")).select(*by, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for 4096 tiles
    inside = F.row_number().over(Window.partitionBy(*by, "slice").orderBy("tile_id", "component_id"))
    return rows.withColumn("k", inside).join(offsets, [*by, "slice"]).select("tile_id", "component_id", (F.col("k") + F.col("offset")).alias("k"))


@query("win_first_per_group", twin("select tile_id, aid, bid from (select *, row_number() over (partition by tile_id order by aid, bid) r from pr) where r = 1"))
def win_first_per_group(spark, d):
    first = G.pairs(tiles(spark, d)).groupBy("tile_id").agg(F.min(F.struct(F.col("a_component_id").alias("aid"), F.col("b_component_id").alias("bid"))).alias("p"))
    return first.select("tile_id", "p.aid", "p.bid")


# ---- top-k ----


@query("top_confidence", twin("select tile_id, component_id, confidence from comp order by confidence desc, tile_id, component_id limit 100"))
def top_confidence(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", "confidence").orderBy(F.desc("confidence"), "tile_id", "component_id").limit(100)


@query("top_k_hit", twin("select smp.tile_id, query_type, rk3 <= 3 as hit from smp join (select tile_id, component_id, row_number() over (partition by tile_id order by area_px desc, component_id) rk3 from comp) c on c.tile_id = smp.tile_id and c.component_id = target"))
def top_k_hit(spark, d):
    w = Window.partitionBy("tile_id").orderBy(F.desc("area_px"), "component_id")
    ranks = tiles(spark, d).select("tile_id", F.col("component_id").alias("target"), (F.row_number().over(w) <= 3).alias("hit"))
    return samples(spark, d).join(ranks, ["tile_id", "target"]).select("tile_id", "query_type", "hit")


@query("top_reference", twin("select tile_id, component_id as reference from (select *, row_number() over (partition by tile_id order by area_px desc, confidence desc, component_id) r from comp where not border and not mrg) where r = 1"))
def top_reference(spark, d):
    rows = tiles(spark, d).where(R.eligible("largest"))
    return rows.groupBy("tile_id").agg(F.max_by("component_id", F.struct("area_px", "confidence", -F.col("component_id"))).alias("reference"))


@query("top_slice", twin("select tile_id, string_agg(cast(component_id as varchar), ',' order by r) as head from (select *, row_number() over (partition by tile_id order by area_px desc, component_id) r from comp) where r <= 6 group by tile_id"))
def top_slice(spark, d):
    w = Window.partitionBy("tile_id").orderBy(F.desc("area_px"), "component_id")
    rows = tiles(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 6").groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct("r", "component_id"))).alias("x"))
    return rows.select("tile_id", F.array_join(F.col("x.component_id").cast("array<string>"), ",").alias("head"))


@query("top_hash_sample", twin("select tile_id, sha256(cast(tile_id as varchar)) as key from (select distinct tile_id from comp) order by key limit 50"))
def top_hash_sample(spark, d):
    return tiles(spark, d).select("tile_id").distinct().withColumn("key", F.sha2(F.col("tile_id").cast("string"), 256)).orderBy("key").limit(50)


_CELLS = "(select tile_id, cell, coalesce(n, 0) as n, (cell % 8 + 0.5::double) / 8 as px, (cell // 8 + 0.5::double) / 8 as py from (select distinct tile_id from comp) cross join range(0, 64) c(cell) left join (select tile_id, cast(floor(cy / 64) * 8 + floor(cx / 64) as bigint) as cell, count(*) as n from comp group by 1, 2) using (tile_id, cell))"


@query("top_argmax_cell", twin(f"select tile_id, arg_max(cell, n * 64 - cell) as cell, max(n) as n, arg_max(px, n * 64 - cell) as x, arg_max(py, n * 64 - cell) as y, round(sum(exp(n) * px) / sum(exp(n)), 9) as soft_x, round(sum(exp(n) * py) / sum(exp(n)), 9) as soft_y, round(exp(max(n)) / sum(exp(n)), 9) as peak from {_CELLS} group by tile_id"))
def top_argmax_cell(spark, d):
    """The first cell of 8 x 8 with most components and its centre; the mean point and the peak of the softmax over all cells, in which empty cells count by a closed form."""
    cell = (F.floor(F.col("cy") / 64) * 8 + F.floor(F.col("cx") / 64)).alias("cell")
    cells = tiles(spark, d).groupBy("tile_id", cell).agg(F.count("*").alias("n"))
    centre = lambda c: (c + 0.5) / 8
    x, y = centre(F.col("cell") % 8), centre(F.floor(F.col("cell") / 8))
    # shares are taken from the largest count; each empty cell weighs exp(-most), and all centres sum to 32
    top = cells.groupBy("tile_id").agg(F.max_by("cell", F.struct("n", -F.col("cell"))).alias("best"), F.max("n").alias("most"), F.collect_list(F.struct("n", x.alias("x"), y.alias("y"))).alias("cells"))  # 64 cells at most
    base = F.exp(-F.col("most"))
    over = lambda part: F.aggregate("cells", F.lit(0.0), lambda a, c: a + (F.exp(c["n"] - F.col("most")) - base) * part(c))
    total = over(lambda c: F.lit(1.0)) + 64 * base
    soft = lambda k: F.round((over(lambda c: c[k]) + 32 * base) / total, 9)
    return top.select("tile_id", F.col("best").alias("cell"), F.col("most").alias("n"), centre(F.col("best") % 8).alias("x"), centre(F.floor(F.col("best") / 8)).alias("y"), soft("x").alias("soft_x"), soft("y").alias("soft_y"), F.round(1 / total, 9).alias("peak"))


# ---- sets ----


@query("setop_union", twin("select 'level1' as pack, tile_id from smp where level = 1 union select 'level3', tile_id from smp where level = 3"))
def setop_union(spark, d):
    s = samples(spark, d)
    one, three = (s.where(f"level = {k}").select(F.lit(f"level{k}").alias("pack"), "tile_id") for k in (1, 3))
    return one.unionByName(three).distinct()


@query("setop_union_splits", twin("select split, count(*) as n from comp group by split"))
def setop_union_splits(spark, d):
    c = tiles(spark, d).withColumn("split", split_of())
    return c.where("split = 'train'").unionByName(c.where("split = 'val'")).unionByName(c.where("split = 'test'")).groupBy("split").agg(F.count("*").alias("n"))


@query("setop_intersect", twin("select tile_id from smp where level = 1 intersect select tile_id from smp where level = 3"))
def setop_intersect(spark, d):
    s = samples(spark, d)
    return s.where("level = 1").select("tile_id").intersect(s.where("level = 3").select("tile_id"))


@query("setop_except", twin("select tile_id from comp except select tile_id from smp"))
def setop_except(spark, d):
    return tiles(spark, d).select("tile_id").subtract(samples(spark, d).select("tile_id"))


@query("arr_except", twin("select s.tile_id, query_type, coalesce(string_agg(cast(component_id as varchar), ',' order by component_id), '') as distractors from smp s left join comp c on c.tile_id = s.tile_id and component_id <> target and component_id <> coalesce(reference, -1) group by 1, 2, target"))
def arr_except(spark, d):
    every = tiles(spark, d).groupBy("tile_id").agg(F.sort_array(F.collect_list("component_id")).alias("ids"))
    rest = F.array_except("ids", F.array_compact(F.array("target", "reference")))
    return samples(spark, d).join(every, "tile_id").select("tile_id", "query_type", F.array_join(rest.cast("array<string>"), ",").alias("distractors"))


# ---- sampling ----


@query("smp_key", twin("select distinct tile_id, sha256('20260804:' || tile_id) as key from comp"))
def smp_key(spark, d):
    return tiles(spark, d).select("tile_id").distinct().select("tile_id", F.sha2(F.concat_ws(":", F.lit("20260804"), F.col("tile_id").cast("string")), 256).alias("key"))


@query("smp_stratified", twin("select tile_id, query_type, k from (select tile_id, query_type, row_number() over (partition by query_type order by key, tile_id) k from smp) order by k, query_type limit 200"))
def smp_stratified(spark, d):
    """The first 200 by rank within their type; slices of the key give their heads first, so no type is ranked in one task."""
    rows = samples(spark, d).select("tile_id", "query_type", "key")
    part = Window.partitionBy("query_type", F.substring("key", 64, 1)).orderBy("key", "tile_id")
    head = rows.withColumn("k", F.row_number().over(part)).where("k <= 200")
    whole = Window.partitionBy("query_type").orderBy("key", "tile_id")
    return head.select("tile_id", "query_type", F.row_number().over(whole).alias("k")).orderBy("k", "query_type").limit(200)


# ---- scalar functions ----


@query("fn_hash_bucket", "select doc_id, cast(('0x' || substr(sha256(cast(doc_id as varchar)), 1, 16))::ubigint % 97 as bigint) as bucket from documents")
def fn_hash_bucket(spark, d):
    head = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, d, "documents").select("doc_id", (head % 97).cast("long").alias("bucket"))


@query("fn_sha", "select doc_id, sha256(coalesce(text, '')) as digest from documents")
def fn_sha(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("fn_round", "select event_id, round(value, 2) as half_up, round_even(value * 4, 0) / 4 as quarter from events")
def fn_round(spark, d):
    return table(spark, d, "events").select("event_id", F.round("value", 2).alias("half_up"), (F.bround(F.col("value") * 4, 0) / 4).alias("quarter"))


@query("fn_cell", twin("select tile_id, component_id, cast(floor(cx / 32) as bigint) as col, cast(floor(cy / 32) as bigint) as row_, cast(floor(cy / 32) * 16 + floor(cx / 32) as bigint) as cell from comp"))
def fn_cell(spark, d):
    col, row = F.floor(F.col("cx") / 32), F.floor(F.col("cy") / 32)
    return tiles(spark, d).select("tile_id", "component_id", col.alias("col"), row.alias("row_"), (row * 16 + col).alias("cell"))


@query("fn_softmax", twin("select tile_id, component_id, exp(confidence - m) / sum(exp(confidence - m)) over (partition by tile_id) as p from (select *, max(confidence) over (partition by tile_id) m from comp)"))
def fn_softmax(spark, d):
    w = Window.partitionBy("tile_id")
    e = tiles(spark, d).withColumn("e", F.exp(F.col("confidence") - F.max("confidence").over(w)))
    return e.select("tile_id", "component_id", (F.col("e") / F.sum("e").over(w)).alias("p"))


@query("fn_entropy", "select event_type, -sum(p * ln(p)) as entropy from (select event_type, k, count(*) / sum(count(*)) over (partition by event_type) as p from (select event_type, user_id % 16 as k from events) group by event_type, k) group by event_type")
def fn_entropy(spark, d):
    n = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 16).alias("k")).agg(F.count("*").alias("n"))
    # -sum(p ln p) = ln(all) - sum(n ln n) / all
    return n.groupBy("event_type").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


@query("json_props", "select event_type, sum(cast(json_extract_string(props, '$.k') as bigint)) as total, count(*) filter (json_extract_string(props, '$.k') is null) as missing from events group by event_type")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


@query("date_events", "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def date_events(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("str_count", "select doc_id, length(text) - length(replace(text, '.', '')) as n_stops, len(string_split(text, chr(10))) as n_lines from documents")
def str_count(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit(".")))).alias("n_stops"), F.size(F.split("text", "\n")).alias("n_lines"))


@query("str_prefix", "select lang, count(*) filter (starts_with(text, 'The ')) as n_the, count(*) filter (suffix(text, '.')) as n_stop from documents group by lang")
def str_prefix(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.startswith("text", F.lit("The "))).alias("n_the"), F.count_if(F.endswith("text", F.lit("."))).alias("n_stop"))


# ---- validation ----


@query("val_exact_dups", "select md5(text) as digest, count(*) as copies, count(distinct doc_id % 5) as n_splits, min(doc_id) as first_id from documents where text is not null group by 1 having count(distinct doc_id % 5) > 1")
def val_exact_dups(spark, d):
    """Texts that stand in several of five splits (by id), with their copies."""
    rows = table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest"))
    return rows.agg(F.count("*").alias("copies"), F.countDistinct(F.col("doc_id") % 5).alias("n_splits"), F.min("doc_id").alias("first_id")).where("n_splits > 1")


#: Punctuation that counts as equal, and what prompts are compared without.
MARKS, PLAIN_MARKS = "，。？！、：；（）“”‘’", ",.?!,:;()\"\"''"
BLANKS, ENDING = r"[\x09-\x0D\x20\x{3000}]+", r"[.,!?;:]+\z"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text):
    """Text without blanks and marks at its end, A-Z in lower case, one form of each mark."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, BLANKS, ""), UPPER + MARKS, UPPER.lower() + PLAIN_MARKS), ENDING, "")


def leakage(train, evaluated):
    """For each ``grp`` of ``evaluated``: its prompts, and how many prompts of ``train`` are among them exactly and when normalised; a verdict over all groups.

    Prompts meet by digest; training ones are counted by digest first, so a prompt that very many rows share is one row in the join. Null prompts are none.
    """
    kinds = lambda df: df.where("prompt is not null").select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.sha2(v, 256).alias("digest")) for k, v in (("exact", F.col("prompt")), ("normalised", normalised(F.col("prompt"))))))).alias("k")).select(*(c for c in df.columns if c != "prompt"), "k.*")
    known = kinds(train).groupBy("kind", "digest").agg(F.count("*").alias("n"))
    seen = kinds(evaluated).groupBy("grp", "kind", "digest").agg(F.count("*").alias("m"))
    hits = seen.join(known, ["kind", "digest"], "left").groupBy("grp").agg(F.sum(F.when(F.col("kind") == "exact", F.col("m"))).alias("prompts"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_overlaps") for k in ("exact", "normalised")))
    found = F.sum("normalised_overlaps").over(Window.partitionBy(F.lit(1)))  # one row a group
    return hits.withColumn("verdict", F.when(found == 0, "NO_LEAKAGE").otherwise("INVALID_EXPERIMENT"))


_PLAIN = f"sha256(regexp_replace(translate(regexp_replace(text, '{BLANKS}', '', 'g'), '{UPPER}{MARKS}', '{UPPER.lower()}{PLAIN_MARKS.replace(chr(39), chr(39) * 2)}'), '{ENDING}', ''))"


@query("val_leakage", f"""
with t as (select text, {_PLAIN} as plain from documents where text is not null and doc_id % 5 > 1),
e as (select grp, text, {_PLAIN} as plain from (
  select case doc_id % 5 when 0 then 'test' else 'val' end as grp, text from documents where text is not null and doc_id % 5 < 2
  union all select 'restyled', ' ' || replace(text, ',', '，') || '。!' from documents where text is not null and doc_id % 50 = 2)),
r as (select grp, count(*) as prompts,
             (select count(*) from t where text in (select text from e b where b.grp = a.grp)) as exact_overlaps,
             (select count(*) from t where plain in (select plain from e b where b.grp = a.grp)) as normalised_overlaps from e a group by grp)
select *, case when (select sum(normalised_overlaps) from r) = 0 then 'NO_LEAKAGE' else 'INVALID_EXPERIMENT' end as verdict from r""")
def val_leakage(spark, d):
    """Training texts that evaluation texts repeat, for the two held-out splits and for training texts in another style, which only normalising finds."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    k = F.col("doc_id") % 5
    restyled = docs.where("doc_id % 50 = 2").select(F.lit("restyled").alias("grp"), F.concat(F.lit(" "), F.replace("prompt", F.lit(","), F.lit("，")), F.lit("。!")).alias("prompt"))
    held = docs.where(k < 2).select(F.when(k == 0, "test").otherwise("val").alias("grp"), "prompt")
    return leakage(docs.where(k > 1).select("prompt"), held.unionByName(restyled))


@query("val_duplicates", twin("select tile_id, target, count(*) as n from smp group by 1, 2 having count(*) > 1"))
def val_duplicates(spark, d):
    return samples(spark, d).groupBy("tile_id", "target").agg(F.count("*").alias("n")).where("n > 1")


# ---- metrics ----


_SCORED = "(select doc_id, toxic as y, n_chars as s from labels join documents using (doc_id))"


def scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("toxic").alias("y"), F.col("n_chars").alias("s"))


@query("met_auroc", f"select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auroc from (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from {_SCORED})")
def met_auroc(spark, d):
    """Rank statistic from running counts of distinct scores."""
    by = scored(spark, d).groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    ranked = running_totals(by, [], "s", ["n"]).withColumn("r", F.col("before_n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(((F.sum(F.col("r") * F.col("pos")) - p * (p + 1) / 2) / (p * n)).alias("auroc"))


@query("met_pearson", twin("select corr(w, h) as pearson, count(*) as n from comp"))
def met_pearson(spark, d):
    return tiles(spark, d).agg(F.corr("w", "h").alias("pearson"), F.count("*").alias("n"))


@query("met_spearman", twin("select split, corr(rw, rh) as spearman from (select split, rank() over (partition by split order by w) + (count(*) over (partition by split, w) - 1) / 2.0::double rw, rank() over (partition by split order by h) + (count(*) over (partition by split, h) - 1) / 2.0::double rh from comp) group by split"))
def met_spearman(spark, d):
    """Mean ranks from counts by value, joined back: the windows run over distinct values only."""
    c = tiles(spark, d).select(split_of().alias("split"), "w", "h")
    for k in ("w", "h"):
        n = c.groupBy("split", k).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy(k).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        c = c.join(n.select("split", k, (below + (F.col("n") + 1) / 2).alias(f"r{k}")), ["split", k])
    return c.groupBy("split").agg(F.corr("rw", "rh").alias("spearman"))


# ---- vectors ----


@query("vec_stats", "select label, count(*) as n, avg(sqrt(s)) as mean_norm from (select label, list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) s from embeddings) group by label")
def vec_stats(spark, d):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("label", F.sqrt(norm).alias("n_")).groupBy("label").agg(F.count("*").alias("n"), F.avg("n_").alias("mean_norm"))


@query("vec_prototype", "select label, i as dim, avg(cast(embedding[i] as double)) as mean from embeddings, range(1, 65) t(i) group by 1, 2")
def vec_prototype(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean"))
