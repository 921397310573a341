"""Queries of fields over a grid, masses, large images, embeddings, text similarity, greedy samples, files and reports on them."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS
from ..operators import relations as R
from ..operators import runs as P
from ..operators.graph import connected
from ..operators.semantic import references
from ..queries import query, twin
from ..sources import files, shapefiles
from ..sources.tables import split_of, table
from .base_queries import ids, samples, tiles
from .geometry_queries import _DOT, _NORM, _PROTO, dot, prototypes
from .report_queries import both as component_pairs
from .shape_queries import _CELL_BOX, _PIECES, _RINGS, box, boxes_meet, cut, rings, shape_twin, shaped
from .table_queries import _SCORED, scored

C = F.col
DIAG = DEFAULT.diagonal
SIGMA, SLOPE, EPS = 0.05, 0.02, 1e-8
N = 8  # cells a side


# ---- fields around the largest component of a tile ----

_GRID = """,
gr as (
  select r.tile_id, r.rid, u, v, (v + 0.5::double) / 8 - (c.cx + 0.5::double) / 512 as dx, (u + 0.5::double) / 8 - (c.cy + 0.5::double) / 512 as dy, v * 64 + 32 as px, u * 64 + 32 as py
  from ref r join comp c on c.tile_id = r.tile_id and c.component_id = r.rid, range(0, 8) a(u), range(0, 8) b(v) where r.which = 'largest')
"""
_ALPHA, _TAU = f"{DEFAULT.alpha}::double", f"{DEFAULT.tau}::double"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}) / 0.02::double)))"


def _direction_sql(relation: str) -> str:
    main, other = ("dx", "dy") if relation in ("left_of", "right_of") else ("dy", "dx")
    sign = "-" if relation in ("left_of", "above") else ""
    return f"{_sig(sign + main)} * {_sig(f'abs({main}) - {_ALPHA} * abs({other})')} * {_sig(f'abs({main}) - {_TAU}')}"


def _near_sql(points: str, key: str) -> str:
    d = "sqrt(least(1e9::double, greatest(0, p.x0 - g.px, g.px - p.x1) * greatest(0, p.x0 - g.px, g.px - p.x1) + greatest(0, p.y0 - g.py, g.py - p.y1) * greatest(0, p.y0 - g.py, g.py - p.y1)))"
    return f"(select {key}, case when min(d) = 0 then 0 else exp(-min(d) / {DIAG!r}::double / 0.05::double) end as near from (select g.*, {d} as d from {points} g join piece p on p.tile_id = g.tile_id and p.component_id = g.rid) group by {key})"


_CELLS = f"(select tile_id, component_id, u, v, n from (select tile_id, component_id, u, v, {boxes_meet('x0 y0 x1 y1', _CELL_BOX)} - {boxes_meet('ux0 uy0 ux1 uy1', _CELL_BOX)} as n from shp, range(0, 8) a(u), range(0, 8) b(v)) where n > 0)"


def grid(spark, d):
    """An 8 x 8 grid around each reference: offsets of the cells (dx, dy) and their middle pixels (px, py)."""
    refs = references(tiles(spark, d)).where("which = 'largest'").select("tile_id", C("r_component_id").alias("rid"), C("r_cx").alias("cx"), C("r_cy").alias("cy"))
    k = F.sequence(F.lit(0), F.lit(N - 1))
    rows = refs.withColumn("u", F.explode(k)).withColumn("v", F.explode(k))
    off = lambda g, c: ((C(g) + 0.5) / N - (C(c) + 0.5) / DEFAULT.width)
    return rows.select("tile_id", "rid", "u", "v", off("v", "cx").alias("dx"), off("u", "cy").alias("dy"), (C("v") * 64 + 32).alias("px"), (C("u") * 64 + 32).alias("py"))


def sigmoid(x):
    return 1 / (1 + F.exp(-x / SLOPE))


def direction_field(relation: str):
    main, other = (C("dx"), C("dy")) if relation in ("left_of", "right_of") else (C("dy"), C("dx"))
    sign = -main if relation in ("left_of", "above") else main
    return sigmoid(sign) * sigmoid(F.abs(main) - DEFAULT.alpha * F.abs(other)) * sigmoid(F.abs(main) - DEFAULT.tau)


def pieces(spark, d):
    """The boxes that each shape is made of."""
    x0, y0, x1, y1, ux0, uy0, ux1, uy1 = map(C, ("x0", "y0", "x1", "y1", "ux0", "uy0", "ux1", "uy1"))
    part = lambda *v: F.struct(*(x.alias(k) for x, k in zip(v, ("bx0", "by0", "bx1", "by1"), strict=True)))
    whole, parts = F.array(part(x0, y0, x1, y1)), F.array(part(x0, uy1 + 1, x1, y1), part(x0, y0, x1, uy0 - 1), part(x0, uy0, ux0 - 1, uy1), part(ux1 + 1, uy0, x1, uy1))
    rows = shaped(spark, d).select("tile_id", C("component_id").alias("rid"), F.inline(F.when(C("kind") == 0, whole).otherwise(parts)))
    return rows.where("bx0 <= bx1 and by0 <= by1")


def nearest_field(points, spark, d, *key: str):
    """``near`` of points (tile_id, rid, px, py and ``key``): how close the reference's pixels are, 0 inside it."""
    off = lambda lo, hi, p: F.greatest(F.lit(0), C(lo) - C(p), C(p) - C(hi)).cast("double")
    dx, dy = off("bx0", "bx1", "px"), off("by0", "by1", "py")
    far = points.join(pieces(spark, d), ["tile_id", "rid"]).groupBy("tile_id", "rid", *key).agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d"))
    return far.select("tile_id", "rid", *key, F.when(C("d") == 0, 0.0).otherwise(F.exp(-C("d") / DIAG / SIGMA)).alias("near"))


@query("fld_direction", shape_twin("select tile_id, rid, " + ", ".join(f"avg({_direction_sql(r)}) as {r}" for r in DIRECTIONS) + ", max(" + _direction_sql("left_of") + ") as most_left from gr group by 1, 2", _GRID))
def fld_direction(spark, d):
    """Means of the directional fields of each reference: sign, dominant axis and margin as sigmoids."""
    return grid(spark, d).groupBy("tile_id", "rid").agg(*(F.avg(direction_field(r)).alias(r) for r in DIRECTIONS), F.max(direction_field("left_of")).alias("most_left"))


@query("fld_nearest", shape_twin(f"select tile_id, rid, avg(near) as mean, max(near) as most, count(*) filter (near = 0) as n_inside from {_near_sql('gr', 'tile_id, rid, u, v')} group by 1, 2", _GRID + _PIECES))
def fld_nearest(spark, d):
    field = nearest_field(grid(spark, d), spark, d, "u", "v")
    return field.groupBy("tile_id", "rid").agg(F.avg("near").alias("mean"), F.max("near").alias("most"), F.count_if(C("near") == 0).alias("n_inside"))


@query("fld_resize", shape_twin(f"select tile_id, rid, avg(f) as mean, max(f) as most from (select tile_id, rid, u, v, avg(near) as f from {_near_sql('(select tile_id, rid, u, v, i, j, v * 64 + 31 + i as px, u * 64 + 31 + j as py from gr, range(0, 2) s(i), range(0, 2) t(j))', 'tile_id, rid, u, v, i, j')} group by 1, 2, 3, 4) group by 1, 2", _GRID + _PIECES))
def fld_resize(spark, d):
    """The nearest field brought to 8 x 8 by bilinear interpolation: the centre of each cell lies between four pixels."""
    k = F.array(F.lit(0), F.lit(1))
    four = grid(spark, d).withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    points = four.select("tile_id", "rid", "u", "v", "i", "j", (C("v") * 64 + 31 + C("i")).alias("px"), (C("u") * 64 + 31 + C("j")).alias("py"))
    cells = nearest_field(points, spark, d, "u", "v", "i", "j").groupBy("tile_id", "rid", "u", "v").agg(F.least(F.greatest(F.avg("near"), F.lit(0.0)), F.lit(1.0)).alias("f"))
    return cells.groupBy("tile_id", "rid").agg(F.avg("f").alias("mean"), F.max("f").alias("most"))


_PRODUCT = f"(select g.tile_id, g.rid, g.u, g.v, {_direction_sql('left_of')} as dir, near, least(1, greatest(0, {_direction_sql('left_of')} * near)) as w from gr g join {_near_sql('gr', 'tile_id, rid, u, v')} n on n.tile_id = g.tile_id and n.rid = g.rid and n.u = g.u and n.v = g.v)"


def product(spark, d):
    """The left-of field times the nearest field of each reference (w), by cell."""
    g = grid(spark, d)
    near = nearest_field(g, spark, d, "u", "v")
    w = direction_field("left_of") * C("near")
    return g.join(near, ["tile_id", "rid", "u", "v"]).select("tile_id", "rid", "u", "v", direction_field("left_of").alias("dir"), "near", F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)).alias("w"))


def cells(spark, d):
    """(tile_id, component_id, u, v, n): pixels of each shape in each cell it touches."""
    runs = P.runs_of(shaped(spark, d)).withColumn("v", F.explode(F.sequence(F.floor(C("xa") / 64), F.floor(C("xb") / 64))))
    n = F.least("xb", C("v") * 64 + 63) - F.greatest("xa", C("v") * 64) + 1
    return runs.groupBy("tile_id", "component_id", F.floor(C("y") / 64).alias("u"), "v").agg(F.sum(n).alias("n"))


@query("fld_product", shape_twin(f"select tile_id, rid, avg(w) as mean, max(w) as most from {_PRODUCT} group by 1, 2", _GRID + _PIECES))
def fld_product(spark, d):
    return product(spark, d).groupBy("tile_id", "rid").agg(F.avg("w").alias("mean"), F.max("w").alias("most"))


@query("fld_normalize", shape_twin(f"select tile_id, rid, max(w) / (sum(w) + 1e-8::double) as most, sum(w) as mass from {_PRODUCT} group by 1, 2", _GRID + _PIECES))
def fld_normalize(spark, d):
    """The product as a distribution over the cells; its mass before."""
    mass = F.sum("w").over(Window.partitionBy("tile_id", "rid"))
    rows = product(spark, d).withColumns({"mass": mass, "share": C("w") / (mass + EPS)})
    return rows.groupBy("tile_id", "rid").agg(F.max("share").alias("most"), F.max("mass").alias("mass"))


_OVER = f"(select w.*, c.component_id as bid, c.n from {_PRODUCT} w join {_CELLS} c on c.tile_id = w.tile_id and c.u = w.u and c.v = w.v where c.component_id <> w.rid)"


def over_candidates(spark, d):
    """Cells of the product field under each other component of the tile."""
    return product(spark, d).join(cells(spark, d).withColumnRenamed("component_id", "bid"), ["tile_id", "u", "v"]).where("bid != rid")


@query("fld_score", shape_twin(f"select tile_id, rid, bid, max(dir) as score from {_OVER} group by 1, 2, 3", _GRID + _PIECES))
def fld_score(spark, d):
    """The greatest value of the left-of field over each candidate's cells."""
    return over_candidates(spark, d).groupBy("tile_id", "rid", "bid").agg(F.max("dir").alias("score"))


@query("fld_rank", shape_twin(f"select tile_id, rid, bid, s as score, row_number() over (partition by tile_id, rid order by s desc, bid) as rank from (select tile_id, rid, bid, round(sum(w * n) / sum(n), 9) as s from {_OVER} group by 1, 2, 3)", _GRID + _PIECES))
def fld_rank(spark, d):
    """Candidates by the product field's mean over their pixels, ties to the smaller id."""
    rows = over_candidates(spark, d).groupBy("tile_id", "rid", "bid").agg(F.round(F.sum(C("w") * C("n")) / F.sum("n"), 9).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tile_id", "rid").orderBy(F.desc("score"), "bid")))


@query("agg_points", shape_twin(f"select split, count(*) as n, count(*) filter (r <= 1) as top1, count(*) filter (r <= 5) as top5, count(*) filter (r <= 25) as top25, count(*) filter (r <= 25) / count(*) as top25_rate, avg(f.w) as mean_value from (select p.tile_id, p.rid, p.w, row_number() over (partition by p.tile_id, p.rid order by round(w, 9) desc, p.u * 8 + p.v) as r, p.u, p.v from {_PRODUCT} p) f join comp c on c.tile_id = f.tile_id and c.component_id <> f.rid and cast(floor(c.cy / 64) as bigint) = f.u and cast(floor(c.cx / 64) as bigint) = f.v group by split", _GRID + _PIECES))
def agg_points(spark, d):
    """How high the cell of each other component's centre ranks in its tile's product field."""
    rank = F.row_number().over(Window.partitionBy("tile_id", "rid").orderBy(F.desc(F.round("w", 9)), C("u") * N + C("v")))
    at = tiles(spark, d).select("tile_id", "component_id", F.floor(C("cy") / 64).alias("u"), F.floor(C("cx") / 64).alias("v"))
    rows = product(spark, d).withColumn("r", rank).join(at, ["tile_id", "u", "v"]).where("component_id != rid").withColumn("split", split_of())
    top = {k: F.count_if(C("r") <= k) for k in (1, 5, 25)}
    return rows.groupBy("split").agg(F.count("*").alias("n"), *(v.alias(f"top{k}") for k, v in top.items()), (top[25] / F.count("*")).alias("top25_rate"), F.avg("w").alias("mean_value"))


# ---- masses of pairs ----

_MASSES = f""",
cel as {_CELLS},
dots as (select a.tile_id, a.component_id as aid, b.component_id as bid, cast(sum(a.n * b.n) as double) as s from cel a join cel b on a.tile_id = b.tile_id and a.u = b.u and a.v = b.v group by 1, 2, 3),
mas as (select p.tile_id, p.aid, p.bid, coalesce(aa.s, 0) / (a.pixels * 4096.0::double) as p_aa, coalesce(ab.s, 0) / (a.pixels * 4096.0::double) as p_ab, coalesce(bb.s, 0) / (b.pixels * 4096.0::double) as p_bb, coalesce(ab.s, 0) / (b.pixels * 4096.0::double) as p_ba
        from (select a.tile_id, a.component_id aid, b.component_id bid from shp a join shp b on a.tile_id = b.tile_id and a.component_id < b.component_id) p
        join shp a on a.tile_id = p.tile_id and a.component_id = p.aid join shp b on b.tile_id = p.tile_id and b.component_id = p.bid
        left join dots aa on aa.tile_id = p.tile_id and aa.aid = p.aid and aa.bid = p.aid left join dots bb on bb.tile_id = p.tile_id and bb.aid = p.bid and bb.bid = p.bid left join dots ab on ab.tile_id = p.tile_id and ab.aid = p.aid and ab.bid = p.bid)
"""


def masses(spark, d):
    """Own and cross masses of pairs: each one's pixels as a distribution over cells, against either's coverage."""
    c = cells(spark, d)
    a, b = (c.select("tile_id", "u", "v", C("component_id").alias(f"{k}id"), C("n").alias(f"n{k}")) for k in "ab")
    dots = a.join(b, ["tile_id", "u", "v"]).groupBy("tile_id", "aid", "bid").agg(F.sum(C("na") * C("nb")).cast("double").alias("s"))
    own = dots.where("aid = bid").join(shaped(spark, d).select("tile_id", C("component_id").alias("aid"), "pixels"), ["tile_id", "aid"])
    side = lambda k: own.select("tile_id", C("aid").alias(f"{k}id"), C("s").alias(f"s{k}"), (C("pixels") * 4096.0).alias(f"m{k}"))
    rows = side("a").join(side("b"), "tile_id").where("aid < bid").join(dots.where("aid < bid"), ["tile_id", "aid", "bid"], "left")
    s = F.coalesce("s", F.lit(0.0))
    return rows.select("tile_id", "aid", "bid", (C("sa") / C("ma")).alias("p_aa"), (s / C("ma")).alias("p_ab"), (C("sb") / C("mb")).alias("p_bb"), (s / C("mb")).alias("p_ba"))


@query("fn_region_mass", shape_twin("select tile_id, aid, bid, p_aa, p_ab, p_bb, p_ba, p_aa - p_ab as margin_a, p_bb - p_ba as margin_b, p_aa / (p_aa + p_ab + 2e-8::double) as ratio_a, p_bb / (p_bb + p_ba + 2e-8::double) as ratio_b from mas", _MASSES))
def fn_region_mass(spark, d):
    ratio = lambda own, other: C(own) / (C(own) + C(other) + 2 * EPS)
    return masses(spark, d).select("*", (C("p_aa") - C("p_ab")).alias("margin_a"), (C("p_bb") - C("p_ba")).alias("margin_b"), ratio("p_aa", "p_ab").alias("ratio_a"), ratio("p_bb", "p_ba").alias("ratio_b"))


@query("fn_pair_loss", shape_twin("select tile_id, aid, bid, 0.5 * (-ln((p_aa + 1e-8::double) / (p_aa + p_ab + 2e-8::double)) - ln((p_bb + 1e-8::double) / (p_bb + p_ba + 2e-8::double))) as bounded, 0.5 * (ln(1 + exp(1 - (p_aa - p_ab))) + ln(1 + exp(1 - (p_bb - p_ba)))) as softplus from mas", _MASSES))
def fn_pair_loss(spark, d):
    log = lambda own, other: -F.log((C(own) + EPS) / (C(own) + C(other) + 2 * EPS))
    soft = lambda own, other: F.log1p(F.exp(1 - (C(own) - C(other))))
    return masses(spark, d).select("tile_id", "aid", "bid", (0.5 * (log("p_aa", "p_ab") + log("p_bb", "p_ba"))).alias("bounded"), (0.5 * (soft("p_aa", "p_ab") + soft("p_bb", "p_ba"))).alias("softplus"))


@query("agg_pairs", shape_twin("select tile_id % 5 as slice, count(*) as n, avg(case when p_aa > p_ab and p_bb > p_ba then 1.0::double else 0.0::double end) as pass_rate, avg(case when p_aa - p_ab >= 0.1 and p_bb - p_ba >= 0.1 then 1.0::double else 0.0::double end) as strict_rate, avg((p_aa - p_ab + p_bb - p_ba) / 2) as mean_margin, min((p_aa - p_ab + p_bb - p_ba) / 2) as least_margin, max((p_aa - p_ab + p_bb - p_ba) / 2) as most_margin, avg(p_aa) as own, avg(p_ab) as crossed from mas group by 1", _MASSES))
def agg_pairs(spark, d):
    a, b = C("p_aa") - C("p_ab"), C("p_bb") - C("p_ba")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    margin = (C("p_aa") - C("p_ab") + C("p_bb") - C("p_ba")) / 2
    return masses(spark, d).groupBy((C("tile_id") % 5).alias("slice")).agg(F.count("*").alias("n"), rate((a > 0) & (b > 0)).alias("pass_rate"), rate((a >= 0.1) & (b >= 0.1)).alias("strict_rate"), F.avg(margin).alias("mean_margin"), F.min(margin).alias("least_margin"), F.max(margin).alias("most_margin"), F.avg("p_aa").alias("own"), F.avg("p_ab").alias("crossed"))


# ---- reports on picks ----

_PICKS = f""",
pick as (
  select g.tile_id, count(a.component_id) as n, count(a.component_id) filter (ok) as n_ok, max(v) filter (ok) as best, arg_max(v, a.pixels * 1000 - a.component_id) filter (ok) as current,
         arg_max(e, a.pixels * 1000 - a.component_id) filter (ok) as error
  from shp g left join (
    select g.tile_id, a.component_id, a.pixels, not a.border and not a.mrg as ok, i / (g.area_px + a.pixels - i) as v, sqrt((a.cx - g.cx) * (a.cx - g.cx) + (a.cy - g.cy) * (a.cy - g.cy)) / 512 as e
    from (select g.*, a.component_id as ac, {boxes_meet(box("g"), box("a"))} - {boxes_meet(box("g"), cut("a"))} as i from shp g join shp a on a.tile_id = g.tile_id and a.component_id <> 1 where g.component_id = 1) g
    join shp a on a.tile_id = g.tile_id and a.component_id = g.ac) a on a.tile_id = g.tile_id
  where g.component_id = 1 group by g.tile_id)
"""
ADEQUATE, NEAR = 0.02, 0.3


def picks(spark, d):
    """Each tile's first component as the aim: how many others there are, how many may be picked, the best and the current fit, and the current error."""
    s = shaped(spark, d)
    aim = P.side(s.where("component_id = 1"), "a", "area_px", "cx", "cy")
    rows = s.where("component_id != 1").join(aim, "tile_id").withColumn("i", P.common("a", "", a_box=True))
    rows = rows.withColumns({"ok": R.eligible("largest"), "v": C("i") / (C("aarea_px") + C("pixels") - C("i")), "e": F.sqrt((C("cx") - C("acx")) * (C("cx") - C("acx")) + (C("cy") - C("acy")) * (C("cy") - C("acy"))) / DEFAULT.width})
    order = F.when(C("ok"), F.struct("pixels", -C("component_id")))
    by = rows.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.max(F.when(C("ok"), C("v"))).alias("best"), F.max_by("v", order).alias("current"), F.max_by("e", order).alias("error"))
    zero = F.lit(0).cast("long")
    return aim.select("tile_id").join(by, "tile_id", "left").withColumns({"n": F.coalesce("n", zero), "n_ok": F.coalesce("n_ok", zero)})


#: Fixed value: overlap from which a reference counts as covered.
COVERED = 0.5


@query("agg_failure_buckets", shape_twin(f"select bucket, count(*) as n from (select case when tile_id % 13 = 0 then 'PARSER_WRONG' when n = 0 then 'REFERENCE_NO_PROPOSALS' when n_ok = 0 then 'REFERENCE_NO_ELIGIBLE' when best < {COVERED} then 'REFERENCE_NOT_COVERED_IOU50' when current < {COVERED} then 'REFERENCE_SELECTION_WRONG' when error > {NEAR} then 'REFERENCE_GEOMETRY_POOR' when best < 2 * {COVERED} then 'TARGET_FAIL_WITH_REFERENCE_OK' else 'TARGET_OK' end as bucket from pick) group by bucket", _PICKS))
def agg_failure_buckets(spark, d):
    """The first of eight rules that each tile meets."""
    rules = ((C("tile_id") % 13 == 0, "PARSER_WRONG"), (C("n") == 0, "REFERENCE_NO_PROPOSALS"), (C("n_ok") == 0, "REFERENCE_NO_ELIGIBLE"), (C("best") < COVERED, "REFERENCE_NOT_COVERED_IOU50"), (C("current") < COVERED, "REFERENCE_SELECTION_WRONG"), (C("error") > NEAR, "REFERENCE_GEOMETRY_POOR"), (C("best") < 2 * COVERED, "TARGET_FAIL_WITH_REFERENCE_OK"))
    bucket = F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules), F.lit("TARGET_OK"))
    return picks(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_gap_decomposition", shape_twin(f"select *, case when selection_gap > 0.5 * coverage_gap then 'selection' when coverage_gap > 0.9 then 'coverage' else 'mixed' end as verdict from (select case tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split, count(*) as n, avg(best) as oracle, avg(current) as picked, avg(best) - avg(current) as selection_gap, 1 - avg(best) as coverage_gap, avg(current) filter (best >= {ADEQUATE}) as picked_if_covered from pick where n_ok > 0 group by 1)", _PICKS))
def agg_gap_decomposition(spark, d):
    """What is lost by picking and what by covering, as differences of means, with a label by thresholds."""
    rows = picks(spark, d).where("n_ok > 0").groupBy(split_of().alias("split"))
    by = rows.agg(F.count("*").alias("n"), F.avg("best").alias("oracle"), F.avg("current").alias("picked"), (F.avg("best") - F.avg("current")).alias("selection_gap"), (1 - F.avg("best")).alias("coverage_gap"), F.avg(F.when(C("best") >= ADEQUATE, C("current"))).alias("picked_if_covered"))
    return by.withColumn("verdict", F.when(C("selection_gap") > 0.5 * C("coverage_gap"), "selection").when(C("coverage_gap") > 0.9, "coverage").otherwise("mixed"))


@query("agg_risk", twin("select split, risk, count(*) as n, avg(case when k >= 4 then 1.0::double else 0.0::double end) as dense_rate, cast(sum(area_px) as bigint) as area from (select *, case when mrg then 'high' when area_px > 3000 or border then 'medium' else 'low' end as risk, count(*) over (partition by tile_id) as k from comp) group by 1, 2"))
def agg_risk(spark, d):
    """Three classes of merge risk by split, and how often they stand in dense tiles."""
    dense = F.count("*").over(Window.partitionBy("tile_id")) >= 4
    risk = F.when(C("mrg"), "high").when((C("area_px") > 3000) | C("border"), "medium").otherwise("low")
    rows = tiles(spark, d).select(split_of().alias("split"), risk.alias("risk"), "area_px", dense.alias("dense"))
    return rows.groupBy("split", "risk").agg(F.count("*").alias("n"), F.avg(F.when(C("dense"), 1.0).otherwise(0.0)).alias("dense_rate"), F.sum("area_px").alias("area"))


@query("agg_language", "select lang, count(*) as n, avg(case when text like '%.' then 1.0::double else 0.0::double end) as finished_rate, avg(n_chars / 100.0::double) as mean_ce, exp(least(avg(n_chars / 100.0::double), 50)) as perplexity from documents group by lang")
def agg_language(spark, d):
    ce = F.avg(C("n_chars") / 100.0)
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.when(C("text").like("%."), 1.0).otherwise(0.0)).alias("finished_rate"), ce.alias("mean_ce"), F.exp(F.least(ce, F.lit(50.0))).alias("perplexity"))


@query("fn_perplexity", "select doc_id, exp(least(n_chars / 100.0::double, 50)) as perplexity from documents")
def fn_perplexity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.exp(F.least(C("n_chars") / 100.0, F.lit(50.0))).alias("perplexity"))


@query("met_box_l1", twin("select tile_id, aid, bid, (abs(ax0 - bx0) + abs(ay0 - by0) + abs(ax1 - bx1) + abs(ay1 - by1)) / 4.0::double as l1 from pr where aid < bid"))
def met_box_l1(spark, d):
    return component_pairs(spark, d).select(*ids(), (sum((F.abs(C(f"a_{k}") - C(f"b_{k}")) for k in ("y0", "x1", "y1")), F.abs(C("a_x0") - C("b_x0"))) / 4.0).alias("l1"))


@query("met_point_error", twin("select split, avg((abs(cx - 255.5) + abs(cy - 255.5)) / 2) as mean_error, avg(abs(cx - 255.5)) as mean_x, avg(abs(cy - 255.5)) as mean_y, max(abs(cx - 255.5)) as most_x, max(abs(cy - 255.5)) as most_y, avg((abs(cx - 255.5) + abs(cy - 255.5)) / 1024) as normalised from comp group by split"))
def met_point_error(spark, d):
    """Error of the tile's centre as a guess: means and greatest values of the absolute offsets, not a distance."""
    dx, dy = F.abs(C("cx") - 255.5), F.abs(C("cy") - 255.5)
    return tiles(spark, d).groupBy(split_of().alias("split")).agg(F.avg((dx + dy) / 2).alias("mean_error"), F.avg(dx).alias("mean_x"), F.avg(dy).alias("mean_y"), F.max(dx).alias("most_x"), F.max(dy).alias("most_y"), F.avg((dx + dy) / 1024).alias("normalised"))


@query("met_binary", f"select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from (select count(*) filter (y = 1 and s > 1000) as tp, count(*) filter (y = 0 and s > 1000) as fp, count(*) filter (y = 1 and s <= 1000) as fn, count(*) filter (y = 0 and s <= 1000) as tn from {_SCORED})")
def met_binary(spark, d):
    y, s = C("y") == 1, C("s") > 1000
    rows = scored(spark, d).agg(F.count_if(y & s).alias("tp"), F.count_if(~y & s).alias("fp"), F.count_if(y & ~s).alias("fn"), F.count_if(~y & ~s).alias("tn"))
    share = lambda n, of: F.when(of == 0, 0.0).otherwise(n / of)
    tp, fp, fn = C("tp"), C("fp"), C("fn")
    return rows.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


# ---- large images: 4 x 4 neighbouring tiles, 2048 pixels a side ----

SIDE, STRIDE = 2048, 384
ANCHORS = {"right_of": (154, 256), "left_of": (358, 256), "above": (256, 358), "below": (256, 154)}  # 0.3, 0.5 and 0.7 of 512, rounded
_BIG = "(select *, tile_id // 16 as image, tile_id % 4 * 512 + x0 as gx0, tile_id // 4 % 4 * 512 + y0 as gy0, tile_id % 4 * 512 + cx as gx, tile_id // 4 % 4 * 512 + cy as gy from comp)"


def big(spark, d):
    """Components in the coordinates of their large image."""
    t = C("tile_id")
    ox, oy = t % 4 * 512, F.floor(t / 4) % 4 * 512
    return tiles(spark, d).withColumns({"image": F.floor(t / 16), "gx0": ox + C("x0"), "gy0": oy + C("y0"), "gx": ox + C("cx"), "gy": oy + C("cy")})


_IMAGES = f"(select image, greatest(512, cast(max(gx0 + w) as int)) as wide, greatest(512, cast(max(gy0 + h) as int)) as high from {_BIG} group by 1)"


def _starts_sql(extent: str, name: str) -> str:
    return f"(select distinct image, greatest(0, least(i * 384, {extent} - 512)) as {name} from {_IMAGES}, range(0, 8) r(i) where i = 0 or (i - 1) * 384 + 512 < {extent})"


@query("til_plan", twin(f"select image, y0, x0, row_number() over (partition by image order by y0, x0) as tile from {_starts_sql('wide', 'x0')} join {_starts_sql('high', 'y0')} using (image)"))
def til_plan(spark, d):
    """Tiles of 512 pixels every 384 over each large image, as far as its components reach; the last ones are shifted inside."""
    extent = lambda at, size: F.greatest(F.lit(512), F.max(C(at) + C(size)).cast("int"))
    images = big(spark, d).groupBy("image").agg(extent("gx0", "w").alias("w"), extent("gy0", "h").alias("h"))
    starts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(C(n) - 512, F.lit(0)) / STRIDE).cast("int")), lambda i: F.greatest(F.lit(0), F.least(i * STRIDE, C(n) - 512))))
    at = images.select("image", "w", F.explode(starts("h")).alias("y0")).select("image", "y0", F.explode(starts("w")).alias("x0"))
    return at.withColumn("tile", F.row_number().over(Window.partitionBy("image").orderBy("y0", "x0")))


_REFS = f"(select b.* from {_BIG} b join siz on siz.tile_id = b.tile_id and siz.relation = 'largest' and siz.subject = b.component_id)"
_SIDES = "case d.k when 'right_of' then c.gx > r.gx when 'left_of' then c.gx < r.gx when 'above' then c.gy < r.gy else c.gy > r.gy end"
_DIRS = "(values ('left_of'), ('right_of'), ('above'), ('below')) d(k)"


def image_references(spark, d):
    """The largest component of each tile, as a reference in its large image."""
    won = R.sizes(tiles(spark, d)).where("relation = 'largest'").select("tile_id", C("subject").alias("component_id"))
    return big(spark, d).join(won, ["tile_id", "component_id"])


def directed(spark, d):
    """Each reference with the other components of its image in each direction by their centres, strictly and without dominance."""
    b = big(spark, d).select("image", C("tile_id").alias("t"), C("component_id").alias("c"), C("gx").alias("cgx"), C("gy").alias("cgy"))
    both = image_references(spark, d).join(b, "image").where("not (t = tile_id and c = component_id)")
    holds = {"right_of": C("cgx") > C("gx"), "left_of": C("cgx") < C("gx"), "above": C("cgy") < C("gy"), "below": C("cgy") > C("gy")}
    found = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in holds.items())))
    return both.withColumn("direction", F.explode(found))


@query("til_half_plane", twin(f"select r.tile_id, d.k as direction, count(*) as n from {_REFS} r join {_BIG} c on c.image = r.image and not (c.tile_id = r.tile_id and c.component_id = r.component_id), {_DIRS} where {_SIDES} group by 1, 2"))
def til_half_plane(spark, d):
    return directed(spark, d).groupBy("tile_id", "direction").agg(F.count("*").alias("n"))


_ANCHOR_SQL = "case k " + " ".join(f"when '{k}' then {{0}}" .format(v[0]) for k, v in ANCHORS.items()) + " end", "case k " + " ".join(f"when '{k}' then {v[1]}" for k, v in ANCHORS.items()) + " end"
_CONTEXT = f"(select r.*, d.k, cast(floor(r.gx - ({_ANCHOR_SQL[0]}) + 0.5) as bigint) as l, cast(floor(r.gy - ({_ANCHOR_SQL[1]}) + 0.5) as bigint) as t, w > 409.6 or h > 409.6 as too_large from {_REFS} r, {_DIRS})"


def contexts(spark, d):
    """A crop of 512 pixels for each reference and direction, which puts the reference where the direction leaves room."""
    k = F.explode(F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for n, (x, y) in ANCHORS.items())))
    rows = image_references(spark, d).withColumn("k", k).select("*", "k.*")
    return rows.withColumns({"left": F.floor(C("gx") - C("ax") + 0.5), "top": F.floor(C("gy") - C("ay") + 0.5), "too_large": (C("w") > 409.6) | (C("h") > 409.6)})


@query("til_context", twin(f"select x.tile_id, x.k as direction, case when too_large then null else l end as left_, case when too_large then null else t end as top, greatest(0, -t) as pad_top, greatest(0, -l) as pad_left, greatest(0, t + 512 - 2048) as pad_bottom, greatest(0, l + 512 - 2048) as pad_right, n_candidates, n_inside, case when too_large then 'reference_too_large' when n_candidates > 0 and n_inside = 0 then 'candidates_outside' end as error from {_CONTEXT} x join (select r.tile_id, r.k, count(c.tile_id) as n_candidates, count(c.tile_id) filter (r.t <= c.gy and c.gy < r.t + 512 and r.l <= c.gx and c.gx < r.l + 512) as n_inside from {_CONTEXT} r left join {_BIG} c on c.image = r.image and not (c.tile_id = r.tile_id and c.component_id = r.component_id) and {_SIDES.replace('d.k', 'r.k')} group by 1, 2) n on n.tile_id = x.tile_id and n.k = x.k"))
def til_context(spark, d):
    """Origin and padding of each context, how many candidates its direction has and how many lie inside, and what makes it fail."""
    rows = contexts(spark, d)
    met = directed(spark, d).select("tile_id", "direction", "cgx", "cgy")
    inside = (C("top") <= C("cgy")) & (C("cgy") < C("top") + 512) & (C("left") <= C("cgx")) & (C("cgx") < C("left") + 512)
    seen = rows.select("tile_id", "direction", "left", "top").join(met, ["tile_id", "direction"], "left").groupBy("tile_id", "direction").agg(F.count("cgx").alias("n_candidates"), F.count_if(inside).alias("n_inside"))
    pad = lambda x: F.greatest(F.lit(0), x)
    error = F.when(C("too_large"), "reference_too_large").when((C("n_candidates") > 0) & (C("n_inside") == 0), "candidates_outside")
    at = lambda k: F.when(~C("too_large"), C(k))
    return rows.join(seen, ["tile_id", "direction"]).select("tile_id", "direction", at("left").alias("left_"), at("top").alias("top"), pad(-C("top")).alias("pad_top"), pad(-C("left")).alias("pad_left"), pad(C("top") + 512 - SIDE).alias("pad_bottom"), pad(C("left") + 512 - SIDE).alias("pad_right"), "n_candidates", "n_inside", error.alias("error"))


@query("til_reflect", twin("select tile_id, k as direction, s, abs(i) as r0, case when i + 511 > 511 then 1022 - (i + 511) else i + 511 end as r511, case when i < 0 then least(511, -i) else 0 end as before, greatest(0, i) as behind, case when i + s > 511 then 1022 - (i + s) else abs(i + s) end as rs from (select tile_id, d.k, cast(floor(cx - case d.k when 'right_of' then 154 when 'left_of' then 358 else 256 end + 0.5) as bigint) as i, tile_id % 512 as s from comp, (values ('left_of'), ('right_of'), ('above')) d(k) where component_id = 1)"))
def til_reflect(spark, d):
    """Which columns of one tile a crop of 512 reads: mirrored at both edges without repeating them."""
    last = DEFAULT.width - 1
    mirror = lambda x: F.lit(last) - F.abs(F.lit(last) - F.pmod(x, F.lit(2 * last)))
    k = F.explode(F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(ANCHORS[n][0]).alias("ax")) for n in ("left_of", "right_of", "above"))))
    rows = tiles(spark, d).where("component_id = 1").withColumn("k", k).select("tile_id", "k.direction", F.floor(C("cx") - C("k.ax") + 0.5).alias("i"), (C("tile_id") % 512).alias("s"))
    return rows.select("tile_id", "direction", "s", mirror(C("i")).alias("r0"), mirror(C("i") + last).alias("r511"), F.greatest(F.lit(0), -C("i")).alias("before"), F.greatest(F.lit(0), C("i")).alias("behind"), mirror(C("i") + C("s")).alias("rs"))


_PROPOSALS = f""",
prop as (
  select *, row_number() over (partition by image order by source, component_id, copy) as p from (
    select image, tile_id as source, component_id, 0 as copy, gx0 as x0, gy0 as y0, gx0 + w - 1 as x1, gy0 + h - 1 as y1, area_px, confidence from {_BIG}
    union all select image, tile_id + 1, component_id, 1, gx0 + component_id % 3, gy0 + 1, gx0 + component_id % 3 + w - 1, gy0 + h, area_px, confidence * 0.9::double from {_BIG} where component_id % 2 = 1 and gy0 + h < 2048 and gx0 + w + 2 < 2048)),
lnk as (select image, a, b from (select a.image, a.p as a, b.p as b, a.area_px as ap, b.area_px as bp, {boxes_meet(box("a"), box("b"))} as i from prop a join prop b on a.image = b.image and a.p <> b.p) where i / (ap + bp - i) >= 0.5)
"""
_MERGED = """
reach as (select image, p as a, p as b from prop union select r.image, r.a, l.b from reach r join lnk l on l.image = r.image and l.a = r.b),
grp as (select image, a as p, min(b) as g from reach group by 1, 2),
win as (select *, row_number() over (partition by image, g order by touches, -clear, -area_px, -confidence, source, component_id, copy) as r, count(*) over (partition by image, g) as size
        from (select prop.*, g, x0 = 0 or y0 = 0 or x1 = 2047 or y1 = 2047 as touches, least(x0, y0, 2047 - x1, 2047 - y1) as clear from prop join grp using (image, p)))
select image, row_number() over (partition by image order by round((y0 + y1) / 2.0::double, 6), round((x0 + x1) / 2.0::double, 6), area_px, source, component_id) as proposal, source, component_id, copy, size from win where r = 1
"""


def proposals(spark, d):
    """Components as proposals of their large image; odd ones are seen from the next tile, too, slightly shifted and with less confidence."""
    b = big(spark, d)
    cols = ("component_id", "copy", "x0", "y0", "x1", "y1", "area_px", "confidence")
    first = b.select("image", C("tile_id").alias("source"), "component_id", F.lit(0).alias("copy"), C("gx0").alias("x0"), C("gy0").alias("y0"), (C("gx0") + C("w") - 1).alias("x1"), (C("gy0") + C("h") - 1).alias("y1"), "area_px", "confidence")
    again = b.where((C("component_id") % 2 == 1) & (C("gy0") + C("h") < SIDE) & (C("gx0") + C("w") + 2 < SIDE))
    x = C("gx0") + C("component_id") % 3
    again = again.select("image", (C("tile_id") + 1).alias("source"), "component_id", F.lit(1).alias("copy"), x.alias("x0"), (C("gy0") + 1).alias("y0"), (x + C("w") - 1).alias("x1"), (C("gy0") + C("h")).alias("y1"), "area_px", (C("confidence") * 0.9).alias("confidence"))
    both = first.unionByName(again.select("image", "source", *cols))
    return both.withColumn("p", C("source") * 1000 + C("component_id") * 2 + C("copy"))


@query("til_merge", "with recursive" + shape_twin("", _PROPOSALS).strip()[4:] + "," + _MERGED)
def til_merge(spark, d):
    """One proposal of each group of duplicates, linked at IoU 0.5 within an image: clear of the border, large and certain ones first."""
    rows = proposals(spark, d)
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(C(lo) / 128), F.floor(C(hi) / 128)))
    spread = rows.withColumn("u", cell("x0", "x1")).withColumn("v", cell("y0", "y1"))
    a, b = (spread.select("image", "u", "v", *(C(c).alias(f"{k}_{c}") for c in ("p", "x0", "y0", "x1", "y1", "area_px"))) for k in "ab")
    met = a.join(b, ["image", "u", "v"]).where("a_p < b_p")
    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0") + 1
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0") + 1
    i = F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)
    links = met.where(i / (C("a_area_px") + C("b_area_px") - i) >= 0.5).select("a_p", "b_p").distinct()
    groups = connected(links, "a_p", "b_p").select(C("node").alias("p"), "group")
    all_ = rows.join(groups, "p", "left").withColumn("g", F.coalesce("group", "p"))
    edge = SIDE - 1
    touches = (C("x0") == 0) | (C("y0") == 0) | (C("x1") == edge) | (C("y1") == edge)
    order = F.struct(touches, -F.least("x0", "y0", edge - C("x1"), edge - C("y1")), -C("area_px"), -C("confidence"), "source", "component_id", "copy")
    won = all_.groupBy("image", "g").agg(F.min_by(F.struct("source", "component_id", "copy", "x0", "y0", "x1", "y1", "area_px"), order).alias("w"), F.count("*").alias("size")).select("image", "w.*", "size")
    centre = lambda k: F.round((C(f"{k}0") + C(f"{k}1")) / 2, 6)
    rank = F.row_number().over(Window.partitionBy("image").orderBy(centre("y"), centre("x"), "area_px", "source", "component_id"))
    return won.select("image", rank.alias("proposal"), "source", "component_id", "copy", "size")


# ---- embeddings ----


_MEAN = "(select list(m order by i) as mu from (select i, avg(cast(embedding[i] as double)) m from embeddings, range(1, 65) t(i) group by i))"


@query("vec_centered", f"select label, round(avg({_DOT.format(a='a', b='b')} / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x)))), 9) as cosine, count(*) as n from (select e.label, list_transform(list_zip(embedding, mu), lambda z: cast(z[1] as double) - z[2]) as a, list_transform(list_zip(proto, mu), lambda z: z[1] - z[2]) as b from embeddings e join {_PROTO} p on p.label = e.label, {_MEAN}) group by label")
def vec_centered(spark, d):
    """Mean cosine of each label's vectors to their prototype after the mean of all vectors is taken off both."""
    rows = table(spark, d, "embeddings").select("label", "embedding")
    by = rows.select(F.posexplode("embedding").alias("p", "x")).groupBy("p").agg(F.avg(C("x").cast("double")).alias("m"))
    mean = by.agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("mu"))
    off = lambda v: F.zip_with(v, "mu", lambda x, y: x.cast("double") - y)
    both = rows.join(prototypes(rows), "label").join(F.broadcast(mean)).select("label", off("embedding").alias("a"), off("proto").alias("b"))  # one row
    return both.groupBy("label").agg(F.round(F.avg(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))), 9).alias("cosine"), F.count("*").alias("n"))


@query("vec_dist_corr", "with p as (select a.label as la, b.label as lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select round(corr(distance, cast(abs(la - lb) as double)), 6) as correlation, count(*) as n, round(avg(distance), 6) as mean_distance from p")
def vec_dist_corr(spark, d):
    """Pearson correlation over pairs of neighbouring ids: the distance of their vectors and that of their labels."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    b = e.select((C("vec_id") - 1).alias("vec_id"), C("label").alias("lb"), C("embedding").alias("eb"))
    rows = e.join(b, "vec_id").withColumn("off", F.zip_with("embedding", "eb", lambda x, y: x.cast("double") - y.cast("double")))
    rows = rows.select(F.sqrt(dot("off", "off")).alias("distance"), F.abs(C("label") - C("lb")).cast("double").alias("apart"))
    return rows.agg(F.round(F.corr("distance", "apart"), 6).alias("correlation"), F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def spectrum(vectors):
    """(label, n, explained..., ranks) of (label, embedding): sums of outer products by task, then one small eigenproblem a label."""

    def sums(batches):
        found: dict = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
            for label in pd.unique(batch.column(0).to_pandas()):
                rows = x[batch.column(0).to_numpy(zero_copy_only=False) == label]
                n, s, g = found.get(label, (0, 0.0, 0.0))
                found[label] = n + len(rows), s + rows.sum(0), g + rows.T @ rows
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([np.append(v[1], v[2].ravel()).tolist() for v in found.values()], pa.list_(pa.float64()))], ["label", "n", "sums"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n, total = int(part["n"].sum()), np.sum(np.stack(part["sums"].to_numpy()), axis=0)
        k = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
        s, gram = total[:k], total[k:].reshape(k, k)
        energy = np.clip(np.linalg.eigvalsh(gram - np.outer(s, s) / n)[::-1], 0, None)
        share = energy / energy.sum() if energy.sum() else energy
        entropy = float(-(share * np.log(np.clip(share, 1e-12, None))).sum())
        rank90 = int(np.searchsorted(np.cumsum(share), 0.9) + 1) if energy.sum() else 0
        return pd.DataFrame([(int(part["label"].iloc[0]), n, round(float(energy.sum()), 4), *(round(float(share[:i].sum()), 6) for i in (1, 5, 10)), round(float(np.exp(entropy)), 4), rank90)], columns=["label", "n", "total_energy", "top1", "top5", "top10", "effective_rank", "rank90"])

    partial = vectors.select(C("label").cast("long").alias("label"), "embedding").mapInArrow(sums, "label long, n long, sums array<double>")
    return partial.groupBy("label").applyInPandas(solve, "label long, n long, total_energy double, top1 double, top5 double, top10 double, effective_rank double, rank90 int")


@query("vec_svd")
def vec_svd(spark, d):
    """Explained variance and effective ranks of each label's centred vectors."""
    return spectrum(table(spark, d, "embeddings"))


# ---- text similarity ----


@query("met_char_sim")
def met_char_sim(spark, d):
    """Ratio of matching blocks between each turn and the next one."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not x and not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\p{Punct}", ""))).alias("t"))
    pairs = rows.withColumn("next", F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return pairs.select("conv_id", "turn", F.round(ratio("t", "next"), 9).alias("similarity"))


# ---- greedy samples over a bounded head ----

WANTED = 40


@query("smp_balanced")
def smp_balanced(spark, d):
    """40 questions of level 1 by turns of type, preferring tiles not used yet.

    Whatever is chosen, no type ever passes over more than 40 used tiles, so the first
    80 questions of each type in order decide: the greedy choice runs on these alone.
    """
    name = F.concat_ws("-", F.lpad(C("tile_id").cast("string"), 12, "0"), "query_type")
    rows = samples(spark, d).where("level = 1").select("tile_id", "query_type", name.alias("sample"))
    part = Window.partitionBy("query_type", F.pmod("tile_id", F.lit(64))).orderBy("sample")
    whole = Window.partitionBy("query_type").orderBy("sample")
    few = rows.withColumn("k", F.row_number().over(part)).where(C("k") <= 2 * WANTED)
    head = few.withColumn("k", F.row_number().over(whole)).where(C("k") <= 2 * WANTED)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        pools = {t: g.sort_values("sample").to_dict("records") for t, g in part.groupby("query_type")}
        chosen, used = [], set()
        while len(chosen) < WANTED:
            before = len(chosen)
            for t in sorted(pools):
                fresh = next((i for i, r in enumerate(pools[t]) if r["tile_id"] not in used), None)
                if fresh is not None and len(chosen) < WANTED:
                    row = pools[t][fresh]
                    pools[t] = pools[t][fresh + 1 :]
                    used.add(row["tile_id"])
                    chosen.append((row["tile_id"], t, len(chosen) + 1, False))
            if len(chosen) == before:
                break
        taken = {(r[0], r[1]) for r in chosen}
        for row in part.sort_values(["query_type", "sample"]).to_dict("records"):
            if len(chosen) < WANTED and (row["tile_id"], row["query_type"]) not in taken:
                chosen.append((row["tile_id"], row["query_type"], len(chosen) + 1, True))
        return pd.DataFrame(chosen, columns=["tile_id", "query_type", "place", "reused"])

    return head.groupBy().applyInPandas(choose, "tile_id long, query_type string, place int, reused boolean")


COMPOSITION = ((1, 2, 20), (2, 3, 20), (1, 3, 20))


@query("smp_paired_greedy")
def smp_paired_greedy(spark, d):
    """Pairs of questions of two levels of one tile, each tile once, always of the types used least so far.

    A choice takes the least tile of a pair of types that is not used; as 60 tiles are used
    at most, the first 61 of each pair of types decide.
    """
    total = sum(q for _, _, q in COMPOSITION)
    s = samples(spark, d).where("level < 3 or not trivial").select("tile_id", "level", "query_type", "target")
    a, b = (s.select("tile_id", *(C(c).alias(f"{c}_{k}") for c in ("level", "query_type", "target"))) for k in "ab")
    levels = F.lit(False)
    for x, y, _ in COMPOSITION:
        levels = levels | ((C("level_a") == x) & (C("level_b") == y))
    rows = a.join(b, "tile_id").where(levels & (C("target_a") != C("target_b")) & (C("query_type_a") != C("query_type_b")))
    key = ("level_a", "level_b", "query_type_a", "query_type_b")
    part = Window.partitionBy(*key, F.pmod("tile_id", F.lit(64))).orderBy("tile_id")
    few = rows.withColumn("k", F.row_number().over(part)).where(C("k") <= total + 1)
    head = few.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("tile_id"))).where(C("k") <= total + 1)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for x, y, quota in COMPOSITION:
            rows = part[(part["level_a"] == x) & (part["level_b"] == y)].to_dict("records")
            of_a, of_b = {}, {}
            for place in range(quota):
                free = [r for r in rows if r["tile_id"] not in used]
                if not free:
                    break
                best = min(free, key=lambda r: (of_a.get(r["query_type_a"], 0), of_b.get(r["query_type_b"], 0), r["query_type_a"], r["query_type_b"], r["tile_id"]))
                used.add(best["tile_id"])
                of_a[best["query_type_a"]] = of_a.get(best["query_type_a"], 0) + 1
                of_b[best["query_type_b"]] = of_b.get(best["query_type_b"], 0) + 1
                out.append((f"L{x}_L{y}", place + 1, best["tile_id"], best["query_type_a"], best["query_type_b"]))
        return pd.DataFrame(out, columns=["bucket", "place", "tile_id", "type_a", "type_b"])

    return head.groupBy().applyInPandas(choose, "bucket string, place int, tile_id long, type_a string, type_b string")


# ---- files ----

RECORD = "tile_id long, component_id int, area_px long, box struct<x0:int,y0:int,x1:int,y1:int>, cx double, flags array<string>"


def records(spark, d):
    flags = F.array_compact(F.array(*(F.when(C(k), F.lit(k)) for k in ("border", "mrg", "tiny"))))
    return tiles(spark, d).select("tile_id", "component_id", "area_px", F.struct("x0", "y0", "x1", "y1").alias("box"), "cx", flags.alias("flags"), split_of().alias("split"))


@query("src_json_roundtrip", twin("select tile_id, split, count(*) as n, cast(sum(area_px) as bigint) as area, max(x1) as x1, sum(cx) as cx, count(*) filter (border) as n_border from comp group by 1, 2"))
def src_json_roundtrip(spark, d):
    """Records written as JSON lines, a folder a split, and read back by an explicit schema."""
    path = files.scratch(spark, "json")
    files.write_json_lines(records(spark, d), path, "split")
    back = files.read_json_lines(spark, path, RECORD + ", split string")
    return back.groupBy("tile_id", "split").agg(F.count("*").alias("n"), F.sum("area_px").alias("area"), F.max("box.x1").alias("x1"), F.sum("cx").alias("cx"), F.count_if(F.array_contains("flags", "border")).alias("n_border"))


@query("sink_json_sorted", twin("select split, '{\"area_px\":' || area_px || ',\"component_id\":' || component_id || ',\"flags\":[' || concat_ws(',', case when border then '\"border\"' end, case when mrg then '\"mrg\"' end, case when tiny then '\"tiny\"' end) || '],\"tile_id\":' || tile_id || '}' as line from comp"))
def sink_json_sorted(spark, d):
    """The lines themselves: keys in order, no spaces."""
    path = files.scratch(spark, "sorted")
    files.write_json_lines(records(spark, d).drop("box", "cx"), path, "split")
    return spark.read.text(path).select(C("split").cast("string").alias("split"), C("value").alias("line"))


@query("scan_partition_prune", twin("select 'v2' as version, split, count(*) as n, cast(sum(area_px) as bigint) as area from comp where split <> 'train' group by split"))
def scan_partition_prune(spark, d):
    """Two versions of the records in folders by version and split; the filters on both read the folders they need."""
    path = files.scratch(spark, "versions")
    rows = records(spark, d).select("tile_id", "component_id", "area_px", "split")
    files.write_json_lines(rows.withColumn("version", F.explode(F.array(F.lit("v1"), F.lit("v2")))), path, "version", "split")
    back = files.read_json_lines(spark, path, "tile_id long, component_id int, area_px long, version string, split string")
    return back.where("version = 'v2' and split != 'train'").groupBy("version", "split").agg(F.count("*").alias("n"), F.sum("area_px").alias("area"))


_LABEL = "(select tile_id, component_id, case when component_id % 4 = 0 then '1' else '0' end || ' ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y0 || case when tile_id % 10 = 0 then ' x' else ' ' || x1 end || ' ' || y1 || case when tile_id % 9 = 0 then ' 5' else '' end || case when tile_id % 7 = 0 and component_id = 1 then '' else ' ' || x0 || ' ' || y1 end as line from comp)"


@query("src_text_permissive", twin(f"select tile_id, line, malformed, case when not malformed then n_points end as n_points, case when not malformed then class_ end as class_, case when not malformed then pixels end as pixels from (select tile_id, line, n < 7 or n % 2 = 0 or numeric_ < n as malformed, (n - 1) // 2 as n_points, try_cast(t[1] as int) as class_, len(list_distinct(list_transform(range(1, (n + 1) // 2), lambda i: least(511, greatest(0, round_even(try_cast(t[2 * i] as double), 0))) * 1000 + least(511, greatest(0, round_even(try_cast(t[2 * i + 1] as double), 0)))))) as pixels from (select tile_id, line, t, len(t) as n, len(list_filter(t, lambda x: try_cast(x as double) is not null)) as numeric_ from (select tile_id, line, string_split(line, ' ') as t from {_LABEL})))"))
def src_text_permissive(spark, d):
    """Label lines written as text and read back: malformed ones are told apart, others decoded to pixels."""
    c = tiles(spark, d)
    t, k = C("tile_id"), C("component_id")
    word = lambda x: F.concat(F.lit(" "), C(x).cast("string"))
    line = F.concat(F.when(k % 4 == 0, "1").otherwise("0"), word("x0"), word("y0"), word("x1"), word("y0"), F.when(t % 10 == 0, " x").otherwise(word("x1")), word("y1"), F.when(t % 9 == 0, " 5").otherwise(""), F.when((t % 7 == 0) & (k == 1), "").otherwise(F.concat(word("x0"), word("y1"))))
    path = files.scratch(spark, "labels")
    c.select(F.concat(t.cast("string"), F.lit("\t"), line).alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).cast("long").alias("tile_id"), F.get("p", F.lit(1)).alias("line"))
    rows = rows.withColumn("t", F.split(F.trim("line"), r"\s+")).withColumn("x", F.transform("t", lambda w: w.try_cast("double"))).withColumn("n", F.size("t"))
    bad = (C("n") < 7) | (C("n") % 2 == 0) | F.exists("x", lambda v: v.isNull())
    pixel = lambda v: F.least(F.lit(511.0), F.greatest(F.lit(0.0), F.bround(v, 0)))
    points = F.array_distinct(F.transform(F.sequence(F.lit(1), F.floor((C("n") - 1) / 2).cast("int")), lambda i: pixel(F.get("x", 2 * i - 1)) * 1000 + pixel(F.get("x", 2 * i))))
    good = lambda c: F.when(~bad, c)
    return rows.select("tile_id", "line", bad.alias("malformed"), good(F.floor((C("n") - 1) / 2)).alias("n_points"), good(F.get("t", F.lit(0)).try_cast("int")).alias("class_"), good(F.size(points)).alias("pixels"))


@query("src_datasource_v2", shape_twin("select case when nothing then 0 else 5 end as shape_type, count(*) as n, cast(coalesce(sum(case when not nothing then r end), 0) as bigint) as n_parts, cast(coalesce(sum(case when not nothing then p end), 0) as bigint) as n_points, sum(case when not nothing then x0 end)::double as xmin, sum(case when not nothing then y1 end)::double as ymax from (select tile_id, component_id, any_value(component_id) % 6 = 5 as nothing, count(*) as r, sum(corners + 1) as p, any_value(x0) as x0, any_value(y1) as y1 from rng group by 1, 2) group by 1", _RINGS))
def src_datasource_v2(spark, d):
    """All shapes as polygon records of shapefiles, some of them null, written and read by a data source of our own."""
    spark.dataSource.register(shapefiles.ShapefileSource)
    path = files.scratch(spark, "shapes")
    by = rings(spark, d).groupBy("tile_id", "component_id").agg(F.array_sort(F.collect_list(F.struct("number", "ring")))["ring"].alias("rings"))
    nothing = F.array().cast("array<array<struct<x:double,y:double>>>")
    by.select(F.when(C("component_id") % 6 == 5, nothing).otherwise(C("rings")).alias("rings")).write.format("shapefile").mode("append").save(path)
    back = spark.read.format("shapefile").load(path)
    return back.groupBy("shape_type").agg(F.count("*").alias("n"), F.sum(F.size("parts")).alias("n_parts"), F.sum(F.size("points")).alias("n_points"), F.sum("xmin").alias("xmin"), F.sum("ymax").alias("ymax"))
