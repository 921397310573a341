"""Registers queries: a Spark function with its DuckDB twin, written independently of each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Components, pairs and relations for the DuckDB twins; a twin uses what it needs of them.
PRELUDE = """
with raw as materialized (
  select l_orderkey as tile_id,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as component_id,
         cast(l_partkey as bigint) p, cast(l_suppkey as bigint) s, cast(l_linenumber as bigint) n,
         cast(floor(l_quantity) as bigint) q, cast(floor(l_extendedprice) as bigint) e
  from lineitem),
boxed as (
  select *, case when (p + q) % 89 = 0 then 260 + (s % 40) else 8 + (p * 7 + q) % 73 end w,
            case when (p + q) % 89 = 0 then 240 + (s % 40) else 8 + (s * 11 + p * 3 + q) % 67 end h from raw),
placed as (
  select *, case when (n + q) % 11 = 0 then 0 else (p * 37 + n * 71 + e) % (513 - w) end bx,
            case when (n + s) % 13 = 0 then 512 - h else (s * 53 + q * 29 + e) % (513 - h) end as by_ from boxed),
comp as materialized (
  select tile_id, component_id, cast(bx as int) x0, cast(by_ as int) y0, cast(bx + w - 1 as int) x1, cast(by_ + h - 1 as int) y1,
         cast(w as int) w, cast(h as int) h, cast(w * h as bigint) area_px,
         cast(bx as double) + cast(w - 1 as double) / 2.0::double as cx, cast(by_ as double) + cast(h - 1 as double) / 2.0::double as cy,
         (bx = 0 or by_ = 0 or bx + w = 512 or by_ + h = 512) as border,
         cast(w * h as double) / 262144.0::double > 0.20 as mrg, w * h < 150 as tiny,
         cast((p * 31 + n * 17) % 1000 as double) / 1000.0::double as confidence,
         case tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split
  from placed),
pr as materialized (
  select a.tile_id, a.component_id aid, b.component_id bid, a.cx acx, a.cy acy, b.cx bcx, b.cy bcy,
         a.border aborder, a.mrg amrg, a.tiny atiny, b.border bborder, b.mrg bmrg, b.tiny btiny,
         a.area_px aarea, b.area_px barea,
         cast(greatest(0, b.x0 - a.x1, a.x0 - b.x1) as double) gx, cast(greatest(0, b.y0 - a.y1, a.y0 - b.y1) as double) gy,
         a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1
  from comp a join comp b on a.tile_id = b.tile_id and a.component_id <> b.component_id),
pg as materialized (select *, sqrt(gx * gx + gy * gy) as bgap, greatest(0.0::double, sqrt(gx * gx + gy * gy) - 1) as gap from pr),
dir as materialized (
  select tile_id, relation, aid, bid, m, o,
         case when not case when relation in ('left_of', 'above') then m < 0 else m > 0 end then 'wrong_direction'
              when abs(m) < 1.2::double * abs(o) then 'axis_not_dominant' when abs(m) < 0.04::double then 'margin_too_small' end as reason
  from (select tile_id, aid, bid, d.relation, case when d.relation in ('left_of', 'right_of') then dx else dy end m,
               case when d.relation in ('left_of', 'right_of') then dy else dx end o
        from (select *, (acx - bcx) / 512.0::double dx, (acy - bcy) / 512.0::double dy from pr),
             (values ('left_of'), ('right_of'), ('above'), ('below')) d(relation))),
ext_r as (
  select tile_id, relation, component_id, v, row_number() over w r, lead(v) over w v2, count(*) over (partition by tile_id, relation) n
  from (select tile_id, component_id, unnest(['leftmost', 'rightmost', 'topmost', 'bottommost']) relation, unnest([cx, cx, cy, cy]) v, unnest([1, -1, 1, -1]) sgn from comp)
  window w as (partition by tile_id, relation order by sgn * v, sgn * component_id)),
ext as materialized (
  select tile_id, relation, component_id subject, v score, abs(v2 - v) margin,
         case when n < 2 then 'too_few_eligible_candidates' when abs(v2 - v) < 4 then 'ambiguous' end reason from ext_r where r = 1),
siz_r as (
  select tile_id, relation, component_id, v, ok, row_number() over w r, lead(v) over w v2, count(*) over (partition by tile_id, relation) n
  from (select tile_id, component_id, relation, area_px v, ok, sgn from
        (select *, unnest(['largest', 'smallest']) relation, unnest([-1, 1]) sgn, unnest([not border and not mrg, not border and not mrg and not tiny]) ok from comp) where ok)
  window w as (partition by tile_id, relation order by sgn * v, sgn * component_id)),
siz as materialized (
  select tile_id, relation, component_id subject, cast(v as double) score, greatest(v, v2) / greatest(least(v, v2), 1) margin,
         case when n < 2 then 'too_few_eligible_candidates' when greatest(v, v2) / greatest(least(v, v2), 1) < 1.10::double then 'ambiguous' end reason from siz_r where r = 1),
nr_r as (
  select tile_id, aid, bid, gap, row_number() over w r, lead(gap) over w g2 from pg where not bborder and not bmrg and not btiny
  window w as (partition by tile_id, aid order by gap, bid)),
nr as (
  select c.tile_id, c.component_id anchor, case when ok then bid end as object, case when ok then gap end score, case when ok then g2 - gap end margin,
         case when not ok then 'anchor_not_eligible' when bid is null then 'too_few_eligible_candidates'
              when (g2 - gap) / sqrt(524288.0::double) < 0.005::double or g2 - gap < 2 then 'ambiguous' end reason
  from (select *, not border and not mrg and not tiny ok from comp) c left join nr_r on c.tile_id = nr_r.tile_id and c.component_id = nr_r.aid and r = 1),
sem_r as (
  select tile_id, which, component_id, v, ok, row_number() over w r, lead(v) over w v2, count(*) over (partition by tile_id, which) n
  from (select tile_id, component_id, area_px v, unnest(['largest', 'smallest']) which, unnest([-1, 1]) sgn, unnest([not border and not mrg, not border and not mrg and not tiny]) ok from comp)
  window w as (partition by tile_id, which order by sgn * v, sgn * component_id)),
sem as materialized (
  select tile_id, which, component_id target, n,
         case when greatest(v, v2) / greatest(least(v, v2), 1) < 1.10::double then 'semantic_ambiguous' when not ok then 'semantic_target_ineligible' end reason from sem_r where r = 1),
ref as materialized (
  select s.tile_id, s.which, s.target rid, not c.border and not c.mrg and not c.tiny as anchor_ok
  from sem s join comp c on c.tile_id = s.tile_id and c.component_id = s.target where s.reason is null and s.n > 1),
cand as materialized (
  select ref.tile_id, ref.which, ref.rid, ref.anchor_ok, d.relation direction, d.aid cid
  from ref join dir d on d.tile_id = ref.tile_id and d.bid = ref.rid where d.reason is null),
candg as materialized (
  select cand.*, pg.gap, not pg.bborder and not pg.bmrg and not pg.btiny ok
  from cand join pg on pg.tile_id = cand.tile_id and pg.aid = cand.rid and pg.bid = cand.cid),
ser as (select *, row_number() over w r, lead(gap) over w g2 from candg window w as (partition by tile_id, which, direction order by gap, cid)),
l3 as materialized (
  select tile_id, which, direction, max(case when r = 1 then cid end) target, count(case when ok then 1 end) n_ok,
         bool_or(r = 1 and ok) top_ok, bool_or(r = 1 and coalesce((g2 - gap) / sqrt(524288.0::double) < 0.005::double or g2 - gap < 2, false)) top_close
  from ser group by 1, 2, 3),
sn_r as (
  select tile_id, aid, bid, gap, not bborder and not bmrg and not btiny ok, row_number() over w r, lead(gap) over w g2 from pg
  window w as (partition by tile_id, aid order by gap, bid)),
sn as materialized (
  select tile_id, aid anchor, bid target, case when not ok then 'semantic_target_ineligible'
         when (g2 - gap) / sqrt(524288.0::double) < 0.005::double or g2 - gap < 2 then 'semantic_margin_fail' end reason from sn_r where r = 1),
g1 as (
  select tile_id, 1 as level, relation as query_type, cast(null as int) reference, subject target, reason, false as trivial from ext where reason is null or reason <> 'too_few_eligible_candidates'
  union all select tile_id, 1, which, null, target, reason, false from sem where n > 1),
g2 as (
  select ref.tile_id, 2 as level, which || '_to_nearest' query_type, rid reference, sn.target,
         case when not anchor_ok then 'border_ineligible' when sn.reason = 'semantic_target_ineligible' then 'nearest_semantic_ineligible' when sn.reason is not null then 'nearest_margin_fail' end reason, false as trivial
  from ref join sn on sn.tile_id = ref.tile_id and sn.anchor = ref.rid
  union all
  select ref.tile_id, 2, ref.which || '_to_' || d.direction, ref.rid, min(cid),
         case when count(cid) = 0 then 'no_direction_candidate' when count(cid) > 1 then 'multiple_direction_candidates' end, false
  from ref cross join (values ('left_of'), ('right_of'), ('above'), ('below')) d(direction)
       left join cand on cand.tile_id = ref.tile_id and cand.which = ref.which and cand.direction = d.direction
  group by ref.tile_id, ref.which, ref.rid, d.direction
  union all
  select tile_id, 2, which || '_to_' || k, null, null, reason, false from sem cross join (values ('nearest'), ('left_of'), ('right_of'), ('above'), ('below')) t(k) where n > 1 and reason is not null),
g3 as (
  select ref.tile_id, 3 as level, ref.which || '_to_' || d.direction || '_to_nearest' query_type, ref.rid reference, l3.target,
         case when not anchor_ok then 'border_ineligible' when l3.target is null then 'no_direction_candidate' when not top_ok then 'level3_nearest_semantic_ineligible' when top_close then 'nearest_margin_fail' end reason,
         coalesce(anchor_ok and top_ok and not top_close and n_ok = 1, false) as trivial
  from ref cross join (values ('left_of'), ('right_of'), ('above'), ('below')) d(direction)
       left join l3 on l3.tile_id = ref.tile_id and l3.which = ref.which and l3.direction = d.direction where ref.which = 'largest'
  union all
  select tile_id, 3, which || '_to_' || k || '_to_nearest', null, null, reason, false from sem cross join (values ('left_of'), ('right_of'), ('above'), ('below')) t(k) where n > 1 and reason is not null and which = 'largest'),
gen as materialized (select tile_id, level, query_type, reference, case when reason is null then target end target, reason, trivial from (select * from g1 union all select * from g2 union all select * from g3)),
gq as materialized (
  select *, row_number() over (partition by tile_id, level order by key, query_type) rk
  from (select *, sha256('20260804|' || tile_id || '|' || level || '|' || query_type || '|' || sha256(tile_id || '|' || regexp_replace(query_type, '_to_nearest$', '') || '|' || target)) as key from gen where reason is null)),
smp as materialized (select *, case tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split from gq where rk <= case level when 1 then 6 when 2 then 4 else 2 end)
"""


def twin(select: str) -> str:
    return PRELUDE + select
