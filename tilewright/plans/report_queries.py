"""Queries of filters, reports, audits, metrics and scalar functions over components and their pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, PROGRAMS
from ..operators import geometry as G
from ..operators import relations as R
from ..operators.ranks import running_totals
from ..operators.semantic import size_winners
from ..queries import query, twin
from ..sources.tables import split_of, table
from .base_queries import ids, samples, tiles
from .table_queries import _IOU_SQL, iou, overlap, scored

C = F.col
_LIST = ", ".join(f"'{p}'" for p in PROGRAMS)


def split_tiles(spark, d):
    return tiles(spark, d).withColumn("split", split_of())


def both(spark, d, unordered=True):
    return G.pairs(tiles(spark, d), unordered).withColumn("i", overlap())


# ---- filters and gates ----


@query("flt_nontrivial", twin("select tile_id, query_type, target from smp where level = 3 and not trivial"))
def flt_nontrivial(spark, d):
    return samples(spark, d).where("level = 3 and not trivial").select("tile_id", "query_type", "target")


_PARSED = "(select *, string_split(query_type, '_to_') as s from smp)"


@query("str_program_parse", twin(f"select tile_id, query_type as program, case when len(s) = 1 then 1 when len(s) = 3 and s[-1] = 'nearest' then 3 else 2 end as level, case when len(s) > 1 then 'multi_hop' when query_type in ('largest', 'smallest') then 'size' else 'extreme' end as family, s[1] || '/' || len(s) as bucket from {_PARSED}"))
def str_program_parse(spark, d):
    """Level, family and bucket of the program of every sample, from its name."""
    rows = samples(spark, d).withColumnRenamed("query_type", "program")
    s = F.split("program", "_to_")
    family = F.coalesce(F.when(F.size(s) > 1, "multi_hop"), F.when(C("program").isin("largest", "smallest"), "size"), F.lit("extreme"))
    level = F.when(F.size(s) == 1, 1).when((F.size(s) == 3) & (F.element_at(s, -1) == "nearest"), 3).otherwise(2)
    return rows.select("tile_id", "program", level.alias("level"), family.alias("family"), F.concat_ws("/", F.get(s, F.lit(0)), F.size(s).cast("string")).alias("bucket"))


@query("flt_proposal_eligible", twin("select tile_id, component_id, f as family, not border and w * h / 262144.0::double <= 0.2::double and (f <> 'smallest' or w * h >= 150) as eligible from comp, (values ('largest'), ('smallest'), ('other')) v(f)"))
def flt_proposal_eligible(spark, d):
    ok = ~C("border") & (C("area_px") / float(DEFAULT.width * DEFAULT.height) <= DEFAULT.merge_extent) & ((C("family") != "smallest") | (C("area_px") >= DEFAULT.tiny_area))
    rows = tiles(spark, d).withColumn("family", F.explode(F.array(*map(F.lit, ("largest", "smallest", "other")))))
    return rows.select("tile_id", "component_id", "family", ok.alias("eligible"))


_ASKED = "case when (tile_id + level) % 13 = 0 then '' when (tile_id + level) % 5 = 0 then replace(query_type, 'largest', 'smallest') when (tile_id + level) % 7 = 0 then query_type || '_to_nearest' else query_type end"


@query("flt_program_gate", twin(f"select tile_id, level, query_type, a as asked, case when a = '' then 'E101' when a in ({_LIST}) then 'ok' else 'E102' end as status, case when a <> '' and a not in ({_LIST}) and replace(a, 'smallest', 'largest') in ({_LIST}) then replace(a, 'smallest', 'largest') end as suggestion from (select *, {_ASKED} as a from smp)"))
def flt_program_gate(spark, d):
    """Programs asked for on each sample's tile: some are empty, of the other size or a step too long; a program that is not known gets the one nearest to it."""
    k, kind = C("tile_id") + C("level"), C("query_type")
    asked = F.when(k % 13 == 0, "").when(k % 5 == 0, F.replace(kind, F.lit("largest"), F.lit("smallest"))).when(k % 7 == 0, F.concat(kind, F.lit("_to_nearest"))).otherwise(kind)
    rows = samples(spark, d).withColumn("asked", asked)
    swap = F.replace("asked", F.lit("smallest"), F.lit("largest"))
    bad = ~C("asked").isin(*PROGRAMS) & (C("asked") != "")
    return rows.select("tile_id", "level", "query_type", "asked", F.when(C("asked") == "", "E101").when(bad, "E102").otherwise("ok").alias("status"), F.when(bad & swap.isin(*PROGRAMS), swap).alias("suggestion"))


@query("flt_collapse", twin("select tile_id, sum(w * h) / 262144.0::double < 0.000001::double as is_empty, sum(w * h) / 262144.0::double > 0.999999::double as is_full from comp group by tile_id"))
def flt_collapse(spark, d):
    share = F.sum("area_px") / float(DEFAULT.width * DEFAULT.height)
    return tiles(spark, d).groupBy("tile_id").agg((share < 1e-6).alias("is_empty"), (share > 1 - 1e-6).alias("is_full"))


@query("flt_point_in", twin("select tile_id, aid, bid, rx between bx0 and bx1 and ry between by0 and by1 as by_round, fx between bx0 and bx1 and fy between by0 and by1 as by_floor from (select *, round_even((acx + 0.5) / 512 * 511, 0) rx, round_even((acy + 0.5) / 512 * 511, 0) ry, floor((acx + 0.5) / 512 * 512) fx, floor((acy + 0.5) / 512 * 512) fy from pr)"))
def flt_point_in(spark, d):
    def inside(f):
        x, y = f((C("a_cx") + 0.5) / 512), f((C("a_cy") + 0.5) / 512)
        return x.between(C("b_x0"), C("b_x1")) & y.between(C("b_y0"), C("b_y1"))

    return both(spark, d, False).select(*ids(), inside(lambda p: F.bround(p * 511, 0)).alias("by_round"), inside(lambda p: F.floor(p * 512)).alias("by_floor"))


# ---- audits ----


@query("val_oracle_compare", twin("select relation, count(*) as n, count(*) filter (subject = best) as n_equal from siz join (select tile_id t, arg_max(component_id, area_px * 1000 + component_id) filter (not border and not mrg) as best from comp group by 1) on t = tile_id where relation = 'largest' group by relation"))
def val_oracle_compare(spark, d):
    c = tiles(spark, d)
    again = c.where(R.eligible("largest")).groupBy("tile_id").agg(F.max_by("component_id", F.struct("area_px", "component_id")).alias("best"))
    return R.sizes(c).where("relation = 'largest'").join(again, "tile_id").groupBy("relation").agg(F.count("*").alias("n"), F.count_if(C("subject") == C("best")).alias("n_equal"))


@query("val_hidden", twin("select siz.tile_id, count(*) as n_hidden from siz join comp on comp.tile_id = siz.tile_id where relation = 'largest' and area_px > score and (border or mrg) group by siz.tile_id"))
def val_hidden(spark, d):
    c = tiles(spark, d)
    won = R.sizes(c).where("relation = 'largest'").select("tile_id", "score")
    return c.where(~R.eligible("largest")).join(won, "tile_id").where("area_px > score").groupBy("tile_id").agg(F.count("*").alias("n_hidden"))


@query("val_vocabulary", twin(f"""select n_steps, n, n_distinct, n_unknown, n_known - n_distinct + n_odd as n_unused
 from (select len(s) as n_steps, count(*) as n, count(distinct query_type) as n_distinct, count(*) filter (query_type not in ({_LIST})) as n_unknown, count(distinct case when query_type not in ({_LIST}) then query_type end) as n_odd from {_PARSED} group by len(s))
 join (select len(string_split(p, '_to_')) as k, count(*) as n_known from (select unnest([{_LIST}]) p) group by 1) on k = n_steps"""))
def val_vocabulary(spark, d):
    """Programs in use among the samples by steps: how many are known, and how many known ones of that length nobody asks."""
    steps = F.size(F.split("program", "_to_"))
    rows = samples(spark, d).groupBy(C("query_type").alias("program")).agg(F.count("*").alias("n"))  # a row for each program
    known = spark.createDataFrame([(p, True) for p in PROGRAMS], "program string, known boolean")
    both = rows.join(known, "program", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    by = both.groupBy(steps.alias("n_steps")).agg(F.sum("n").alias("n"), F.count_if(C("n") > 0).alias("n_distinct"), F.sum(F.when(C("known").isNull(), C("n")).otherwise(0)).alias("n_unknown"), F.count_if(C("n") == 0).alias("n_unused"))
    return by.where("n > 0")


@query("prog_recompute", twin("select nr.tile_id, anchor, object, arg_min(bid, gap * 1000 + bid / 1000.0::double) as again from nr join pg on pg.tile_id = nr.tile_id and aid = anchor where object is not null and not bborder and not bmrg and not btiny group by 1, 2, 3"))
def prog_recompute(spark, d):
    c = tiles(spark, d)
    again = G.pairs(c).where(R.eligible("nearest", "b")).groupBy("tile_id", C("a_component_id").alias("anchor")).agg(F.min_by("b_component_id", F.struct(G.boundary_gap(), "b_component_id")).alias("again"))
    return R.nearest(c).where("object is not null").select("tile_id", "anchor", "object").join(again, ["tile_id", "anchor"])


_ISSUES = ("border", "mrg", "tiny")


#: Mentions of internal component numbers in two languages.
LEAKS = (r"(?i)\bcomponents?\s+[0-9]+", r"(组件|构件)\s*[0-9]+")


@query("val_leaks", f"select lang, count(*) filter (regexp_matches(t, '{LEAKS[0]}')) as n_english, count(*) filter (regexp_matches(t, '{LEAKS[1]}')) as n_chinese, cast(sum(len(regexp_extract_all(t, '{LEAKS[0]}')) + len(regexp_extract_all(t, '{LEAKS[1]}'))) as bigint) as n_mentions, count(*) as n from (select lang, coalesce(text, '') || case when doc_id % 50 = 0 then ' see Components 12 and component  7.' when doc_id % 70 = 1 then ' 构件 7、组件3' else '' end as t from documents) group by lang")
def val_leaks(spark, d):
    """Texts that name internal component numbers, in English or Chinese; some are planted by the number of the document."""
    planted = F.when(C("doc_id") % 50 == 0, " see Components 12 and component  7.").when(C("doc_id") % 70 == 1, " 构件 7、组件3").otherwise("")
    rows = table(spark, d, "documents").select("lang", F.concat(F.coalesce("text", F.lit("")), planted).alias("t"))
    english, chinese = (F.regexp_count("t", F.lit(p)) for p in LEAKS)
    return rows.groupBy("lang").agg(F.count_if(english > 0).alias("n_english"), F.count_if(chinese > 0).alias("n_chinese"), F.sum(english + chinese).alias("n_mentions"), F.count("*").alias("n"))


# ---- joins and picks ----


@query("join_pairing_anti", "select doc_id, 'unlabelled' as side from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'missing' from labels where doc_id not in (select doc_id from documents)")
def join_pairing_anti(spark, d):
    a, b = (table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("missing")))


@query("prog_score_pairs", twin("select a.tile_id, a.subject as largest, b.subject as smallest, a.reason is null and b.reason is null and a.subject <> b.subject as passed from siz a join siz b on a.tile_id = b.tile_id where a.relation = 'largest' and b.relation = 'smallest'"))
def prog_score_pairs(spark, d):
    won = R.sizes(tiles(spark, d))
    a, b = (won.where(C("relation") == r).select("tile_id", C("subject").alias(r), C("reason").alias(f"{r}_reason")) for r in ("largest", "smallest"))
    passed = C("largest_reason").isNull() & C("smallest_reason").isNull() & (C("largest") != C("smallest"))
    return a.join(b, "tile_id").select("tile_id", "largest", "smallest", passed.alias("passed"))


@query("prog_dispatch", twin("select tile_id, relation, subject from siz where relation = case tile_id % 2 when 0 then 'largest' else 'smallest' end and reason is null union all select tile_id, relation, subject from ext where relation = 'leftmost' and tile_id % 3 = 0 and reason is null"))
def prog_dispatch(spark, d):
    c = tiles(spark, d)
    size = R.sizes(c).where("reason is null").where(C("relation") == F.when(C("tile_id") % 2 == 0, "largest").otherwise("smallest"))
    ends = R.extremes(c).where("reason is null and relation = 'leftmost' and tile_id % 3 = 0")
    return size.unionByName(ends).select("tile_id", "relation", "subject")


@query("prog_prompt_join", f"select conv_id, ([{_LIST}])[cast(conv_id % 20 + 1 as int)] as program, count(*) as n_turns from conversations group by conv_id")
def prog_prompt_join(spark, d):
    known = F.broadcast(spark.createDataFrame(list(enumerate(PROGRAMS)), "k long, program string"))  # 20 rows
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return rows.withColumn("k", (C("conv_id") % 20).cast("long")).join(known, "k").select("conv_id", "program", "n_turns")


@query("top_policy", twin("select tile_id, component_id as choice from (select *, row_number() over (partition by tile_id order by border, tiny, area_px desc, component_id) r from comp) where r = 1"))
def top_policy(spark, d):
    order = F.struct("border", "tiny", -C("area_px"), "component_id")
    return tiles(spark, d).groupBy("tile_id").agg(F.min_by("component_id", order).alias("choice"))


@query("arr_subset", twin("select tile_id, count(*) filter (not border and not mrg and not tiny) <= count(*) filter (not border and not mrg) as is_subset, count(*) filter (not border and not mrg and tiny) as n_extra from comp group by tile_id"))
def arr_subset(spark, d):
    of = lambda r: F.collect_list(F.when(R.eligible(r), C("component_id")))
    rows = tiles(spark, d).groupBy("tile_id").agg(of("largest").alias("a"), of("smallest").alias("b"))
    return rows.select("tile_id", (F.size(F.array_except("b", "a")) == 0).alias("is_subset"), F.size(F.array_except("a", "b")).alias("n_extra"))


@query("arr_gaps", twin("select tile_id, max(component_id) as top, count(*) as n, max(component_id) = count(*) and min(component_id) = 1 as contiguous from comp group by tile_id"))
def arr_gaps(spark, d):
    top, n = F.max("component_id"), F.count("*")
    return tiles(spark, d).groupBy("tile_id").agg(top.alias("top"), n.alias("n"), ((top == n) & (F.min("component_id") == 1)).alias("contiguous"))


@query("arr_slice", "select label, sum(list_sum(list_transform(embedding[3:6], lambda x: cast(x as double)))) as s, min(len(embedding[3:6])) as n from embeddings group by label")
def arr_slice(spark, d):
    part = F.slice("embedding", 3, 4)
    return table(spark, d, "embeddings").groupBy("label").agg(F.sum(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("s"), F.min(F.size(part)).alias("n"))


@query("map_evidence", twin("select tile_id, component_id, 'area=' || area_px || ';h=' || h || ';w=' || w as evidence from comp"))
def map_evidence(spark, d):
    m = F.create_map(F.lit("w"), C("w").cast("long"), F.lit("h"), C("h").cast("long"), F.lit("area"), C("area_px").cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return tiles(spark, d).select("tile_id", "component_id", text.alias("evidence"))


# ---- sampling and keys ----


@query("fn_sample_id", twin("select tile_id, relation, 'S' || lpad(cast(tile_id as varchar), 8, '0') || '-' || upper(relation) as sample_id from siz"))
def fn_sample_id(spark, d):
    return R.sizes(tiles(spark, d)).select("tile_id", "relation", F.concat(F.lit("S"), F.lpad(C("tile_id").cast("string"), 8, "0"), F.lit("-"), F.upper("relation")).alias("sample_id"))


@query("gen_record", twin("select tile_id, query_type, split || '/' || level || '/' || coalesce(cast(reference as varchar), '-') || '>' || target as record from smp"))
def gen_record(spark, d):
    return samples(spark, d).select("tile_id", "query_type", F.concat(F.concat_ws("/", "split", C("level").cast("string"), F.coalesce(C("reference").cast("string"), F.lit("-"))), F.lit(">"), C("target").cast("string")).alias("record"))


# ---- text ----


@query("str_render", twin("select tile_id, relation, 'component ' || subject || ' is the ' || relation as english, '组件 ' || subject || case relation when 'largest' then ' 面积最大' else ' 面积最小' end as chinese from siz where reason is null"))
def str_render(spark, d):
    rows = R.sizes(tiles(spark, d)).where("reason is null")
    return rows.select("tile_id", "relation", F.format_string("component %d is the %s", "subject", "relation").alias("english"), F.format_string("组件 %d%s", "subject", F.when(C("relation") == "largest", " 面积最大").otherwise(" 面积最小")).alias("chinese"))


@query("str_list_phrase", twin("select tile_id, case when n = 1 then last_ else head || ' and ' || last_ end as phrase, head_zh as phrase_zh from (select tile_id, count(*) n, cast(max(component_id) as varchar) last_, string_agg(cast(component_id as varchar), ', ' order by component_id) filter (component_id < m) head, string_agg(cast(component_id as varchar), '、' order by component_id) head_zh from (select *, max(component_id) over (partition by tile_id) m from comp) group by tile_id)"))
def str_list_phrase(spark, d):
    rows = tiles(spark, d).groupBy("tile_id").agg(F.sort_array(F.collect_list("component_id")).cast("array<string>").alias("x"))
    phrase = F.when(F.size("x") == 1, F.element_at("x", 1)).otherwise(F.concat_ws(" and ", F.array_join(F.slice("x", F.lit(1), F.size("x") - 1), ", "), F.element_at("x", -1)))
    return rows.select("tile_id", phrase.alias("phrase"), F.array_join("x", "、").alias("phrase_zh"))


@query("str_encode", twin("select tile_id, component_id, '0 ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y0 || ' ' || x1 || ' ' || y1 || ' ' || x0 || ' ' || y1 as line from comp"))
def str_encode(spark, d):
    corners = F.array(*(C(k).cast("string") for k in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    return tiles(spark, d).select("tile_id", "component_id", F.concat(F.lit("0 "), F.array_join(corners, " ")).alias("line"))


@query("str_format", "select n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || lpad(cast(n_nationkey as varchar), 3, '0') as slug from nation")
def str_format(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]+", "-")), F.lit("-"), F.lpad(C("n_nationkey").cast("string"), 3, "0")).alias("slug"))


@query("scan_tile_grid", twin("select distinct tile_id, tile_id // 100 as row_, tile_id % 100 as col, tile_id < 10000 as inside from comp"))
def scan_tile_grid(spark, d):
    return tiles(spark, d).select("tile_id").distinct().select("tile_id", F.floor(C("tile_id") / 100).alias("row_"), (C("tile_id") % 100).alias("col"), (C("tile_id") < 10000).alias("inside"))


# ---- reports ----


@query("agg_diagnostics", twin("select split, count(*) as n, count(*) filter (border) as n_border, count(*) filter (mrg) as n_merge, count(*) filter (tiny) as n_tiny, avg(area_px) as mean_area, count(distinct tile_id) as n_tiles from comp group by split"))
def agg_diagnostics(spark, d):
    return split_tiles(spark, d).groupBy("split").agg(F.count("*").alias("n"), *(F.count_if(k).alias(a) for k, a in (("border", "n_border"), ("mrg", "n_merge"), ("tiny", "n_tiny"))), F.avg("area_px").alias("mean_area"), F.countDistinct("tile_id").alias("n_tiles"))


@query("agg_relation_metrics", twin("select relation, count(*) as n, avg(case when reason is null then 1.0::double else 0.0::double end) as valid_rate, avg(abs(m)) as mean_margin from dir group by relation"))
def agg_relation_metrics(spark, d):
    return R.directions(tiles(spark, d)).groupBy("relation").agg(F.count("*").alias("n"), F.avg(F.when(C("reason").isNull(), 1.0).otherwise(0.0)).alias("valid_rate"), F.avg("margin").alias("mean_margin"))


@query("agg_loss", twin("select split, cast(sum(area_px) as bigint) as before, cast(sum(case when tiny or border then 0 else area_px end) as bigint) as after, 1 - sum(case when tiny or border then 0 else area_px end) / sum(area_px) as loss from comp group by split"))
def agg_loss(spark, d):
    before, after = F.sum("area_px"), F.sum(F.when(C("tiny") | C("border"), 0).otherwise(C("area_px")))
    return split_tiles(spark, d).groupBy("split").agg(before.alias("before"), after.alias("after"), (1 - after / before).alias("loss"))


# ---- metrics ----


def _pair_metric(name, sql, column, alias):
    @query(name, twin(f"select tile_id, aid, bid, {sql} as {alias} from (select *, {_IOU_SQL} as i from pr where aid < bid)"))
    def run(spark, d):
        return both(spark, d).select(*ids(), column().alias(alias))


_pair_metric("met_centroid", "sqrt((acx - bcx) * (acx - bcx) + (acy - bcy) * (acy - bcy)) / sqrt(524288.0::double)", lambda: F.sqrt((C("a_cx") - C("b_cx")) * (C("a_cx") - C("b_cx")) + (C("a_cy") - C("b_cy")) * (C("a_cy") - C("b_cy"))) / DEFAULT.diagonal, "error")


@query("met_auprc", "select sum(tp / n * d) / sum(d) as average_precision from (select sum(pos) over w as tp, sum(n) over w as n, pos as d from (select n_chars as s, count(*) n, sum(toxic) pos from labels join documents using (doc_id) group by 1) window w as (order by s desc))")
def met_auprc(spark, d):
    by = scored(spark, d).groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    ranked = running_totals(by, [], "s", ["pos", "n"], descending=True)
    rows = ranked.select((C("before_pos") + C("pos")).alias("tp"), (C("before_n") + C("n")).alias("n"), C("pos").alias("d"))
    return rows.agg((F.sum(C("tp") / C("n") * C("d")) / F.sum("d")).alias("average_precision"))


#: Fixed value: what the comparison of texts leaves out.
IGNORED = r"""[\s\u3000,，。.、;；:：!！?？"'“”‘’()（）\[\]【】<>《》—\-_/\\|~`@#$%^&*+=]+""".replace("\\u3000", "\u3000")
_SAID = "case conv_id % 4 when 0 then '  ' || replace(text, ' ', ' - ') || ' [SEG] box' when 1 then '... [SEG]' when 2 then text || ' indeed' else text end"


def _tidy_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{IGNORED.replace(chr(39), chr(39) * 2)}', '', 'g')))"


@query("met_exact", f"select role, count(*) as n, avg(case when said <> '' and said = wanted then 1.0::double else 0.0::double end) as exact, count(*) filter (said = '') as n_empty from (select role, {_tidy_sql(f'split_part({_SAID}, chr(91) || chr(83) || chr(69) || chr(71) || chr(93), 1)')} as said, {_tidy_sql('text')} as wanted from conversations) group by role")
def met_exact(spark, d):
    """Turns whose generated text, before the marker, lower-cased and without punctuation, is the expected one and not empty; what is generated is the text, changed by the number of the conversation."""
    k, text = C("conv_id") % 4, C("text")
    said = F.when(k == 0, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit(" - ")), F.lit(" [SEG] box"))).when(k == 1, "... [SEG]").when(k == 2, F.concat(text, F.lit(" indeed"))).otherwise(text)
    tidy = lambda x: F.lower(F.trim(F.regexp_replace(x, IGNORED, "")))
    rows = table(spark, d, "conversations").select("role", tidy(F.substring_index(said, "[SEG]", 1)).alias("said"), tidy(text).alias("wanted"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.avg(F.when((C("said") != "") & (C("said") == C("wanted")), 1.0).otherwise(0.0)).alias("exact"), F.count_if(C("said") == "").alias("n_empty"))


@query("met_chain", twin("select count(*) as n, count(*) filter (s.reason is null) as n_first, count(*) filter (s.reason is null and nr.reason is null) as n_both from siz s join nr on nr.tile_id = s.tile_id and nr.anchor = s.subject where relation = 'largest'"))
def met_chain(spark, d):
    c = tiles(spark, d)
    first = R.sizes(c).where("relation = 'largest'").select("tile_id", C("subject").alias("anchor"), C("reason").isNull().alias("first"))
    rows = first.join(R.nearest(c).select("tile_id", "anchor", C("reason").isNull().alias("second")), ["tile_id", "anchor"])
    return rows.agg(F.count("*").alias("n"), F.count_if("first").alias("n_first"), F.count_if(C("first") & C("second")).alias("n_both"))


@query("met_half_plane", twin("select tile_id, aid, bid, acx < bcx as is_left, acy < bcy as is_above, bcx - acx as signed, abs(bcy - acy) as orthogonal from pr"))
def met_half_plane(spark, d):
    return both(spark, d, False).select(*ids(), (C("a_cx") < C("b_cx")).alias("is_left"), (C("a_cy") < C("b_cy")).alias("is_above"), (C("b_cx") - C("a_cx")).alias("signed"), F.abs(C("b_cy") - C("a_cy")).alias("orthogonal"))