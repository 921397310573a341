"""Audits, sampling rules, text rules and reports on samples, with planted faults where the tables have none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DIRECTIONS, PROGRAMS
from ..operators import relations as R
from ..queries import PRELUDE, query, twin
from ..sources.tables import split_of, table
from .base_queries import samples, tiles

C = F.col
SEED = str(DEFAULT.seed)


# ---- keys and duplicates ----


def semantic_key():
    """One question in canonical form: tile, program without a last step to the nearest, and answer."""
    return F.concat_ws("|", C("tile_id").cast("string"), F.regexp_replace("query_type", "_to_nearest$", ""), C("target").cast("string"))


_KEY_SQL = "tile_id || '|' || regexp_replace(query_type, '_to_nearest$', '') || '|' || target"


@query("fn_semantic_key", twin(f"select tile_id, query_type, sha256({_KEY_SQL}) as key from smp"))
def fn_semantic_key(spark, d):
    return samples(spark, d).select("tile_id", "query_type", F.sha2(semantic_key(), 256).alias("key"))


@query("fn_sha_order", twin(f"select tile_id, query_type, sha256('{SEED}|' || tile_id || '|' || level || '|' || query_type || '|' || sha256({_KEY_SQL})) as order_key from smp"))
def fn_sha_order(spark, d):
    """The order of selection: a digest over seed, tile, level, type and semantic key."""
    parts = (F.lit(SEED), C("tile_id").cast("string"), C("level").cast("string"), "query_type", F.sha2(semantic_key(), 256))
    return samples(spark, d).select("tile_id", "query_type", F.sha2(F.concat_ws("|", *parts), 256).alias("order_key"))


@query("gen_dedup", twin(f"select tile_id, query_type, level, n - 1 as n_dropped from (select *, row_number() over (partition by {_KEY_SQL} order by level, query_type) as r, count(*) over (partition by {_KEY_SQL}) as n from smp) where r = 1"))
def gen_dedup(spark, d):
    """The first question of each semantic key stays, the others are counted."""
    by = samples(spark, d).withColumn("k", semantic_key()).groupBy("tile_id", "k").agg(F.min(F.struct("level", "query_type")).alias("first"), (F.count("*") - 1).alias("n_dropped"))
    return by.select("tile_id", "first.query_type", "first.level", "n_dropped")


@query("fn_pair_hash", twin("select tile_id, sha256('[' || string_agg('\"' || query_type || ':' || target || '\"', ',' order by query_type) || ']') as pair_hash, sha256(string_agg(query_type || chr(10), '' order by query_type)) as ids_hash from smp group by tile_id"))
def fn_pair_hash(spark, d):
    """Digest of a tile's questions as an ordered JSON list, and of their names with a line feed behind each."""
    by = samples(spark, d).groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("query_type", C("target").cast("string").alias("target")))).alias("q"))
    named = F.to_json(F.transform("q", lambda s: F.concat_ws(":", s["query_type"], s["target"])))
    return by.select("tile_id", F.sha2(named, 256).alias("pair_hash"), F.sha2(F.concat(F.array_join("q.query_type", "\n"), F.lit("\n")), 256).alias("ids_hash"))


# ---- sampling ----

HEAD, TOTAL = 30, 700


@query("smp_head_fill", twin(f"select split, query_type, tile_id, f as is_fill from (select *, row_number() over (order by f, key, tile_id) as k from (select *, row_number() over (partition by query_type order by key, tile_id) > {HEAD} as f from smp where split = 'val')) where k <= {TOTAL}"))
def smp_head_fill(spark, d):
    """Of one split the first 30 of each program by key, then the rest in order of their keys up to 700.

    Heads are found by slices of the key first, so no program is ranked in one task; beyond
    the heads only as many rows as the sample has are ever ranked together.
    """
    val = samples(spark, d).where("split = 'val'").select("split", "query_type", "tile_id", "key")
    part = Window.partitionBy("query_type", F.substring("key", 64, 1)).orderBy("key", "tile_id")
    few = val.withColumn("r", F.row_number().over(part)).where(C("r") <= HEAD).drop("r")
    whole = Window.partitionBy("query_type").orderBy("key", "tile_id")
    head = few.withColumn("r", F.row_number().over(whole)).where(C("r") <= HEAD).drop("r")
    rest = val.join(head, ["query_type", "tile_id"], "left_anti").orderBy("key", "tile_id").limit(TOTAL).select(head.columns)
    both = head.withColumn("f", F.lit(False)).unionByName(rest.withColumn("f", F.lit(True)))
    return both.orderBy("f", "key", "tile_id").limit(TOTAL).select("split", "query_type", "tile_id", C("f").alias("is_fill"))


COUNT = 5000


@query("smp_diverse", twin(f"select tile_id, query_type, f > 1 as refilled from (select *, row_number() over (order by f > 1, key, tile_id, query_type) k from (select *, row_number() over (partition by tile_id order by key, query_type) f from smp where split = 'val')) where k <= {COUNT}"))
def smp_diverse(spark, d):
    """The first question of each tile by key, then any others by key until there are 5000."""
    first = Window.partitionBy("tile_id").orderBy("key", "query_type")
    rows = samples(spark, d).where("split = 'val'").withColumn("refilled", F.row_number().over(first) > 1)
    return rows.orderBy("refilled", "key", "tile_id", "query_type").limit(COUNT).select("tile_id", "query_type", "refilled")


@query("smp_unique_key", twin("select tile_id, reference, n, key, case when key < '8' then 'a' else 'b' end as part from (select tile_id, reference, count(*) as n, sha256(tile_id || ':' || reference) as key from smp where reference is not null group by 1, 2)"))
def smp_unique_key(spark, d):
    """One row for each reference of a tile, with its place in the order of digests, which splits them in two."""
    rows = samples(spark, d).where("reference is not null").groupBy("tile_id", "reference").agg(F.count("*").alias("n"))
    key = F.sha2(F.concat_ws(":", C("tile_id").cast("string"), C("reference").cast("string")), 256)
    return rows.withColumn("key", key).withColumn("part", F.when(C("key") < "8", "a").otherwise("b"))


@query("smp_paired", twin("select tile_id, la as left_id, ra as right_id from (select *, row_number() over (partition by tile_id order by same_type, not nt, same_level, la, ra) as k from (select a.tile_id, a.level || '-' || a.query_type as la, b.level || '-' || b.query_type as ra, a.query_type = b.query_type as same_type, (a.level = 3 and not a.trivial) or (b.level = 3 and not b.trivial) as nt, a.level = b.level as same_level from smp a join smp b on a.tile_id = b.tile_id and a.target < b.target)) where k = 1"))
def smp_paired(spark, d):
    """The best pair of questions of each tile with different answers: other types first, then a real third level, other levels, least ids."""
    side = lambda k: samples(spark, d).select("tile_id", C("target").alias(f"t{k}"), F.concat_ws("-", C("level").cast("string"), "query_type").alias(f"id{k}"), C("query_type").alias(f"q{k}"), C("level").alias(f"l{k}"), ((C("level") == 3) & ~C("trivial")).alias(f"n{k}"))
    both = side("a").join(side("b"), "tile_id").where("ta < tb")
    order = F.struct(C("qa") == C("qb"), ~(C("na") | C("nb")), C("la") == C("lb"), "ida", "idb")
    return both.groupBy("tile_id").agg(F.min_by(F.struct("ida", "idb"), order).alias("p")).select("tile_id", C("p.ida").alias("left_id"), C("p.idb").alias("right_id"))


IMAGES = 10


def overfit_set(questions, images: int = IMAGES):
    """Two questions with different answers for each of ``images`` tiles, so that every level is covered as far as there are tiles for it.

    A tile offers its best pair: one with a real third level first, then of different types, then least ids. Tiles are in a bucket by the
    highest level of their pair; a third of the images comes from each, level 1 takes what is left, and a bucket that is short
    is topped up from the others, highest first. Pairs whose third level is trivial are in no bucket. No bucket gives more than ``images`` tiles, so the first ones of each, by number, decide.
    """
    item = F.struct("target", F.concat_ws("-", C("level").cast("string"), "query_type").alias("sample"), "level", "query_type", ((C("level") == 3) & ~C("trivial")).alias("real"))
    order = lambda a, b: F.struct((~(a["real"] | b["real"])).alias("k1"), (a["query_type"] == b["query_type"]).alias("k2"), a["sample"].alias("k3"), b["sample"].alias("k4"), a.alias("a"), b.alias("b"))
    pairs = F.flatten(F.transform("items", lambda a: F.transform(F.filter("items", lambda b: a["target"] < b["target"]), lambda b: order(a, b))))
    # a tile has as many questions as its quotas allow
    best = questions.groupBy("tile_id").agg(F.collect_list(item).alias("items")).select("tile_id", F.array_min(pairs).alias("p")).where("p is not null")
    top = F.greatest("p.a.level", "p.b.level")
    rows = best.withColumn("bucket", F.when(~C("p.k1"), 3).when(top < 3, top)).where("bucket is not null")
    some = rows.withColumn("k", F.row_number().over(Window.partitionBy("bucket", F.pmod("tile_id", F.lit(64))).orderBy("tile_id"))).where(C("k") <= images)
    head = some.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("tile_id"))).where(C("k") <= images)
    third = max(1, images // 3)
    quota = F.when(C("bucket") == 1, images - 2 * third).otherwise(third)
    few = head.withColumn("topped_up", C("k") > quota)
    # at most three times ``images`` rows
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("topped_up", F.desc("bucket"), "k"))).where(C("place") <= images)
    return chosen.select("place", "tile_id", "bucket", "topped_up", F.explode(F.array_sort(F.array(*(F.struct(C(f"p.{k}.sample").alias("sample"), *(C(f"p.{k}.{n}").alias(n) for n in ("level", "query_type", "target"))) for k in "ab")))).alias("q")).select("place", "tile_id", "bucket", "topped_up", "q.sample", "q.level", "q.query_type", "q.target")


@query("smp_overfit", twin("""
select cast(place as int) as place, tile_id, bucket, topped_up, unnest([la, ra]) as sample, unnest([al, bl]) as level, unnest([aq, bq]) as query_type, unnest([at_, bt]) as target
from (select *, row_number() over (order by topped_up, bucket desc, rk) as place
      from (select *, rk > case bucket when 1 then 4 else 3 end as topped_up
            from (select *, row_number() over (partition by bucket order by tile_id) as rk
                  from (select *, case when nt then 3 when greatest(al, bl) < 3 then greatest(al, bl) end as bucket
                        from (select *, row_number() over (partition by tile_id order by not nt, aq = bq, la, ra) as k
                              from (select a.tile_id, a.level || '-' || a.query_type as la, b.level || '-' || b.query_type as ra, a.level as al, b.level as bl, a.query_type as aq, b.query_type as bq, a.target as at_, b.target as bt,
                                           (a.level = 3 and not a.trivial) or (b.level = 3 and not b.trivial) as nt
                                    from smp a join smp b on a.tile_id = b.tile_id and a.target < b.target where a.split = 'train' and b.split = 'train')) where k = 1)
                  where bucket is not null)))
where place <= 10"""))
def smp_overfit(spark, d):
    """Ten tiles of the training split with two questions each, all levels covered."""
    return overfit_set(samples(spark, d).where("split = 'train'"))


# ---- records with planted faults ----

_BROKEN = "(select tile_id, split, level, query_type, trivial, case when tile_id % 19 = 0 and level > 1 then null when tile_id % 29 = 0 and level = 1 then 1 when tile_id % 23 = 0 and level > 1 then target else reference end as reference, case when tile_id % 17 = 0 then 99 else target end as target, case when tile_id % 31 = 0 then level + 1 else level end as n_steps from smp)"


def stored(spark, d):
    """Samples as stored records, some of them wrong by the number of their tile."""
    t, deep = C("tile_id"), C("level") > 1
    reference = F.when((t % 19 == 0) & deep, F.lit(None)).when((t % 29 == 0) & ~deep, 1).when((t % 23 == 0) & deep, C("target")).otherwise(C("reference"))
    return samples(spark, d).select("tile_id", "split", "level", "query_type", "trivial", reference.alias("reference"), F.when(t % 17 == 0, 99).otherwise(C("target")).alias("target"), (C("level") + (t % 31 == 0).cast("int")).alias("n_steps"))


CODES = ("target_missing_component", "target_mask_empty", "program_length_mismatch", "level1_has_reference", "missing_reference", "reference_missing", "reference_equals_target", "target_not_eligible", "level3_not_last_nearest", "type_repeated", "too_many_of_level", "split_mismatch", "program_unknown")
BLOCKING = ("target_missing_component", "reference_missing", "type_repeated")
_CODES_SQL = """(select r.*, unnest(list_filter([
  case when t.component_id is null then 'target_missing_component' end, case when t.area_px = 0 then 'target_mask_empty' end,
  case when n_steps <> len(string_split(query_type, '_to_')) then 'program_length_mismatch' end, case when level = 1 and reference is not null then 'level1_has_reference' end,
  case when level > 1 and reference is null then 'missing_reference' end, case when reference is not null and f.component_id is null then 'reference_missing' end,
  case when level > 1 and reference = target then 'reference_equals_target' end, case when level > 1 and query_type like '%_to_nearest' and (t.border or t.mrg or t.tiny) then 'target_not_eligible' end,
  case when level = 3 and query_type not like '%_to_nearest' then 'level3_not_last_nearest' end, case when count(*) over (partition by r.tile_id, query_type) > 1 then 'type_repeated' end,
  case when count(*) over (partition by r.tile_id, level) > case level when 1 then 6 when 2 then 4 else 2 end then 'too_many_of_level' end,
  case when r.split <> case r.tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end then 'split_mismatch' end,
  case when not list_contains([{programs}], query_type) then 'program_unknown' end], lambda x: x is not null)) as code
  from {rows} r left join comp t on t.tile_id = r.tile_id and t.component_id = r.target left join comp f on f.tile_id = r.tile_id and f.component_id = r.reference)"""
_ISSUES_SQL = _CODES_SQL.format(rows=_BROKEN, programs=", ".join(f"'{p}'" for p in PROGRAMS))


def judged(spark, d):
    """Stored records with the codes that they offend."""
    c = tiles(spark, d).select("tile_id", "component_id", "area_px", "border", "mrg", "tiny")
    of = lambda k: c.select("tile_id", *(C(x).alias(f"{k}_{x}" if x != "component_id" else k) for x in c.columns[1:]), F.lit(True).alias(f"{k}_known"))
    rows = stored(spark, d).join(of("target"), ["tile_id", "target"], "left").join(of("reference"), ["tile_id", "reference"], "left")
    n_type, n_level = (F.count("*").over(Window.partitionBy("tile_id", k)) for k in ("query_type", "level"))
    rows = rows.withColumns({"n_type": n_type, "n_level": n_level})
    most = F.coalesce(*(F.when(C("level") == k, F.lit(v)) for k, v in DEFAULT.quotas.items()))
    deep, last = C("level") > 1, C("query_type").endswith("_to_nearest")
    tests = (
        C("target_known").isNull(),
        C("target_area_px") == 0,
        C("n_steps") != F.size(F.split("query_type", "_to_")),
        ~deep & C("reference").isNotNull(),
        deep & C("reference").isNull(),
        C("reference").isNotNull() & C("reference_known").isNull(),
        deep & (C("reference") == C("target")),
        deep & last & (C("target_border") | C("target_mrg") | C("target_tiny")),
        (C("level") == 3) & ~last,
        C("n_type") > 1,
        C("n_level") > most,
        C("split") != split_of(),
        ~C("query_type").isin(*PROGRAMS),
    )
    found = F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in zip(tests, CODES, strict=True))))
    return rows.select("tile_id", "split", "level", "query_type", "reference", "target", "trivial", found.alias("codes"))


def issues(spark, d):
    """One row for each code that a stored record offends."""
    return judged(spark, d).select("tile_id", "split", "level", "query_type", "reference", "target", F.explode("codes").alias("code"))


_BLOCKING_SQL = ", ".join(f"'{c}'" for c in BLOCKING)


@query("val_report", twin(f"""
select *, case when n_blocking + n_duplicate_keys > 0 then 'FAIL_REQUIRES_REVISION' when n_issues > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as verdict
from (select split, count(*) as n_records, count(distinct tile_id) as n_tiles, count(*) filter (level = 1) as n_level1, count(*) filter (level = 2) as n_level2, count(*) filter (level = 3) as n_level3, count(*) filter (trivial) as n_trivial from {_BROKEN} group by split)
join (select split, count(*) filter (n > 1) as n_duplicate_keys from (select split, count(*) as n from {_BROKEN} group by split, tile_id, regexp_replace(query_type, '_to_nearest$', ''), target) group by split) using (split)
left join (select split, count(*) as n_issues, count(*) filter (code in ({_BLOCKING_SQL})) as n_blocking, count(distinct (tile_id, query_type)) as n_flagged from {_ISSUES_SQL} group by split) using (split)"""))
def val_report(spark, d):
    """The whole audit by split: records by level, codes, keys of tile, canonical program and answer that occur repeatedly, and a verdict. All windows share the tile's exchange."""
    key = Window.partitionBy("tile_id", F.regexp_replace("query_type", "_to_nearest$", ""), "target").orderBy("level", "query_type")
    rows = judged(spark, d).withColumn("second", F.row_number().over(key) == 2)
    blocking = F.size(F.filter("codes", lambda c: c.isin(*BLOCKING)))
    counts = rows.groupBy("split").agg(
        F.count("*").alias("n_records"),
        F.countDistinct("tile_id").alias("n_tiles"),
        *(F.count_if(C("level") == k).alias(f"n_level{k}") for k in (1, 2, 3)),
        F.count_if("trivial").alias("n_trivial"),
        F.sum(F.size("codes")).alias("n_issues"),
        F.count_if(F.size("codes") > 0).alias("n_flagged"),
        F.sum(blocking).alias("n_blocking"),
        F.count_if("second").alias("n_duplicate_keys"),
    )
    verdict = F.when(C("n_blocking") + C("n_duplicate_keys") > 0, "FAIL_REQUIRES_REVISION").when(C("n_issues") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return counts.withColumn("verdict", verdict)


@query("val_record", twin(f"select split, code, count(*) as n, count(distinct tile_id) as n_tiles from {_ISSUES_SQL} group by split, code"))
def val_record(spark, d):
    return issues(spark, d).groupBy("split", "code").agg(F.count("*").alias("n"), F.countDistinct("tile_id").alias("n_tiles"))


EXAMPLES = 40


@query("val_examples", twin(f"select code, count(*) as n, string_agg(tile_id || '/' || query_type, ',' order by tile_id, query_type) filter (r <= {EXAMPLES}) as examples from (select *, row_number() over (partition by code order by tile_id, query_type) as r from {_ISSUES_SQL}) group by code"))
def val_examples(spark, d):
    """Counts of each code with 40 examples; ranks are found by slices of tiles first, so no code is gathered whole."""
    rows = issues(spark, d)
    part = Window.partitionBy("code", F.pmod("tile_id", F.lit(64))).orderBy("tile_id", "query_type")
    few = rows.withColumn("r", F.row_number().over(part)).where(C("r") <= EXAMPLES).groupBy("code").agg(F.slice(F.array_sort(F.collect_list(F.struct("tile_id", "query_type"))), 1, EXAMPLES).alias("x"))
    names = F.array_join(F.transform("x", lambda e: F.concat_ws("/", e["tile_id"].cast("string"), e["query_type"])), ",")
    return rows.groupBy("code").agg(F.count("*").alias("n")).join(few, "code").select("code", "n", names.alias("examples"))


_BLOCKING_SQL = "(" + ", ".join(f"'{c}'" for c in BLOCKING) + ")"


@query("val_verdict", twin(f"select part, case when n_blocking > 0 then 'FAIL_REQUIRES_REVISION' when n > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as verdict, n from (select s.part, count(i.code) as n, count(*) filter (i.code in {_BLOCKING_SQL}) as n_blocking from (select distinct tile_id, tile_id % 97 as part from smp) s left join {_ISSUES_SQL} i on i.tile_id = s.tile_id group by s.part)"))
def val_verdict(spark, d):
    """The verdict on each of 97 parts of the tiles: the severest code that occurs decides."""
    parts = samples(spark, d).select("tile_id").distinct().withColumn("part", C("tile_id") % 97)
    severity = F.when(C("code").isin(*BLOCKING), 2).when(C("code").isNotNull(), 1).otherwise(0)
    by = parts.join(issues(spark, d).select("tile_id", "code"), "tile_id", "left").groupBy("part").agg(F.max(severity).alias("s"), F.count("code").alias("n"))
    return by.select("part", F.when(C("s") == 2, "FAIL_REQUIRES_REVISION").when(C("s") == 1, "PASS_WITH_WARNINGS").otherwise("PASS").alias("verdict"), "n")


@query("val_native", twin(f"select r.tile_id, query_type, case when t.component_id is null then 'target_unknown' when reference is not null and f.component_id is null then 'reference_unknown' when reference = target then 'reference_is_target' end as problem from {_BROKEN} r left join comp t on t.tile_id = r.tile_id and t.component_id = r.target left join comp f on f.tile_id = r.tile_id and f.component_id = r.reference where t.component_id is null or (reference is not null and f.component_id is null) or reference = target"))
def val_native(spark, d):
    """Stored records whose target or reference is no component of their tile, or is one and the same."""
    c = tiles(spark, d).select("tile_id", "component_id")
    of = lambda k: c.select("tile_id", C("component_id").alias(k), F.lit(True).alias(f"{k}_known"))
    rows = stored(spark, d).join(of("target"), ["tile_id", "target"], "left").join(of("reference"), ["tile_id", "reference"], "left")
    problem = F.when(C("target_known").isNull(), "target_unknown").when(C("reference").isNotNull() & C("reference_known").isNull(), "reference_unknown").when(C("reference") == C("target"), "reference_is_target")
    return rows.select("tile_id", "query_type", problem.alias("problem")).where("problem is not null")


@query("join_enrich", twin("select s.tile_id, query_type, t.area_px as target_area, t.border as target_border, f.area_px as reference_area, f.x0 as reference_x0 from smp s left join comp t on t.tile_id = s.tile_id and t.component_id = s.target left join comp f on f.tile_id = s.tile_id and f.component_id = s.reference"))
def join_enrich(spark, d):
    """Samples with what the instance table says of their target and their reference."""
    c = tiles(spark, d)
    target = c.select("tile_id", C("component_id").alias("target"), C("area_px").alias("target_area"), C("border").alias("target_border"))
    reference = c.select("tile_id", C("component_id").alias("reference"), C("area_px").alias("reference_area"), C("x0").alias("reference_x0"))
    rows = samples(spark, d).join(target, ["tile_id", "target"], "left").join(reference, ["tile_id", "reference"], "left")
    return rows.select("tile_id", "query_type", "target_area", "target_border", "reference_area", "reference_x0")


@query("join_pair_lookup", twin("select p.tile_id, a.target as target_a, b.target as target_b, a.level as level_a, b.level as level_b, count(*) over (partition by p.tile_id, p.ia) as n_uses from (select tile_id, min(query_type) as ia, max(query_type) as ib from smp group by tile_id having count(*) > 1) p join smp a on a.tile_id = p.tile_id and a.query_type = p.ia join smp b on b.tile_id = p.tile_id and b.query_type = p.ib"))
def join_pair_lookup(spark, d):
    """Pairs given by the names of two questions, looked up in the samples, and how often each name is used."""
    s = samples(spark, d)
    given = s.groupBy("tile_id").agg(F.min("query_type").alias("ia"), F.max("query_type").alias("ib"), F.count("*").alias("n")).where("n > 1")
    of = lambda k: s.select("tile_id", C("query_type").alias(f"i{k}"), C("target").alias(f"target_{k}"), C("level").alias(f"level_{k}"))
    rows = given.join(of("a"), ["tile_id", "ia"]).join(of("b"), ["tile_id", "ib"])
    uses = F.count("*").over(Window.partitionBy("tile_id", "ia"))
    return rows.select("tile_id", "target_a", "target_b", "level_a", "level_b", uses.alias("n_uses"))


# ---- raw and converted components ----

KEPT = ("leftmost", "rightmost", "largest", "smallest")
_CONV_SQL = """,
conv0 as (select *, case when tile_id % 3 = 0 then x1 - w // 10 else x1 end as nx1 from comp where not tiny and component_id % 9 <> 8),
conv as (select tile_id, component_id as raw_id, row_number() over (partition by tile_id order by component_id) as cid, x0, y0, nx1 as x1, y1, nx1 - x0 + 1 as w, h, (nx1 - x0 + 1) * h as area, x0 + (nx1 - x0) / 2.0::double as cx,
                x0 = 0 or y0 = 0 or nx1 = 511 or y1 = 511 as border, cast((nx1 - x0 + 1) * h as double) / 262144.0::double > 0.20 as mrg, (nx1 - x0 + 1) * h < 150 as tiny, cast((nx1 - x0 + 1) * h as double) / area_px as iou from conv0),
cext_r as (select tile_id, relation, cid, v, row_number() over w r, lead(v) over w v2, count(*) over (partition by tile_id, relation) n from (select tile_id, cid, unnest(['leftmost', 'rightmost']) relation, cx v, unnest([1, -1]) sgn from conv) window w as (partition by tile_id, relation order by sgn * v, sgn * cid)),
csiz_r as (select tile_id, relation, cid, v, row_number() over w r, lead(v) over w v2, count(*) over (partition by tile_id, relation) n from (select * from (select tile_id, cid, unnest(['largest', 'smallest']) relation, area v, unnest([-1, 1]) sgn, unnest([not border and not mrg, not border and not mrg and not tiny]) ok from conv) where ok) window w as (partition by tile_id, relation order by sgn * v, sgn * cid)),
cwin as (select tile_id, relation, cid from cext_r where r = 1 and n > 1 and abs(v2 - v) >= 4 union all select tile_id, relation, cid from csiz_r where r = 1 and n > 1 and greatest(v, v2) / greatest(least(v, v2), 1) >= 1.10::double),
rwin as (select tile_id, relation, subject from ext where reason is null and relation in ('leftmost', 'rightmost') union all select tile_id, relation, subject from siz where reason is null),
drift as (
  select t.tile_id, t.relation, r.subject, c.cid, m.cid as mapped, m.iou, k.area_px, k.border as rb, m.border as cb, back.raw_id
  from (select distinct tile_id, relation from comp, (values ('leftmost'), ('rightmost'), ('largest'), ('smallest')) v(relation)) t
  left join rwin r on r.tile_id = t.tile_id and r.relation = t.relation left join cwin c on c.tile_id = t.tile_id and c.relation = t.relation
  left join conv m on m.tile_id = t.tile_id and m.raw_id = r.subject left join comp k on k.tile_id = t.tile_id and k.component_id = r.subject left join conv back on back.tile_id = t.tile_id and back.cid = c.cid)
"""
_ATTRIBUTE = "case when subject is not null and mapped is null or area_px < 150 then 'small_component_removed' when mapped is not null and rb <> cb then 'border_eligibility_changed' when relation in ('largest', 'smallest') then 'ranking_changed' else 'polygon_geometry_changed' end"


def converted(components):
    """Components after a conversion that drops some, narrows others and numbers the rest anew; raw_id and iou tell what became of each."""
    rows = components.where(~C("tiny") & (C("component_id") % 9 != 8))
    rows = rows.withColumn("raw_id", C("component_id")).withColumn("raw_area", C("area_px"))
    rows = rows.withColumn("x1", F.when(C("tile_id") % 3 == 0, C("x1") - F.floor(C("w") / 10)).otherwise(C("x1")).cast("int")).withColumn("w", C("x1") - C("x0") + 1)
    rows = rows.withColumns({"area_px": C("w") * C("h"), "cx": C("x0") + (C("x1") - C("x0")) / 2, "border": (C("x0") == 0) | (C("y0") == 0) | (C("x1") == DEFAULT.width - 1) | (C("y1") == DEFAULT.height - 1)})
    rows = rows.withColumns({"mrg": C("area_px") / float(DEFAULT.width * DEFAULT.height) > DEFAULT.merge_extent, "tiny": C("area_px") < DEFAULT.tiny_area, "iou": C("area_px") / C("raw_area")})
    return rows.withColumn("component_id", F.row_number().over(Window.partitionBy("tile_id").orderBy("raw_id")))


@query("join_drift_status", PRELUDE.rstrip() + _CONV_SQL + f"select tile_id, relation, case when subject is not null and cid is not null then case when mapped = cid and iou >= 0.5 then 'target_unchanged' else 'target_changed' end when subject is not null then 'became_invalid' when cid is not null then 'became_newly_valid' else 'invalid_in_both' end as status, case when (subject is null and cid is null) or coalesce(mapped = cid and iou >= 0.5, false) then null else {_ATTRIBUTE} end as attribution from drift")
def join_drift_status(spark, d):
    """What becomes of each program's answer when components are converted, and the first of the flags that explain a change."""
    c = tiles(spark, d)
    new = converted(c)

    def won(rows, name):
        found = R.extremes(rows).unionByName(R.sizes(rows)).where(C("reason").isNull() & C("relation").isin(*KEPT))
        return found.select("tile_id", "relation", C("subject").alias(name))

    mapped = new.select("tile_id", C("raw_id").alias("raw"), C("component_id").alias("mapped"), "iou", C("border").alias("new_border"))
    known = c.select("tile_id", C("component_id").alias("raw"), C("area_px").alias("raw_area"), C("border").alias("raw_border"))
    every = c.select("tile_id").distinct().withColumn("relation", F.explode(F.array(*map(F.lit, KEPT))))
    rows = every.join(won(c, "raw"), ["tile_id", "relation"], "left").join(won(new, "now"), ["tile_id", "relation"], "left").join(mapped, ["tile_id", "raw"], "left").join(known, ["tile_id", "raw"], "left")
    same = F.coalesce((C("mapped") == C("now")) & (C("iou") >= 0.5), F.lit(False))
    had, has = C("raw").isNotNull(), C("now").isNotNull()
    status = F.when(had & has, F.when(same, "target_unchanged").otherwise("target_changed")).when(had, "became_invalid").when(has, "became_newly_valid").otherwise("invalid_in_both")
    small = (had & C("mapped").isNull()) | F.coalesce(C("raw_area") < DEFAULT.tiny_area, F.lit(False))
    why = F.when(small, "small_component_removed").when(C("raw_border") != C("new_border"), "border_eligibility_changed").when(C("relation").isin("largest", "smallest"), "ranking_changed").otherwise("polygon_geometry_changed")
    return rows.select("tile_id", "relation", status.alias("status"), F.when(~same & (had | has), why).alias("attribution"))


# ---- prompts and text ----

#: Punctuation that counts as its ASCII form when prompts are compared.
WIDE, NARROW = "，。？！、：；（）“”’", ",.?!,:;()\"\"'"


def normal_prompt(text):
    return F.regexp_replace(F.translate(F.regexp_replace(F.lower(F.trim(text)), r"[\s\x{3000}]+", ""), WIDE, NARROW), "[.,!?;:]+$", "")


_NARROW_SQL = NARROW.replace("'", "''")


def normal_sql(text: str) -> str:
    return f"regexp_replace(translate(regexp_replace(lower(trim({text})), '[\\s\\x{{3000}}]+', '', 'g'), '{WIDE}', '{_NARROW_SQL}'), '[.,!?;:]+$', '')"


@query("str_normalize", f"select conv_id, turn, {normal_sql('text')} as normal from conversations")
def str_normalize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", normal_prompt("text").alias("normal"))


@query("str_normalize_nfkc")
def str_normalize_nfkc(spark, d):
    """Compatibility forms, without punctuation, in lower case; no built-in function composes them."""

    @F.pandas_udf("string")
    def normal(text: pd.Series) -> pd.Series:
        forms = text.fillna("").map(lambda t: unicodedata.normalize("NFKC", t))
        return forms.str.replace(r"[^\w\s]", "", regex=True).str.strip().str.lower()

    return table(spark, d, "conversations").select("conv_id", "turn", normal("text").alias("normal"))


@query("val_collisions", f"with g as (select distinct text from conversations where conv_id % 10 = 0), n as (select distinct {normal_sql('text')} as t from g) select conv_id, turn from conversations where conv_id % 10 <> 0 and text is not null and text not in (select text from g where text is not null) and {normal_sql('text')} not in (select t from n where t is not null)")
def val_collisions(spark, d):
    """Turns that no turn of the held-out conversations equals, as written or normalised."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    held = rows.where("conv_id % 10 = 0").select("text")
    kept = rows.where("conv_id % 10 != 0 and text is not null").join(held.distinct(), "text", "left_anti")
    return kept.withColumn("t", normal_prompt("text")).join(held.select(normal_prompt("text").alias("t")).distinct(), "t", "left_anti").select("conv_id", "turn")


#: Words that name a direction in a prompt.
DIRECTION_WORDS = {"left_of": ("left of", "left side"), "right_of": ("right of", "right side"), "above": ("above", "upper"), "below": ("below", "under")}
_PROMPT_SQL = "case query_type when 'leftmost' then 'find one' else case when tile_id % 41 = 0 then 'go there' else replace(query_type, '_', ' ') end end"


def prompts(spark, d):
    """The prompt of each sample: its program in words, some of them saying too little."""
    words = F.when(C("query_type") == "leftmost", "find one").when(C("tile_id") % 41 == 0, "go there").otherwise(F.replace("query_type", F.lit("_"), F.lit(" ")))
    return samples(spark, d).select("tile_id", "query_type", words.alias("prompt"))


_MISSING_SQL = " or ".join(f"(regexp_matches(query_type, '_to_{k}(_to_nearest)?$') and not (" + " or ".join(f"contains(prompt, '{w}')" for w in v) + "))" for k, v in DIRECTION_WORDS.items())


@query("val_prompt_pack", twin(f"select prompt, count(*) as n, count(distinct query_type) as n_programs, count(*) filter ({_MISSING_SQL}) as n_without_direction from (select query_type, {_PROMPT_SQL} as prompt from smp) group by prompt"))
def val_prompt_pack(spark, d):
    """Whether each prompt stands for one program, and whether programs with a direction have a word for it."""
    missing = F.lit(False)
    for k, words in DIRECTION_WORDS.items():
        said = F.lit(False)
        for w in words:
            said = said | F.contains("prompt", F.lit(w))
        missing = missing | (C("query_type").rlike(f"_to_{k}(_to_nearest)?$") & ~said)
    return prompts(spark, d).groupBy("prompt").agg(F.count("*").alias("n"), F.size(F.collect_set("query_type")).alias("n_programs"), F.count_if(missing).alias("n_without_direction"))


#: A template in two languages for each direction.
TEMPLATES = {"left_of": ("component {a} is left of component {b}", "组件{a}在组件{b}左侧"), "right_of": ("component {a} is right of component {b}", "组件{a}在组件{b}右侧"), "above": ("component {a} is above component {b}", "组件{a}在组件{b}上方"), "below": ("component {a} is below component {b}", "组件{a}在组件{b}下方")}


def _pattern(template: str) -> str:
    return "^" + template.replace("{a}", "[0-9]+").replace("{b}", "[0-9]+") + "$"


def _match_sql(col: str, k: int) -> str:
    return "case " + " ".join(f"when regexp_matches({col}, '{_pattern(t[k])}') then '{r}'" for r, t in TEMPLATES.items()) + " end"


def _render_sql(k: int, relation: str) -> str:
    parts = {r: "'" + t[k].replace("{a}", "' || aid || '").replace("{b}", "' || bid || '") + "'" for r, t in TEMPLATES.items()}
    return f"case {relation} " + " ".join(f"when '{r}' then {p}" for r, p in parts.items()) + " end"


@query("val_template", twin(f"select stored, en, zh, en = zh and en = stored as matches, count(*) as n from (select relation as stored, {_match_sql('e', 0)} as en, {_match_sql('z', 1)} as zh from (select relation, {_render_sql(0, 'relation')} as e, {_render_sql(1, 'shown')} as z from (select *, case when tile_id % 11 = 0 then 'above' else relation end as shown from dir where reason is null))) group by all"))
def val_template(spark, d):
    """Which template the English and the Chinese sentence of each valid direction were made from, read back from the sentences."""
    rows = R.directions(tiles(spark, d)).where("status = 'valid'").withColumn("shown", F.when(C("tile_id") % 11 == 0, "above").otherwise(C("relation")))

    def rendered(k, relation):
        made = {r: F.format_string(t[k].replace("{a}", "%1$d").replace("{b}", "%2$d"), "subject", "object") for r, t in TEMPLATES.items()}
        return F.coalesce(*(F.when(C(relation) == r, v) for r, v in made.items()))

    rows = rows.select(C("relation").alias("stored"), rendered(0, "relation").alias("e"), rendered(1, "shown").alias("z"))
    match = lambda c, k: F.coalesce(*(F.when(C(c).rlike(_pattern(t[k])), F.lit(r)) for r, t in TEMPLATES.items()))
    rows = rows.select("stored", match("e", 0).alias("en"), match("z", 1).alias("zh"))
    return rows.groupBy("stored", "en", "zh", ((C("en") == C("zh")) & (C("en") == C("stored"))).alias("matches")).agg(F.count("*").alias("n"))


@query("str_fact_parse", "with b as (select n_nationkey, 'name: \"' || n_name || '\"' || chr(10) || '# a remark' || chr(10) || 'region: ' || n_regionkey || chr(10) || case when n_nationkey % 3 = 0 then 'no fact here' || chr(10) else '' end || 'shift : -' || n_nationkey || chr(10) || chr(10) || 'note: ''a: b''' as block from nation), l as (select n_nationkey, unnest(range(1, len(string_split(block, chr(10))) + 1)) as line, trim(string_split(block, chr(10))[unnest(range(1, len(string_split(block, chr(10))) + 1))]) as s from b), p as (select n_nationkey, line, s, strpos(s, ':') as c from l where s <> '' and not starts_with(s, '#')) select n_nationkey, line, case when c > 0 then trim(substr(s, 1, c - 1)) end as fact, case when c > 0 then regexp_replace(trim(substr(s, c + 1)), '^([\"''])(.*)([\"''])$', '\\2') end as value, case when c > 0 then try_cast(case when regexp_matches(trim(substr(s, c + 1)), '^-*[0-9]+$') then trim(substr(s, c + 1)) end as bigint) end as number, c = 0 as unparsable from p")
def str_fact_parse(spark, d):
    """Lines of ``key: value`` with quotes, whole numbers, remarks and lines that are no fact."""
    n = C("n_nationkey").cast("string")
    odd = F.when(C("n_nationkey") % 3 == 0, "no fact here\n").otherwise("")
    block = F.concat(F.lit('name: "'), "n_name", F.lit('"\n# a remark\nregion: '), C("n_regionkey").cast("string"), F.lit("\n"), odd, F.lit("shift : -"), n, F.lit("\n\nnote: 'a: b'"))
    lines = table(spark, d, "nation").select("n_nationkey", F.posexplode(F.split(block, "\n")).alias("line", "s")).withColumn("s", F.trim("s")).where("s != '' and s not like '#%'")
    key, raw = F.trim(F.regexp_extract("s", "^([^:]*):", 1)), F.trim(F.regexp_extract("s", "^[^:]*:(.*)$", 1))
    fact = C("s").contains(":")
    value = F.regexp_replace(raw, "^([\"'])(.*)([\"'])$", "$2")
    number = F.when(raw.rlike("^-*[0-9]+$"), raw).try_cast("long")
    return lines.select("n_nationkey", (C("line") + 1).alias("line"), F.when(fact, key).alias("fact"), F.when(fact, value).alias("value"), F.when(fact, number).alias("number"), (~fact).alias("unparsable"))


# ---- consistency ----


@query("val_consistency", "with said as (select o_orderstatus || ':' || case o_orderkey % 5 when 0 then 'test' when 1 then 'val' else 'train' end as fact, count(*) as n from orders group by 1 union all select 'licence:x', 1), seen as (select o_orderstatus || ':' || case o_orderkey % 5 when 0 then 'test' when 1 then 'val' else 'train' end as fact, count(distinct l_orderkey) as n from orders join lineitem on l_orderkey = o_orderkey group by 1 union all select 'lines', count(*) from lineitem) select coalesce(a.fact, b.fact) as fact, a.n as declared, b.n as measured, case when b.n is null then 'not_measured' when a.n is null then 'not_declared' when a.n = b.n then 'equal' else 'different' end as status from said a full join seen b on a.fact = b.fact")
def val_consistency(spark, d):
    """Declared facts against measured ones."""
    orders = table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", "o_orderstatus", split_of("o_orderkey")).alias("fact"))
    lines = table(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"))
    said = orders.groupBy("fact").agg(F.count("*").alias("declared")).unionByName(spark.createDataFrame([("licence:x", 1)], "fact string, declared long"))
    seen = orders.join(lines.distinct(), "o_orderkey").groupBy("fact").agg(F.count("*").alias("measured")).unionByName(lines.agg(F.count("*").alias("measured")).withColumn("fact", F.lit("lines")))
    status = F.when(C("measured").isNull(), "not_measured").when(C("declared").isNull(), "not_declared").when(C("declared") == C("measured"), "equal").otherwise("different")
    return said.join(seen, "fact", "full").withColumn("status", status)


@query("val_hash", "with now as (select doc_id, case when doc_id % 50 = 0 then coalesce(text, '') || '.' else coalesce(text, '') end as t from documents where doc_id % 70 <> 1) select case when n.doc_id is null then 'missing' when sha256(coalesce(d.text, '')) = sha256(n.t) then 'unchanged' else 'changed' end as status, count(*) as n from documents d left join now n on n.doc_id = d.doc_id where d.doc_id is not null group by 1")
def val_hash(spark, d):
    """Digests of texts as frozen against those of a later copy, in which some are changed or gone."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    frozen = docs.select("doc_id", F.sha2("t", 256).alias("frozen"))
    later = docs.where("doc_id % 70 != 1").select("doc_id", F.sha2(F.when(C("doc_id") % 50 == 0, F.concat("t", F.lit("."))).otherwise(C("t")), 256).alias("now"))
    status = F.when(C("now").isNull(), "missing").when(C("now") == C("frozen"), "unchanged").otherwise("changed")
    return frozen.join(later, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("val_determinism", twin("select cast(0 as bigint) as n_differences, count(*) as n, cast(sum(tile_id * 31 + subject * case relation when 'largest' then 7 else 11 end) as bigint) as checksum from siz"))
def val_determinism(spark, d):
    """The same answers from the table as it is and dealt out anew, and a checksum that the twin computes by itself."""
    a, b = (R.sizes(t).select("tile_id", "relation", "subject", "reason", "score") for t in (tiles(spark, d), tiles(spark, d).repartition(7, "component_id")))
    sums = a.agg(F.count("*").alias("n"), F.sum(C("tile_id") * 31 + C("subject") * F.when(C("relation") == "largest", 7).otherwise(11)).alias("checksum"))
    off = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_differences"))
    return off.join(F.broadcast(sums))  # one row each


# ---- generated sequences ----

BOX, END = 1000, 1001
_SEQ_SQL = "(select tile_id, [b0, b1, b2, b3] as truth, list_concat(list_concat(list_concat(case when tile_id % 5 = 0 then [2000] else []::int[] end, case when tile_id % 11 = 0 then [1000, 1000] else [1000] end), case when tile_id % 17 = 0 then [b2, b1, b0, b3] else [b0, b1, b2, b3] end), list_concat(case when tile_id % 13 = 0 then [7] else []::int[] end, case when tile_id % 7 = 0 then []::int[] else [1001] end)) as s from (select tile_id, x0 // 2 as b0, y0 // 2 as b1, x1 // 2 as b2, y1 // 2 as b3 from comp where component_id = 1))"
_PARSE_SQL = f"(select *, len(list_filter(s, lambda x: x = 1000)) as nb, len(list_filter(s, lambda x: x = 1001)) as ne, list_position(s, 1000) as pb, list_position(s, 1001) as pe, list_max(list_transform(string_split(list_aggregate(list_transform(s, lambda x: case when x < 1000 then 'L' else 'x' end), 'string_agg', ''), 'x'), lambda t: len(t))) as longest_run from {_SEQ_SQL})"
_FAIL_SQL = "case when nb <> 1 then 'marker_count' when ne <> 1 then 'end_count' when pe < pb then 'end_before_marker' when len(list_filter(s[pb + 1 : pb + 4], lambda x: x < 1000)) <> 4 then 'no_four_codes' when pe <> pb + 5 then 'end_not_next' when s[pb + 3] < s[pb + 1] or s[pb + 4] < s[pb + 2] then 'not_canonical' end"


def sequences(spark, d):
    """Token sequences that should be one marker, four codes of a box and an end, some of them malformed; ``truth`` has the codes."""
    t = C("tile_id")
    codes = [F.floor(C(k) / 2).cast("int") for k in ("x0", "y0", "x1", "y1")]
    none = F.array().cast("array<int>")
    ints = lambda *xs: F.array(*(F.lit(x) if isinstance(x, int) else x for x in xs))
    parts = (F.when(t % 5 == 0, ints(2000)).otherwise(none), F.when(t % 11 == 0, ints(BOX, BOX)).otherwise(ints(BOX)), F.when(t % 17 == 0, ints(codes[2], codes[1], codes[0], codes[3])).otherwise(ints(*codes)), F.when(t % 13 == 0, ints(7)).otherwise(none), F.when(t % 7 == 0, none).otherwise(ints(END)))
    return tiles(spark, d).where("component_id = 1").select("tile_id", ints(*codes).alias("truth"), F.concat(*parts).alias("s"))


def parsed(spark, d):
    count = lambda v: F.size(F.filter("s", lambda x: x == v))
    run = F.aggregate("s", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct(F.when(x < BOX, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["most"], F.when(x < BOX, a["now"] + 1).otherwise(0)).alias("most")), lambda a: a["most"])
    rows = sequences(spark, d).withColumns({"nb": count(BOX), "ne": count(END), "pb": F.array_position("s", BOX), "pe": F.array_position("s", END), "longest_run": run})
    rows = rows.withColumn("codes", F.expr("slice(s, cast(greatest(pb, 1) + 1 as int), 4)"))
    four = F.size(F.filter("codes", lambda x: x < BOX)) == 4
    wrong = (F.get("codes", F.lit(2)) < F.get("codes", F.lit(0))) | (F.get("codes", F.lit(3)) < F.get("codes", F.lit(1)))
    failure = F.when(C("nb") != 1, "marker_count").when(C("ne") != 1, "end_count").when(C("pe") < C("pb"), "end_before_marker").when(~four, "no_four_codes").when(C("pe") != C("pb") + 5, "end_not_next").when(wrong, "not_canonical")
    return rows.withColumn("failure", failure)


@query("val_sequence", twin(f"select tile_id, longest_run, {_FAIL_SQL} as failure from {_PARSE_SQL}"))
def val_sequence(spark, d):
    return parsed(spark, d).select("tile_id", "longest_run", "failure")


@query("agg_token_report", twin(f"select split, count(*) as n, avg(case when f is null then 1.0::double else 0.0::double end) as valid_rate, " + ", ".join(f"avg(case when s[pb + {k}] = truth[{k}] then 1.0::double else 0.0::double end) filter (f is null or f = 'not_canonical') as accuracy_{k}" for k in (1, 2, 3, 4)) + ", avg((abs(s[pb + 1] - truth[1]) + abs(s[pb + 2] - truth[2]) + abs(s[pb + 3] - truth[3]) + abs(s[pb + 4] - truth[4])) / 4.0::double) filter (f is null or f = 'not_canonical') as bin_error from (select *, case tile_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split, " + f"{_FAIL_SQL} as f from {_PARSE_SQL}) group by split"))
def agg_token_report(spark, d):
    """Share of well-formed sequences, and accuracy and error of their codes, by split."""
    rows = parsed(spark, d).withColumn("split", split_of())
    said = C("failure").isNull() | (C("failure") == "not_canonical")
    pair = [(F.get("codes", F.lit(k)), F.get("truth", F.lit(k))) for k in range(4)]
    right = [F.avg(F.when(said, (a == b).cast("int"))).alias(f"accuracy_{k + 1}") for k, (a, b) in enumerate(pair)]
    error = sum((F.abs(a - b) for a, b in pair[1:]), F.abs(pair[0][0] - pair[0][1])) / 4.0
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(C("failure").isNull().cast("int")).alias("valid_rate"), *right, F.avg(F.when(said, error)).alias("bin_error"))


@query("arr_steps", twin("select tile_id, query_type as program, len(s) as n_steps, list_aggregate(list_transform(s, lambda x: case when x in ('largest', 'smallest') then 'arg_size' when x in ('left_of', 'right_of', 'above', 'below') then 'filter_relation:' || x when x = 'nearest' then 'argmin_boundary_distance' else 'arg_axis' end), 'string_agg', ' > ') as operations, len(list_filter(s, lambda x: x in ('left_of', 'right_of', 'above', 'below'))) > 0 as has_filter from (select *, string_split(query_type, '_to_') s from smp)"))
def arr_steps(spark, d):
    """The program of every sample as an array of steps, each a struct whose relation only filters have."""
    rows = samples(spark, d).withColumnRenamed("query_type", "program")
    step = lambda x: F.struct(F.when(x.isin("largest", "smallest"), "arg_size").when(x.isin(*DIRECTIONS), "filter_relation").when(x == "nearest", "argmin_boundary_distance").otherwise("arg_axis").alias("operation"), F.when(x.isin(*DIRECTIONS), x).alias("relation"))
    rows = rows.withColumn("steps", F.transform(F.split("program", "_to_"), step))
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["operation"], s["relation"])), " > ")
    return rows.select("tile_id", "program", F.size("steps").alias("n_steps"), shown.alias("operations"), F.exists("steps", lambda s: s["operation"] == "filter_relation").alias("has_filter"))
