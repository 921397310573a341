"""Queries of rasters, rings, fields, features, embeddings and tiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import geometry as G
from ..operators.semantic import references
from ..queries import query, twin
from ..sources.tables import table
from .base_queries import ids, tiles

C = F.col
CELL = 64


@query("geo_tight_box", twin("select tile_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from comp group by tile_id"))
def geo_tight_box(spark, d):
    return tiles(spark, d).groupBy("tile_id").agg(*(F.min(k).alias(k) for k in ("x0", "y0")), *(F.max(k).alias(k) for k in ("x1", "y1")))


# ---- functions ----


@query("fn_affine", twin("select tile_id, component_id, 500000.0::double + 0.25::double * cx as world_x, 4000000.0::double - 0.25::double * cy as world_y from comp"))
def fn_affine(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", (500000.0 + 0.25 * C("cx")).alias("world_x"), (4000000.0 - 0.25 * C("cy")).alias("world_y"))


#: The ellipsoid's larger half axis in metres, its eccentricity, steps of the iteration.
AXIS, ECCENTRICITY, STEPS = 6378137.0, 0.08181919084262149, 8


@query("fn_mercator", twin(f"select tile_id, component_id, round(degrees((500000.0::double + cx) / {AXIS!r}::double), 9) as lon, round(degrees(list_reduce(range({STEPS}), lambda lat, i: pi() / 2 - 2 * atan(t * pow((1 - {ECCENTRICITY!r}::double * sin(lat)) / (1 + {ECCENTRICITY!r}::double * sin(lat)), {ECCENTRICITY / 2!r}::double)), pi() / 2 - 2 * atan(t))), 9) as lat from (select *, exp(-(4000000.0::double - cy) / {AXIS!r}::double) as t from comp)"))
def fn_mercator(spark, d):
    """Longitude and latitude on the ellipsoid of each centroid's Mercator metres; the latitude by a fixed number of steps."""
    rows = tiles(spark, d).withColumn("t", F.exp(-(4000000.0 - C("cy")) / AXIS))
    share = lambda lat: (1 - ECCENTRICITY * F.sin(lat)) / (1 + ECCENTRICITY * F.sin(lat))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.pi() / 2 - 2 * F.atan("t"), lambda lat, i: F.pi() / 2 - 2 * F.atan(C("t") * F.pow(share(lat), ECCENTRICITY / 2)))
    return rows.select("tile_id", "component_id", F.round(F.degrees((500000.0 + C("cx")) / AXIS), 9).alias("lon"), F.round(F.degrees(lat), 9).alias("lat"))


BINS = 1000


def _bins_sql(k: str) -> str:
    lo, hi = f"least({k}0 * {BINS - 1} // 512, {BINS - 1})", f"least((({k}1 + 1) * {BINS - 1} + 511) // 512, {BINS - 1})"
    return f"cast(case when {hi} <= {lo} and {lo} + 1 > {BINS - 1} then greatest(0, {hi} - 1) else {lo} end as bigint) as q{k}0, cast(case when {hi} <= {lo} and {lo} + 1 <= {BINS - 1} then {lo} + 1 else {hi} end as bigint) as q{k}1"


@query("fn_quantize", twin(f"select tile_id, component_id, {_bins_sql('x')}, {_bins_sql('y')} from comp"))
def fn_quantize(spark, d):
    """Each box in bins of the tile: the bins enclose it, low ends rounded down and high ones up, and are never empty."""
    rows = tiles(spark, d)
    for k in "xy":
        low = F.least(F.floor(C(f"{k}0") * (BINS - 1) / 512), F.lit(BINS - 1))
        high = F.least(F.ceil((C(f"{k}1") + 1) * (BINS - 1) / 512), F.lit(BINS - 1))
        rows = rows.withColumns({f"lo{k}": low, f"hi{k}": high})
        empty, fits = C(f"hi{k}") <= C(f"lo{k}"), C(f"lo{k}") + 1 <= BINS - 1
        rows = rows.withColumns({f"q{k}0": F.when(empty & ~fits, F.greatest(F.lit(0), C(f"hi{k}") - 1)).otherwise(C(f"lo{k}")), f"q{k}1": F.when(empty & fits, C(f"lo{k}") + 1).otherwise(C(f"hi{k}"))})
    return rows.select("tile_id", "component_id", "qx0", "qx1", "qy0", "qy1")


@query("fn_expand_box", twin("select tile_id, component_id, greatest(0, x0 - cast(ceil(w * 0.1::double) as bigint)) as ex0, greatest(0, y0 - cast(ceil(h * 0.1::double) as bigint)) as ey0, least(511, x1 + cast(ceil(w * 0.1::double) as bigint)) as ex1, least(511, y1 + cast(ceil(h * 0.1::double) as bigint)) as ey1 from comp"))
def fn_expand_box(spark, d):
    m = {"x": F.ceil(C("w") * 0.1), "y": F.ceil(C("h") * 0.1)}
    lows = (F.greatest(F.lit(0), C(f"{k}0") - m[k]).alias(f"e{k}0") for k in "xy")
    highs = (F.least(F.lit(511), C(f"{k}1") + m[k]).alias(f"e{k}1") for k in "xy")
    return tiles(spark, d).select("tile_id", "component_id", *lows, *highs)


@query("fld_centroid", twin("select tile_id, component_id, (cx + 0.5) / 512 as u, (cy + 0.5) / 512 as v from comp"))
def fld_centroid(spark, d):
    return tiles(spark, d).select("tile_id", "component_id", ((C("cx") + 0.5) / 512).alias("u"), ((C("cy") + 0.5) / 512).alias("v"))


# ---- features ----


@query("feat_geom8", twin("select tile_id, component_id, cx / 512 as f1, cy / 512 as f2, w / 512 as f3, h / 512 as f4, sqrt(area_px) / 512 as f5, ln(w / h) as f6, area_px / 262144.0::double as f7, sqrt((cx - 255.5) * (cx - 255.5) + (cy - 255.5) * (cy - 255.5)) / 512 as f8 from comp"))
def feat_geom8(spark, d):
    dx, dy = C("cx") - 255.5, C("cy") - 255.5
    f = (C("cx") / 512, C("cy") / 512, C("w") / 512, C("h") / 512, F.sqrt("area_px") / 512, F.log(C("w") / C("h")), C("area_px") / 262144.0, F.sqrt(dx * dx + dy * dy) / 512)
    return tiles(spark, d).select("tile_id", "component_id", *(x.alias(f"f{i + 1}") for i, x in enumerate(f)))


_SET = ("cx", "cy", "w", "h", "area_px", "confidence")


def _set_features(name, extra):
    kinds = [("mean", "avg", F.avg), ("low", "min", F.min)] + ([("high", "max", F.max)] if extra else [])
    cols = [(f"{c}_{k}", sql, f, c) for c in _SET for k, sql, f in kinds]
    more = ", count(*) as n, count(*) filter (border) as n_border" if not extra else ""

    @query(name, twin("select tile_id, " + ", ".join(f"cast({sql}({c}) as double) as {a}" for a, sql, _, c in cols) + more + " from comp group by tile_id"))
    def run(spark, d):
        found = [f(c).cast("double").alias(a) for a, _, f, c in cols]
        return tiles(spark, d).groupBy("tile_id").agg(*found, *([] if extra else [F.count("*").alias("n"), F.count_if("border").alias("n_border")]))


_set_features("feat_set18", True)
_set_features("feat_set14", False)


# ---- embeddings ----

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"
_NORM = "list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))"


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prototypes(rows):
    """(label, proto): the mean vector of each label, averaged by dimension before it is put together."""
    by = rows.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(C("x").cast("double")).alias("m"))
    return by.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("proto"))


_PROTO = "(select label, list(m order by i) as proto from (select label, i, avg(cast(embedding[i] as double)) m from embeddings, range(1, 65) t(i) group by 1, 2) group by label)"


@query("vec_cosine", f"select e.label, avg({_DOT.format(a='embedding', b='proto')} / sqrt({_NORM} * list_sum(list_transform(proto, lambda x: x * x)))) as cosine, count(*) as n from embeddings e join {_PROTO} p on p.label = e.label group by e.label")
def vec_cosine(spark, d):
    """Mean cosine of each label's vectors to their prototype."""
    rows = table(spark, d, "embeddings").select("label", "embedding")
    both = rows.join(prototypes(rows), "label")
    cosine = dot("embedding", "proto") / F.sqrt(dot("embedding", "embedding") * dot("proto", "proto"))
    return both.groupBy("label").agg(F.avg(cosine).alias("cosine"), F.count("*").alias("n"))


@query("vec_pairwise", f"select label, (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) as mean_cosine from (select label, i, sum(cast(embedding[i] as double) / sqrt(q)) as s, count(*) as n from (select label, embedding, {_NORM} as q from embeddings), range(1, 65) t(i) group by 1, 2) group by label having max(n) > 1")
def vec_pairwise(spark, d):
    """Mean cosine of all pairs of a label from the sum of its unit vectors, without making a pair."""
    rows = table(spark, d, "embeddings").select("label", F.sqrt(dot("embedding", "embedding")).alias("q"), "embedding")
    by = rows.select("label", "q", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.sum(C("x").cast("double") / C("q")).alias("s"), F.count("*").alias("n"))
    n = F.max("n")
    return by.groupBy("label").agg(((F.sum(C("s") * C("s")) - n) / (n * (n - 1))).alias("mean_cosine"), n.alias("n")).where("n > 1").select("label", "mean_cosine")
