"""Queries on file formats: dBASE tables, shapefile headers and filters on boxes, TIFF metadata, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as P
from ..queries import query, twin
from ..session import ship
from ..sources import dbase, files, manifest, shapefiles, tiff
from ..sources.tables import split_of, table
from .base_queries import tiles
from .field_queries import records
from .shape_queries import rings, shape_twin, shaped

C = F.col


@query("src_dbase", "select p_partkey, nullif(trim(p_name), '') as p_name, nullif(trim(p_brand), '') as p_brand, nullif(trim(p_type), '') as p_type, cast(p_size as bigint) as p_size, round(p_retailprice, 6) as p_retailprice, cast(0 as bigint) as n_issues from part where p_partkey % 7 <> 3")
def src_dbase(spark, d):
    """Parts as dBASE tables, a seventh of them flagged as deleted, read back with typed fields."""
    ship(spark)
    path = files.scratch(spark, "dbase")
    dbase.write_dbase(table(spark, d, "part").withColumn("gone", C("p_partkey") % 7 == 3), path, deleted="gone")
    back = spark.read.format("dbase").load(path)
    return back.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.round("p_retailpr", 6).alias("p_retailprice"), F.size("_issues").cast("long").alias("n_issues"))


@query("src_shape_boxes", shape_twin("select x0::double as xmin, y0::double as ymin, x1::double as xmax, y1::double as ymax, count(*) as n, cast(sum(case when kind < 2 then 1 else 2 end) as bigint) as n_parts from shp where x1 >= 200 and x0 < 260 and y1 > 100 and y0 <= 300 group by 1, 2, 3, 4"))
def src_shape_boxes(spark, d):
    """Shapes written in order of their boxes, and those that meet a window: the window reaches the reader, which leaves out files by their headers."""
    ship(spark)
    spark.dataSource.register(shapefiles.ShapefileSource)
    path = files.scratch(spark, "boxes")
    shapes = rings(spark, d).groupBy("tile_id", "component_id", "x0", "y0").agg(F.array_sort(F.collect_list(F.struct("number", "ring")))["ring"].alias("rings"))
    shapes.repartitionByRange("x0", "y0", "tile_id").select("rings").write.format("shapefile").mode("append").save(path)
    found = shapefiles.within(spark, path, (C("xmax") >= 200) & (C("xmin") < 260) & (C("ymax") > 100) & (C("ymin") <= 300))
    return found.groupBy(*shapefiles.BOX).agg(F.count("*").alias("n"), F.sum(F.size("parts")).alias("n_parts"))


_IMAGES = "(select tile_id, min(x0) as l, min(y0) as t, max(x1) - min(x0) + 1 as w, max(y1) - min(y0) + 1 as h from comp group by 1)"


def images(spark, d) -> str:
    """A folder with a TIFF image of each tile's components and its world file."""
    path = files.scratch(spark, "images")
    tiff.write_images(P.runs_of(shaped(spark, d)), path).write.format("noop").mode("overwrite").save()
    return path


@query("src_tiff_metadata", twin(f"select tile_id, tile_id % 2 = 1 as little, tile_id % 3 = 0 as big_tiff, tile_id % 5 < 2 as tiled, cast(w as bigint) as width, cast(h as bigint) as height, cast(8 as bigint) as bits, cast(8 as bigint) as compression, cast(case when tile_id % 5 < 2 then 128 end as bigint) as tile_width, cast(case when tile_id % 5 >= 2 then 64 end as bigint) as rows_per_strip, cast(case when tile_id % 5 < 2 then ((w + 127) // 128) * ((h + 127) // 128) else (h + 63) // 64 end as bigint) as n_parts from {_IMAGES}"))
def src_tiff_metadata(spark, d):
    """Size and layout of every tile's image, of both byte orders and versions, by its first directory."""
    return tiff.read_metadata(spark, images(spark, d)).where("issue is null").select("tile_id", "little", "big_tiff", "tiled", "width", "height", "bits", "compression", "tile_width", "rows_per_strip", "n_parts")


@query("src_world_files", twin(f"select tile_id, tile_id * 256 + l * 0.5::double - 0.25::double as left_, 1000 - t * 0.5::double + 0.25::double as top, tile_id * 256 + (l + w) * 0.5::double - 0.25::double as right_, 1000 - (t + h) * 0.5::double + 0.25::double as bottom from {_IMAGES}"))
def src_world_files(spark, d):
    """The ground that each image covers: its size by its metadata, placed by its world file."""
    path = images(spark, d)
    both = tiff.read_metadata(spark, path).where("issue is null").select("tile_id", "width", "height").join(tiff.read_world_files(spark, path).where("issue is null"), "tile_id")
    corner = lambda x, y: (C("a") * x + C("b") * y + C("c"), C("d") * x + C("e") * y + C("f"))
    (left, top), (right, bottom) = corner(-0.5, -0.5), corner(C("width") - 0.5, C("height") - 0.5)
    return both.select("tile_id", left.alias("left_"), top.alias("top"), right.alias("right_"), bottom.alias("bottom"))


@query("sink_manifest", twin("select 'split=' || split as folder, count(*) as n, 'ok' as status, 'lineitem' as source from comp group by split"))
def sink_manifest(spark, d):
    """Records written with a manifest, every file checked against it, and its lines counted by folder."""
    ship(spark)
    path = files.scratch(spark, "checked")
    manifest.write_checked(records(spark, d), path, "split", source="lineitem")
    about = manifest.read_about(spark, path)
    checked = manifest.verified(spark, path)
    return checked.groupBy(F.substring_index("file", "/", 1).alias("folder"), "status").agg(F.sum("m_lines").alias("n")).withColumn("source", F.lit(about["source"]))


@query("sink_report", twin("select case when k = 0 then 'split/' || split else 'border/' || border end as section, cast(1 + k as bigint) as revision, '{\"n\":' || count(*) || ',\"area\":' || cast(sum(area_px) as bigint) || '}' as body, cast(3 as bigint) as version from (select *, unnest([0, 1]) as k from comp) group by k, case when k = 0 then split end, case when k = 1 then border end, case when k = 0 then 'split/' || split else 'border/' || border end"))
def sink_report(spark, d):
    """Two sets of sections merged into one report, an outdated one and a repeated one among the merges; versions count the merges that changed it."""
    c = tiles(spark, d).withColumn("split", split_of())
    path = files.scratch(spark, "report")
    body = F.to_json(F.struct(F.count("*").alias("n"), F.sum("area_px").alias("area"))).alias("body")
    by_split = c.groupBy(F.concat(F.lit("split/"), "split").alias("section")).agg(body).withColumn("revision", F.lit(1))
    by_border = c.groupBy(F.concat(F.lit("border/"), C("border").cast("string")).alias("section")).agg(body).withColumn("revision", F.lit(2))
    outdated = by_border.withColumn("revision", F.lit(1)).withColumn("body", F.lit("{}"))
    for sections in (by_split, outdated, by_border, by_split, outdated):
        version = manifest.merge_report(sections, path)
    return manifest.read_report(spark, path).withColumn("version", F.lit(version).cast("long"))
