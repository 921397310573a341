"""Pairs of shapes of a tile: common pixels against masks, one exchange, and the order of the oracle's choice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import difference, duck
from tilewright import registry
from tilewright.operators import runs as P
from tilewright.plans.shape_queries import oracle_fit

SF = "/root/testdata/sf0.001"


def mask(s, whole=False):
    out = np.zeros((64, 64), bool)
    out[s[1] : s[3] + 1, s[0] : s[2] + 1] = True
    if not whole:
        out[s[5] : s[7] + 1, s[4] : s[6] + 1] = False
    return out


@pytest.fixture(scope="module")
def shapes():
    rng, out = random.Random(4), []
    for i in range(40):
        x0, y0, w, h = rng.randint(0, 30), rng.randint(0, 30), rng.randint(3, 30), rng.randint(3, 30)
        x1, y1, a, b = x0 + w - 1, y0 + h - 1, w // 3, h // 3
        cuts = [(x1 + 1, y1 + 1, x1, y1), (x1 + 1 - a, y0, x1, y0 + b - 1), (x0 + a, y0 + b, x1 - a, y1 - b), (x0 + a, y0, x1 - a, y1)]
        out.append((x0, y0, x1, y1, *cuts[i % 4]))
    return out


def test_common_pixels_equal_masks(spark, shapes):
    rows = spark.createDataFrame([(1, i, *s) for i, s in enumerate(shapes)], "tile_id long, component_id int, " + ", ".join(f"{c} int" for c in P.BOX))
    pairs = P.side(rows, "a").join(P.side(rows, "b"), "tile_id").where("aid != bid")
    got = pairs.select("aid", "bid", P.common().alias("i"), P.common(a_box=True).alias("ib")).collect()
    assert len(got) == 40 * 39
    for r in got:
        a, b = shapes[r.aid], shapes[r.bid]
        assert r.i == (mask(a) & mask(b)).sum() and r.ib == (mask(a, True) & mask(b)).sum(), (a, b)
    assert {(r.aid, r.bid, r.i) for r in got if r.i} == {(r.aid, r.bid, r.i) for r in P.overlaps(rows).collect()}


@pytest.mark.parametrize("name", ["join_iou_match", "join_overlap_share", "met_best_iou", "met_dice", "met_iou", "met_modes", "met_pair_pass", "met_precision_recall", "met_recall", "til_iou"])
def test_pairs_are_not_shuffled_by_their_pixels(spark, name):
    """The tile's exchange and those of the last counts at most; rows of pixels are never made."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and plan.count("Join") == 1 and plan.count("Relation [") == 2


def test_a_little_better_fit_gives_way_to_confidence(spark):
    rows = spark.createDataFrame([(2, 0.3000001, 0.1), (3, 0.3, 0.9), (4, 0.2, 1.0), (5, 0.3, 0.9)], "component_id int, v double, confidence double")
    assert rows.agg(F.max_by("component_id", oracle_fit())).first()[0] == 3


def test_top_oracle_equals_sql_on_close_fits(spark, tmp_path):
    """Components 2 and 4 of this tile fit almost equally well, 2 with more confidence."""
    lines = [(314554, 3607, 5, 20.0, 45040.31), (317458, 3586, 4, 5.0, 97406.0), (309480, 3523, 6, 7.0, 29855.76), (303086, 3363, 5, 34.0, 94015.85), (302030, 3950, 6, 2.0, 94616.78)]
    rows = spark.createDataFrame([(587873, *x) for x in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    rows.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("part-*.parquet")).rename(tmp_path / "lineitem.parquet")
    assert difference(registry.queries()["top_oracle"](spark, str(tmp_path)), duck(str(tmp_path)), registry.oracle_sql()["top_oracle"]) is None
