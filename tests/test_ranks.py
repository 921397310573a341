"""Running totals over ranges against plain sums: one huge group, null groups and values, both orders, no rows."""

import random

import pytest

from tilewright.operators.ranks import running_totals


def plainly(rows, descending):
    out = []
    for g, v, n, m in rows:
        key = lambda x: (x is not None, x or 0)
        before = [r for r in rows if r[0] == g and (key(r[1]) > key(v) if descending else key(r[1]) < key(v))]
        group = [r for r in rows if r[0] == g]
        out.append((g, v, n, m, sum(r[2] for r in before), sum(r[3] for r in before), sum(r[2] for r in group), sum(r[3] for r in group)))
    return sorted(out, key=str)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(11)
    rows = {(g, v): (rng.randrange(1, 9), rng.randrange(3)) for g, size in (("hot", 500), ("few", 3), (None, 40), ("one", 1)) for v in [None, *(rng.randrange(10**6) / 8 for _ in range(size))]}
    rows = [(*k, *n) for k, n in rows.items()]
    df = spark.createDataFrame(rows, "g string, v double, n long, m long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or small ranges are joined
    try:
        got = running_totals(df, ["g"], "v", ["n", "m"], descending).collect()
        one = running_totals(df.drop("g").groupBy("v").sum("n", "m").toDF("v", "n", "m"), [], "v", ["n", "m"], descending).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(r) for r in got), key=str) == plainly(rows, descending)
    whole = [(None, r.v, r.n, r.m) for r in one]
    assert sorted(((None, *r) for r in one), key=str) == plainly(whole, descending)


def test_no_rows(spark):
    assert running_totals(spark.createDataFrame([], "g string, v double, n long"), ["g"], "v", ["n"]).collect() == []
