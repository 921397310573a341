"""Manifests name changed files; merged reports do not depend on the order of merges."""

import hashlib
import itertools

import pytest
from pyspark.errors import AnalysisException

from tilewright.session import ship
from tilewright.sources import manifest as M


def test_changed_files_are_named(spark, tmp_path):
    ship(spark)
    path = tmp_path / "out"
    df = spark.range(3000).selectExpr("id", "'x' || id as name", "case when id % 3 = 0 then 'a' else 'b' end as part")
    M.write_checked(df, str(path), "part", source="numbers", seed="7")
    assert M.read_about(spark, str(path)) == {"source": "numbers", "seed": "7", "columns": df.schema.simpleString(), "partitions": "part"}
    listed = M.read_manifest(spark, str(path)).collect()
    assert sum(r.lines for r in listed) == 3000
    assert {r.file for r in listed} == {str(f.relative_to(path)) for f in path.glob("part=*/part-*")}
    for r in listed:
        data = (path / r.file).read_bytes()
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert {r.status for r in M.verified(spark, str(path)).collect()} == {"ok"}
    # Spark's readers see the data alone
    assert spark.read.json(str(path)).count() == 3000

    first, second = (path / r.file for r in sorted(listed)[:2])
    first.write_bytes(first.read_bytes().replace(b"x", b"y", 1))
    second.rename(second.with_name("part-moved.txt"))
    status = {r.file: r.status for r in M.verified(spark, str(path)).collect()}
    moved = str(second.with_name("part-moved.txt").relative_to(path))
    assert status[sorted(listed)[0].file] == "changed" and status[sorted(listed)[1].file] == "missing" and status[moved] == "unlisted"
    assert sum(s != "ok" for s in status.values()) == 3


def test_unfinished_folder(spark, tmp_path):
    (tmp_path / "part-0").write_text("{}\n")
    with pytest.raises(AnalysisException):
        M.verified(spark, str(tmp_path))


def test_merges_in_any_order(spark, tmp_path):
    sets = [[("a", 1, "one"), ("b", 1, "x")], [("b", 2, "y"), ("c", 1, None), (None, 1, "n")], [("b", 2, "w"), ("c", 1, "v")]]
    want = {("a", 1, "one"), ("b", 2, "y"), ("c", 1, "v"), (None, 1, "n")}
    for k, order in enumerate(itertools.permutations(range(3))):
        path = str(tmp_path / f"r{k}")
        for i in (*order, order[0]):
            version = M.merge_report(spark.createDataFrame(sets[i], M.REPORT), path)
        assert {tuple(r) for r in M.read_report(spark, path).collect()} == want
        assert version == M.versions(spark, path)[-1] <= 3
        first = {tuple(r) for r in M.read_report(spark, path, 1).collect()}
        assert first == set(sets[order[0]])
    assert M.merge_report(spark.createDataFrame([], M.REPORT), path) == version
    assert M.read_report(spark, str(tmp_path / "none")).collect() == []
