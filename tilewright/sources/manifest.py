"""Writes that can be checked: files with a manifest of their digests, and reports merged by section.

A manifest names every data file of a folder with its bytes, lines and digest, made by tasks that stream the files. It is written
last, as a folder whose name Spark's readers pass over, so that a folder without one was not finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_json_lines
from .staged import file_system

C = F.col
MANIFEST, ABOUT = "_manifest", "_about"
CHUNK = 1 << 20
FILES = "file string, bytes long, lines long, sha256 string"


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``FILES`` of the data files of a folder and the folders in it, names relative to it. Files without bytes are not listed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, base = file_system(path)
                digest, n_bytes, lines = hashlib.sha256(), 0, 0
                with system.open_input_stream(f"{base.rstrip('/')}/{at}") as f:
                    while data := f.read(CHUNK):
                        digest.update(data)
                        n_bytes, lines = n_bytes + len(data), lines + data.count(b"\n")
                rows.append((name, n_bytes, lines, digest.hexdigest()))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "bytes", "lines", "sha256"])

    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    base = file_system(path)[1].rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    return listing.select(relative.alias("file"), relative.alias("at")).mapInArrow(run, FILES)


def write_checked(df: DataFrame, path: str, *partitions: str, **about: str) -> None:
    """JSON lines of ``df`` in folders by ``partitions``, then what they were made from, then their manifest."""
    spark = df.sparkSession
    write_json_lines(df, path, *partitions)
    facts = {**about, "columns": df.schema.simpleString(), "partitions": ",".join(partitions)}
    spark.createDataFrame(sorted(facts.items()), "name string, value string").coalesce(1).write.json(f"{path}/{ABOUT}")
    digests(spark, path).write.json(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).json(f"{path}/{MANIFEST}")


def read_about(spark: SparkSession, path: str) -> dict[str, str]:
    """The few facts that were given when the folder was written."""
    return dict(spark.read.schema("name string, value string").json(f"{path}/{ABOUT}").collect())


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Every file of the manifest or the folder with its ``status``: ok, changed, missing, or unlisted. A folder without a manifest raises AnalysisException."""
    listed = read_manifest(spark, path).select("file", *(C(c).alias(f"m_{c}") for c in ("bytes", "lines", "sha256")))
    both = listed.join(digests(spark, path), "file", "full")
    status = F.when(C("sha256").isNull(), "missing").when(C("m_sha256").isNull(), "unlisted").when(C("sha256") != C("m_sha256"), "changed").otherwise("ok")
    return both.select("file", "m_lines", C("lines"), status.alias("status"))


# ---- reports ----

REPORT = "section string, revision long, body string"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a report."""
    from pyarrow import fs

    system, base = file_system(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    done = [i.path.split("/")[-2] for i in found if i.path.endswith("/_SUCCESS")]
    return sorted(int(name[1:]) for name in done if name[:1] == "v" and name[1:].isdigit())


def read_report(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The sections of a version, the last one if none is named; no rows before the first merge."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], REPORT)
    return spark.read.schema(REPORT).parquet(f"{path}/v{known[-1] if version is None else version}")


def merge_report(sections: DataFrame, path: str, attempts: int = 5) -> int:
    """Merges ``REPORT`` rows into a report; returns its version.

    Of a section the highest revision stays, of equal ones the greatest body, so merges may come in any order and again; one that
    changes nothing writes nothing. Versions stay readable. If another writer takes the next version first, the merge is made anew on it.
    A version that a writer began and never finished blocks the next merges with RuntimeError until it is removed.
    Null bodies are the least; a null section is a section.
    """
    spark = sections.sparkSession
    given = sections.select(C("section").cast("string"), C("revision").cast("long"), C("body").cast("string"))
    for _ in range(attempts):
        known = versions(spark, path)
        current = read_report(spark, path, known[-1] if known else None)
        merged = current.unionByName(given).groupBy("section").agg(F.max(F.struct("revision", "body")).alias("m")).select("section", "m.*")
        if known and merged.exceptAll(current).isEmpty():
            return known[-1]
        version = known[-1] + 1 if known else 1
        try:
            merged.write.mode("error").parquet(f"{path}/v{version}")
            return version
        except AnalysisException:
            continue
    raise RuntimeError(f"{attempts} other writers were faster")
