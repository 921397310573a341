"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expressions of the word definitions that the operators use.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Spark's setting that shuffle files go when the query that wrote them has ended, not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one; on a cluster that would
    be one machine's own folder, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of it.

    Cuts the lineage so that a lost executor costs no recomputation, and freezes
    values that depend on partitioning (``monotonically_increasing_id``). The shuffle
    files of the write go with its end; the session's setting is as before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table that ``materialise`` wrote, once nothing that is still to run reads it."""
    path = getattr(df, "written_to", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def arrow_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """``df``, with the session's Arrow batches from now on limited to ``size`` bytes, so that a
    Python worker holds a few times that, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def apart(keep: Iterable[str], outputs: Iterable[str]) -> list[str]:
    """Names for kept columns: their own, with ``_`` behind those that an output column has."""
    taken, names = {o.lower() for o in outputs}, []
    for name in keep:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """``row``, a struct of all columns, and further columns: no name inside the struct can clash with theirs."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *more)


def unfold(rows: DataFrame) -> DataFrame:
    """The columns of ``row`` again."""
    return rows.select(*(F.col("row")[c].alias(c) for c in rows.schema["row"].dataType.names))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def space_word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def alnum_words(text: Column) -> Column:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null gives no words."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_BREAK)
    return F.filter(parts, lambda w: w != "")


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 2, F.lit(False))
