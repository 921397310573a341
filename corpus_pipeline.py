"""From raw documents to packed token rows: five stages, each on all that the one before kept.

Every stage but the last returns the columns of ``documents``; ``run`` writes
each result as Parquet to the shared folder and rereads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, langid, mixing, neardup, packing
from tilewright.llm.common import materialise, read_table, unfold, whole_rows
from tilewright.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown (no letter) or ambiguous between two codewords.

    Null, empty and letterless texts go; a null or wrong ``lang`` does not matter and stays as it came; repeated rows
    are judged alike; a very long text is read in slices; an empty table stays empty; further columns, whatever
    their names, are kept.
    """
    model = langid.fit(docs)
    found = langid.predict(whole_rows(docs, docs["text"].alias("text")), model, ["row"])
    return unfold(found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies.

    The least id of a class stays, the first of rows with that id; rows without an id come last. Null texts are classes of their
    own, wordless ones only equal each other byte by byte; a very long text is compared whole; an empty table stays empty;
    further columns, whatever their names, are kept.
    """
    return neardup.drop_near_duplicates(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.

    Null and wordless texts and items hit nothing, so such documents stay, as all do if ``benchmark`` is empty; repeated rows are
    judged alike; a very long text is searched whole; further columns, whatever their names, are kept.
    """
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, in part or repeatedly, until each source has its target share.

    A null source is a source, the last one; null and blank texts have no words and are not taken; repeated rows each count; a very long text is taken in part like others; an empty table stays
    empty; further columns, whatever their names, are kept.
    """
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed rows.

    Null texts are empty, and an empty document still has its end mark; a text longer than a row is split without loss; ties of length go by
    their order; repeated rows are packed each; an empty table gives no rows; further columns are left out.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language id", identify_language),
    ("near-duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("source mixing", mix_sources),
    ("token packing", pack_tokens),
]

#: The near-duplicate, mixing and packing stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
