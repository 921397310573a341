"""Every stage of the pipeline on planted rows, against what plain Python says of them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_contracts import WORDS
from tests.llm.test_neardup import bag_of
from tests.llm.test_operators import brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, score double, ambiguous int, key string, row string, epochs int"
ITEM = "the quick benchmark item has twelve words that nobody would ever write twice"


def planted():
    rng = random.Random(11)
    rows = []
    for i in range(90):
        k = ("aa", "bb", "cc")[i % 3]
        rows.append((" ".join(rng.choices([w + str(rng.randint(0, 300)) for w in WORDS[k]], k=rng.randint(20, 60))), k))
    rows += [(rows[0][0], "aa"), (rows[1][0] + " borg", "bb"), (rows[2][0] + " " + ITEM, "cc"), (rows[3][0][:40] + " " + " ".join(WORDS["aa"] * 3) + " " + ITEM, "aa")]
    rows += [(None, "aa"), ("", "bb"), ("123 456", None), ("kala mano " * 3000, "aa")]
    return [(i, t, k, (None, "s", "t")[i % 3], 0.5, 7, "k", "r", 3) for i, (t, k) in enumerate(rows)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([("i1", ITEM), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(planted(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input and output."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        found[name] = docs, out
        docs = out
    return found


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "token packing"


def test_language_rejects_what_has_no_letter(stages):
    before, after = stages["language id"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    lettered = {r[0] for r in planted() if r[1] and any(c.isalpha() for c in r[1])}
    assert {r[0] for r in planted()} - lettered <= gone
    clean = {r[0] for r in planted()[:90]}
    assert len(clean & gone) <= 2


def test_one_of_each_class_stays(stages):
    before, after = (rows_of(x) for x in stages["near-duplicates"])
    bags = {d: bag_of(t) for d, t in before}
    root = {d: d for d in bags}
    for i, a in enumerate(sorted(bags)):
        for b in sorted(bags)[i + 1 :]:
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert [d for d, _ in after] == sorted(set(root.values()))


def test_documents_with_an_item_go(stages):
    before, after = (rows_of(x) for x in stages["decontamination"])
    assert [d for d, _ in after] == [d for d, t in before if not brute_hits(t, [("i1", ITEM)])[1]]


def test_sources_come_near_their_targets(stages):
    before, after = stages["source mixing"]
    sizes = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    size, taken = sizes(before), sizes(after)
    from tilewright.llm.mixing import targets

    names = sorted(size, key=lambda s: (s is None, s or ""))
    for name, aim in zip(names, targets([size[n] for n in names], [1, 2, 3][: len(names)]), strict=True):
        assert abs(taken.get(name, 0) - aim) <= 256


def test_packed_rows_hold_every_document(stages):
    before, after = stages["token packing"]
    ids = sorted(d for r in after.collect() for d, s in zip(r.doc_ids, r.token_starts, strict=True) if s == 0)
    assert ids == sorted(r.doc_id for r in before.select("doc_id").collect())


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def segments(packed):
    """Every document's pieces with their lengths, which row they are in aside."""
    return sorted((d, s, b - a) for r in packed.collect() for d, s, a, b in zip(r.doc_ids, r.token_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False))


def test_whole_run(spark, sf_dir, stages):
    assert segments(corpus_pipeline.run(spark, sf_dir)) == segments(stages["token packing"][1])
