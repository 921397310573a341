"""Leaks by exact and normalised texts against plain Python."""

import re

from pyspark.sql import functions as F

from tilewright.plans.table_queries import leakage, normalised


def plainly(text):
    text = re.sub("[\t-\r 　]+", "", text)
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate(str.maketrans("，。？！、：；（）“”‘’", ",.?!,:;()\"\"''"))
    return re.sub(r"[.,!?;:]+\Z", "", text)


TEXTS = ["Mark the HOUSE。", " mark\tthe house ", "mark the house", "（a）！", "(A)", "", " . ", "　x，y：\n", "x,y", "É", "é", "a.b", "a.b..", "“q”", '"q"', "‘s’", "'s'", "house ", "house", "、、"]


def test_normalised(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", normalised(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [plainly(r.t) for r in rows]


def test_leaks(spark):
    train = [*TEXTS, "mark the house", "mark the house", None, "own"]
    groups = {"one": ["MARK the house!", "mark the house", None, "(a)"], "two": ["nothing like it", "other"], "three": ["", "X，Y"], "none": [None]}
    got = leakage(spark.createDataFrame([(t,) for t in train], "prompt string"), spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "grp string, prompt string")).collect()
    want = set()
    for g, prompts in groups.items():
        real = [p for p in prompts if p is not None]
        if real:
            exact = sum(t in real for t in train if t is not None)
            plain = sum(plainly(t) in {plainly(p) for p in real} for t in train if t is not None)
            want.add((g, len(real), exact, plain, "INVALID_EXPERIMENT"))
    assert {tuple(r) for r in got} == want and ("two", 2, 0, 0, "INVALID_EXPERIMENT") in want
    clean = leakage(spark.createDataFrame([("a",)], "prompt string"), spark.createDataFrame([("g", "b")], "grp string, prompt string")).collect()
    assert [tuple(r) for r in clean] == [("g", 1, 0, 0, "NO_LEAKAGE")]
