"""The filter audit against a plain count in every order, and its defined cases."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.compare import difference, duck
from tilewright.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, failed string"


def plain(rows, labels):
    """Every document through every order."""
    words = lambda t: [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = Counter()
    parts = {p or "" for *_, p in rows}
    for d, t, p in rows:
        t, p = t or "", p or ""
        w = words(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and t in least and least[t] < d,
        }
        for order in permutations("ABCDE"):
            o, there = "".join(order), True
            for k, f in enumerate(order):
                key = (p, o, k + 1)
                if there and fails[f]:
                    there = False
                    out[(*key, "removed")] += 1
                    out[(*key, "good_lost")] += d in good
                    out[(*key, "toxic_lost")] += d in toxic
                    for other in permutations("ABCDE"):
                        out[(p, "".join(other), other.index(f) + 1, "shapley")] += 1
                elif fails[f]:
                    out[(*key, "redundant")] += 1
                out[(*key, "kept")] += there
                out[(*key, "unique_fails")] += fails[f] and sum(fails.values()) == 1
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(p, "".join(o), s): tuple(out[(p, "".join(o), s, n)] for n in names) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_plain_count(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice((30, 4000)))], k=rng.choice((5, 99, 100, 150)))) for _ in range(12)]
    texts += ["", None, "  \t\x0b", "ABC def", "Ünï #", "a" * 200_000, "x | y " * 60, "   ", "AAAA B" * 40]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, ""))) for i in range(60)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "de"), (None, rows[5][1], "en"), (None, None, None), (None, "only here", "en"), (-7, rows[9][1], "de")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(d, t, p, "s", 1, "k", "f") for d, t, p in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert found(filter_audit.audit(docs, marks)) == plain(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(1, "a", "en", None, None, None, None)], SCHEMA)
    assert filter_audit.audit(one, marks).count() == 600


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (4, "c", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, {"Q": F.col("text") == "a"})
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got.collect()}
    assert rows["x", "QE", 1] == (1, 2, 0, 3) and rows["x", "QE", 2] == (1, 0, 1, 1)
    assert rows["x", "EQ", 1] == (2, 1, 0, 1) and rows["", "EQ", 2] == (1, 0, 0, 0)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    assert difference(filter_audit.op11_filter_audit(spark, sf), duck(sf), filter_audit.OP11_SQL) is None
