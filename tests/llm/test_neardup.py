import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.llm import bagminhash as bag
from tilewright.llm import neardup

WORDS = [f"w{i}" for i in range(3000)]


def bag_of(text):
    w = bag.normal_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """Class id of each row: exact weighted Jaccard over all pairs, then union-find."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [None if t is None else bag_of(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a is None or b is None:
                continue
            same = rows[i][1] == rows[j][1] if not a and not b else a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values())
            if same:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(rows))]


def corpus():
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = rng.choices(WORDS, k=rng.randint(30, 300))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(words))
    many = rng.choices(WORDS, k=200)
    for i in range(120):
        words = list(many)
        words[rng.randrange(200)] = f"x{i}"
        rows.append(" ".join(words))
    rows += ["", "", None, None, "...", "one two", "ONE, two!", "a " * 400, "a " * 390, "a " * 200]
    return list(enumerate(rows))


@pytest.mark.parametrize("small_bucket", [1, 64])
def test_classes_equal_brute_force(spark, small_bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, small_bucket=small_bucket).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}


def test_one_row_of_each_class_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c, d e f", "y"), (None, "a b c d e f", "z"), (3, None, None), (4, None, None), (None, "q r s t u", None)], "doc_id long, text string, label string")
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.label or "") for r in neardup.drop_near_duplicates(docs).collect())
    assert left == [(False, 1, "a b c d e f", "x"), (False, 3, "", ""), (False, 4, "", ""), (True, 0, "q r s t u", "")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node string, label int")
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.drop_near_duplicates(docs).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 2), (3, 4), (2, 5), (9, 8)]])
def test_components(spark, edges):
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    label = {r.node[0]: bytes(r.label) for r in neardup.components(links).collect()}
    for a, b in edges:
        assert label[a] == label[b]
    groups = {1: 1} if edges[0] != (1, 2) else {1: 1, 3: 1, 9: 1}
    assert len(set(label.values())) == len(groups)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = rng.choices(WORDS[:60], k=400)
    other = base[:300] + rng.choices(WORDS, k=100)
    docs = [[w.encode() for w in d] for d in (base, other)]
    doc, h = bag.shingles(docs, 1)
    doc, h, weight, _ = bag.weighted(doc, h)
    s = bag.signatures(doc, h, weight, 2, 2048)
    a, b = Counter(base), Counter(other)
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_keep_is_once_for_each_class(spark):
    docs = spark.createDataFrame([(i % 5, "same text of several words here") for i in range(20)], "doc_id long, text string")
    found = neardup.near_duplicates(docs)
    assert found.where("keep").count() == 1
    assert [r.class_size for r in found.select("class_size").distinct().collect()] == [20]
    assert neardup.drop_near_duplicates(docs.withColumn("row_key_x", F.lit(1))).count() == 1


def test_pairs_of_a_run_of_shared_shingles_meet_once(spark):
    prefixes = {"a": [1, 2, 3, 4, 5, 6, 7], "b": [1, 2, 3, 4, 5, 6, 7], "c": [9, 3, 4, 5, 6, 7, 8], "d": [20, 21, 1, 22, 23, 24, 2]}
    rows = [(0, u, k, 10, k, 10 - i, p[max(0, i - neardup.BEFORE) : i], "z") for k, p in prefixes.items() for i, u in enumerate(p)]
    met = spark.createDataFrame(rows, "hub long, unit long, node string, n long, label string, left long, before array<long>, top string")
    got = Counter((r.a, r.b) for r in neardup.met_pairs(met, 0.1).collect())
    assert got == dict.fromkeys([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d")], 2)  # once from each side
