"""Queries without an SQL form against plain Python over all of their input."""

import difflib
import math
import string
import unicodedata

import numpy as np
import pytest

from tilewright.config import DEFAULT
from tilewright.plans import audit_queries, base_queries, field_queries, shape_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def asked(spark):
    return [r.asDict() for r in base_queries.samples(spark, SF).select("tile_id", "level", "query_type", "target", "trivial").collect()]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet").collect()


def masks_of(rows):
    out = {}
    for r in rows:
        m = np.zeros((DEFAULT.height, DEFAULT.width), bool)
        m[r.y0 : r.y1 + 1, r.x0 : r.x1 + 1] = True
        if r.ux1 >= r.ux0 and r.uy1 >= r.uy0:
            m[r.uy0 : r.uy1 + 1, r.ux0 : r.ux1 + 1] = False
        out.setdefault(r.tile_id, {})[r.component_id] = m
    return out


def test_greedy_match(spark):
    shapes = masks_of(shape_queries.shaped(spark, SF).where("tile_id % 7 = 1").collect())
    want = {}
    for t, masks in shapes.items():
        taken = set()
        for a in sorted(k for k in masks if k % 2):
            free = [((masks[a] & masks[b]).sum() / (masks[a] | masks[b]).sum(), -b) for b in masks if b % 2 == 0 and b not in taken]
            best = max(free, default=(0, 0))
            if best[0] > 0 and best[0] >= shape_queries.MATCH:
                taken.add(-best[1])
                want[t, a] = (-best[1], best[0])
    got = {(r.tile_id, r.aid): (r.bid, r.iou) for r in shape_queries.join_greedy_match(spark, SF).where("tile_id % 7 = 1").collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_character_similarity(spark, turns):
    by = {}
    for r in turns:
        text = "".join(c for c in r.text or "" if c not in string.punctuation).strip(" ").lower()
        by.setdefault(r.conv_id, []).append((r.turn, text))
    want = {}
    for c, said in by.items():
        said.sort()
        for (t, a), (_, b) in zip(said, said[1:], strict=False):
            want[c, t] = round(difflib.SequenceMatcher(None, a, b).ratio(), 9) if a or b else 1.0
    assert {(r.conv_id, r.turn): r.similarity for r in field_queries.met_char_sim(spark, SF).collect()} == want


def test_compatibility_forms(spark, turns):
    def normal(text):
        kept = [c for c in unicodedata.normalize("NFKC", text or "") if c.isalnum() or c == "_" or c.isspace()]
        return "".join(kept).strip().lower()

    got = sorted((r.conv_id, r.turn, r.normal) for r in audit_queries.str_normalize_nfkc(spark, SF).collect())
    assert got == sorted((r.conv_id, r.turn, normal(r.text)) for r in turns)


def test_balanced_sample(spark, asked):
    """The same turns of types over all questions, not the head alone."""
    pools = {}
    for r in asked:
        if r["level"] == 1:
            pools.setdefault(r["query_type"], []).append(r["tile_id"])
    used, want = set(), []
    while len(want) < field_queries.WANTED:
        before = len(want)
        for kind in sorted(pools):
            fresh = min((t for t in pools[kind] if t not in used), default=None)
            if fresh is not None and len(want) < field_queries.WANTED:
                used.add(fresh)
                want.append((fresh, kind, len(want) + 1, False))
        if len(want) == before:
            break
    got = sorted(map(tuple, field_queries.smp_balanced(spark, SF).collect()), key=lambda r: r[2])
    assert len(want) == field_queries.WANTED and got == want


def test_paired_sample(spark, asked):
    """The same least-used choice over all pairs of questions."""
    by = {}
    for r in asked:
        if r["level"] < 3 or not r["trivial"]:
            by.setdefault(r["tile_id"], []).append(r)
    used, want = set(), []
    for x, y, quota in field_queries.COMPOSITION:
        pairs = [(a["query_type"], b["query_type"], t) for t, rows in by.items() for a in rows for b in rows if a["level"] == x and b["level"] == y and a["target"] != b["target"] and a["query_type"] != b["query_type"]]
        of_a, of_b = {}, {}
        for place in range(quota):
            free = [p for p in pairs if p[2] not in used]
            if not free:
                break
            a, b, t = min(free, key=lambda p: (of_a.get(p[0], 0), of_b.get(p[1], 0), p))
            used.add(t)
            of_a[a], of_b[b] = of_a.get(a, 0) + 1, of_b.get(b, 0) + 1
            want.append((f"L{x}_L{y}", place + 1, t, a, b))
    assert sorted(map(tuple, field_queries.smp_paired_greedy(spark, SF).collect())) == sorted(want)


def test_spectra(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "embedding").collect()
    got = {r.label: r for r in field_queries.vec_svd(spark, SF).collect()}
    assert set(got) == {r.label for r in rows}
    for label, r in got.items():
        x = np.array([v.embedding for v in rows if v.label == label], float)
        energy = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
        share = energy / energy.sum()
        full = np.zeros(x.shape[1])
        full[: len(share)] = share
        assert r.n == len(x) and math.isclose(r.total_energy, energy.sum(), rel_tol=1e-6, abs_tol=1e-3)
        assert all(math.isclose(v, full[:k].sum(), abs_tol=2e-6) for v, k in ((r.top1, 1), (r.top5, 5), (r.top10, 10)))
        assert math.isclose(r.effective_rank, math.exp(-(share * np.log(np.clip(share, 1e-12, None))).sum()), abs_tol=1e-3)
        assert r.rank90 == np.searchsorted(np.cumsum(full), 0.9) + 1
