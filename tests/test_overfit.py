"""The covering sample against a plain version, with short, empty and full buckets; equal images."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tilewright.operators import grids as G
from tilewright.plans import audit_queries, grid_queries
from tilewright.plans.shape_queries import shaped

SCHEMA = "tile_id long, level int, query_type string, target int, trivial boolean"


def plainly(rows, images):
    best = {}
    for a, b in itertools.permutations(rows, 2):
        if a[0] == b[0] and a[3] < b[3]:
            real = any(r[1] == 3 and not r[4] for r in (a, b))
            key = (not real, a[2] == b[2], f"{a[1]}-{a[2]}", f"{b[1]}-{b[2]}")
            best[a[0]] = min(best.get(a[0], (key, a, b)), (key, a, b))
    buckets = {3: [], 2: [], 1: []}
    for tile in sorted(best):
        key, a, b = best[tile]
        bucket = 3 if not key[0] else max(a[1], b[1])
        if bucket < 3 or not key[0]:
            buckets[bucket].append(tile)
    third = max(1, images // 3)
    chosen = []
    for more in (False, True):
        for bucket, quota in ((3, third), (2, third), (1, images - 2 * third)):
            found = buckets[bucket][quota:] if more else buckets[bucket][:quota]
            chosen += [(tile, bucket, more) for tile in found][: images - len(chosen)]
    return sorted((place, tile, bucket, more, f"{r[1]}-{r[2]}", r[3]) for place, (tile, bucket, more) in enumerate(chosen, 1) for r in best[tile][1:])


@pytest.mark.parametrize(("tiles", "levels", "images"), [(60, (1, 2, 3), 10), (30, (1,), 10), (12, (1, 1, 1, 1, 2), 10), (4, (1, 2, 3), 10), (200, (3,), 5), (90, (1, 2, 3), 1), (0, (1,), 3)])
def test_overfit_set(spark, tiles, levels, images):
    rng = random.Random(tiles * 31 + images)
    rows = []
    for tile in range(tiles):
        for k in range(rng.randrange(5)):
            level = rng.choice(levels)
            rows.append((tile * 7 % 101 * 1000 + tile, level, f"type{k}" if rng.random() < 0.6 else "same", rng.randrange(4), level == 3 and rng.random() < 0.5))
    unique = list({(r[0], r[1], r[2]): r for r in rows}.values())
    got = audit_queries.overfit_set(spark.createDataFrame(unique, SCHEMA), images).collect()
    assert sorted((r.place, r.tile_id, r.bucket, r.topped_up, r.sample, r.target) for r in got) == plainly(unique, images)
    assert len({r.place for r in got}) <= images


def test_reduced_means():
    rng = np.random.default_rng(5)
    grey = rng.integers(0, 256, (32, 32))
    small = bytes(int(grey[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].sum() / 16 + 0.5) for y in range(8) for x in range(8))
    digest, deviation = G.content_hash(grey, 8)
    assert digest == hashlib.sha256(small).hexdigest() and abs(deviation - np.std(list(small))) < 1e-12
    assert G.content_hash(np.zeros((64, 64), int), 64)[1] == 0


def test_planted_copies_are_found(spark):
    """Every copy is with its tile, and groups are those of equal images painted pixel by pixel."""
    sf = "/root/testdata/sf0.001"
    images = {}
    for r in sorted(shaped(spark, sf).collect(), key=lambda r: (r.tile_id, r.component_id)):
        image = images.setdefault(r.tile_id, np.zeros((512, 512), np.int64))
        part = np.ones((r.y1 - r.y0 + 1, r.x1 - r.x0 + 1), bool)
        part[max(r.uy0 - r.y0, 0) : r.uy1 - r.y0 + 1, max(r.ux0 - r.x0, 0) : r.ux1 - r.x0 + 1] = False
        image[r.y0 : r.y1 + 1, r.x0 : r.x1 + 1][part] = 50 + 37 * r.component_id % 206
    groups = {}
    for tile, image in images.items():
        sums = image.reshape(64, 8, 64, 8).sum((1, 3))
        small = np.floor(sums / 64 + 0.5).astype(np.uint8)
        for name in (tile, *([tile + grid_queries.COPIES] if tile % 20 == 0 else [])):
            groups.setdefault(hashlib.sha256(small.tobytes()).hexdigest(), []).append(name)
    split = lambda t: ("test", "val", "train", "train", "train")[t % 5]
    want = {(k, len(v), len({split(t) for t in v}), min(v)) for k, v in groups.items() if len(v) > 1}
    got = {(r.digest, r.n, r.n_splits, r.least_tile) for r in grid_queries.val_content_hash(spark, sf).collect()}
    assert got == want and len(got) > 10
