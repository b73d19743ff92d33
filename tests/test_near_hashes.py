import random
from itertools import combinations

import numpy as np
import pytest

from sightline.operators.datasets import duplicate_groups, keep_one, label_conflicts
from sightline.plans import near_hashes


def some(seed, families, each, bits=64, near=6):
    """Hashes in families whose members differ in a few bits; of the second hash, too."""
    rng, out = random.Random(seed), set()
    for _ in range(families):
        h, o = rng.getrandbits(bits), rng.getrandbits(64)
        for _ in range(each):
            x = h ^ sum(1 << k for k in rng.sample(range(bits), rng.randrange(near + 1)))
            out.add((x, o ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(12)))))
    return [(f"r{k}", h - (1 << 64) if h >> 63 else h, o - (1 << 64) if o >> 63 else o) for k, (h, o) in enumerate(sorted(out))]


def wanted(rows, differing, other, exact):
    off = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    shares = lambda x, y: any((x >> k) & 65535 == (y >> k) & 65535 for k in (0, 16, 32, 48))
    return {tuple(sorted((a, b))) for (a, h, o), (b, g, p) in combinations(rows, 2) if off(h, g) <= differing and off(o, p) <= other and (exact or shares(h, g))}


def connected(names, pairs):
    part = {n: n for n in names}
    for a, b in sorted(pairs) * 2:
        x, y = part[a], part[b]
        part = {n: min(x, y) if p in (x, y) else p for n, p in part.items()}
    return part


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("bound", [None, 6, 40])
def test_pairs_equal_brute_force_however_buckets_are_dealt(spark, exact, bound):
    rows = some(3, 12, 12) + [(f"s{n}", h & 65535 << 16, o) for n, (_, h, o) in enumerate(some(4, 30, 2))]  # many share three slices
    rows = list({(h, o): (i, h, o) for i, h, o in rows}.values())
    df = spark.createDataFrame(rows, "i string, h long, o long")
    got = [tuple(sorted(r)) for r in near_hashes.near_pairs(df, 5, 10, exact, bound=bound).collect()]
    want = wanted(rows, 5, 10, exact)
    assert set(got) == want
    forest = {tuple(sorted(r)) for r in near_hashes.near_pairs(df, 5, 10, exact, forest=True, bound=bound).collect()}
    names = [r[0] for r in rows]
    assert forest <= want and connected(names, forest) == connected(names, want)


def test_forest_is_no_larger_than_it_needs(monkeypatch):
    monkeypatch.setattr(near_hashes, "TILE", 16)
    h = np.arange(64, dtype=np.uint64)  # all within six bits
    pairs = [p for a, b in near_hashes.tiled_pairs(h, h, 6, 6, forest=True) for p in zip(a, b, strict=True)]
    assert len(pairs) == 63
    assert sum(len(a) for a, _ in near_hashes.tiled_pairs(h, h, 6, 6)) == 64 * 63 // 2


@pytest.mark.parametrize("bound", [None, 5])
def test_diameters(spark, monkeypatch, bound):
    monkeypatch.setattr(near_hashes, "GROUP_TILE", 4)
    rng = random.Random(9)
    rows = [(g, rng.getrandbits(64) - (1 << 63)) for g in range(6) for _ in range(rng.randrange(1, 60))] + [(7, -1), (7, 0), (8, 5), (8, 5)]
    got = dict(tuple(r) for r in near_hashes.diameters(spark.createDataFrame(rows, "g long, x long"), "g", "x", bound).collect())
    off = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert got == {g: max(off(x, y) for a, x in rows if a == g for b, y in rows if b == g) for g in {r[0] for r in rows}}


def test_groups_keep_conflicts_whole(spark):
    rows = [(1, "a.jpg", "val", 7, 1, "s1"), (2, "b.jpg", "train", 7, 1, "s1"), (3, "c.jpg", "train", 6, 1, "s2"), (4, "d.jpg", "test", 1 << 40, 1, "s3"), (5, "e.jpg", "test", 1 << 40, 1, "s3"), (6, "f.jpg", "test", 0x7F00FF00FF00FF00, 1, "s4"), (7, "g.jpg", "test", None, None, "s5")]
    images = spark.createDataFrame(rows, "image_id long, filename string, split string, dhash long, ahash long, sha string")
    groups = duplicate_groups(images)
    assert sorted(map(tuple, groups.collect())) == [(1, 1, "near", 4), (2, 1, "near", 4), (3, 1, "near", 4), (4, 1, "near", 4), (5, 1, "near", 4)]
    strict = duplicate_groups(images, threshold=0)
    assert sorted(map(tuple, strict.collect())) == [(1, 1, "exact", 0), (2, 1, "exact", 0), (4, 4, "exact", 0), (5, 4, "exact", 0)]
    ids = lambda df: sorted(r["image_id"] for r in df.select("image_id").collect())
    assert ids(keep_one(images, strict)) == [2, 3, 4, 6, 7]  # the training copy stays
    assert ids(keep_one(images, strict, keep="first")) == [1, 3, 4, 6, 7]
    signatures = spark.createDataFrame([(4, "0:1:1:1:1"), (5, "0:1:1:1:2"), (1, "x"), (2, "x")], "image_id long, signature string")
    whole = label_conflicts(images, strict, signatures)
    assert [r[0] for r in whole.collect()] == [4]
    assert ids(keep_one(images, strict, whole=whole)) == [2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        keep_one(images, strict, keep="whatever")
