import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score string, id string"


def plain(rows, n_pos=5, n_neg=5, low=80, high=100):
    """Brute force over all pairs, by the contract."""
    last = lambda i: (i is None, i or 0)
    fit = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, i, label, v in fit:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for n, j, m, w in fit if n != k and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for p, pid, _ in [x for x in scored if x[2] == label][:n_pos]:
            good = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p]
            out += [(i, pid, r, nid, p, s) for r, (s, nid, _) in enumerate(good[:n_neg], 1)]
    return sorted(out, key=repr)


def got(spark, rows, parts=5, **options):
    df = spark.createDataFrame([(*r, "a", "s", "i") for r in rows], SCHEMA).repartition(parts)
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def clustered(seed, n, labels, dims=6):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        near = [1.0] * dims if rng.random() < 0.7 else [rng.choice([-1.0, 1.0]) for _ in range(dims)]
        out.append((k * 20, [x + rng.choice([-0.25, -0.125, 0.0, 0.125]) for x in near], rng.randrange(labels)))
    return out


@pytest.mark.parametrize("labels", [1, 2, 10])
def test_equals_plain(spark, labels):
    rows = clustered(labels, 150, labels)
    assert got(spark, rows) == plain(rows)
    assert labels == 1 or plain(rows)


def test_odd_rows(spark):
    """Nulls, other lengths, ties, repeated rows and anchors, empty vectors and very large numbers."""
    rows = clustered(7, 80, 3) * 2 + [(100, None, 1), (200, [1.0] * 6, None), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (None, [1.0] * 6, 2)]
    rows += [(600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (602, [1.0, 2.0], 2), (700, [], 1), (701, [], 1), (702, [], 2), (800, [0.0] * 6, 1), (900, [-1.0] * 6, 2)]
    assert got(spark, rows) == plain(rows)
    large = [(100 * k, [2.0**22 + 2.0**k, 3.0, 2.0**22], k % 2) for k in range(4)]
    assert got(spark, large) == plain(large)


def test_many_blocks_and_waiting_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = clustered(3, 200, 4)
    assert got(spark, rows, positives=3, negatives=2, low=50, high=120) == plain(rows, 3, 2, 50, 120)


def test_best_keeps_all_that_matters(monkeypatch):
    monkeypatch.setattr(hard_negatives, "WAITING", 10)
    rng, best, every = np.random.default_rng(5), hard_negatives.Best(4, 3), []
    for n in range(40):
        group, score = rng.integers(0, 4, 9), rng.integers(-5, 5, 9)
        ids = np.arange(9) + 9 * (39 - n)
        best.put(group, score, ids)
        every += zip(group.tolist(), score.tolist(), ids.tolist(), strict=True)
    want = [x for g in range(4) for x in sorted((x for x in every if x[0] == g), key=lambda x: (-x[1], x[2]))[:3]]
    assert list(zip(*(x.tolist() for x in best.cut()), strict=True)) == want


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchor
    assert got(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert hard_negatives.inner_products(np.array([[1e300]]), np.array([[1e300]])).tolist() == [[2**63 - 1]]


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in queries.op11_hard_negatives(spark, sf_dir).collect()), key=repr) == plain(rows) != []
