"""Pairs and nearest identities of vectors."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import identity


def some_vectors(n, dim=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim)).tolist()


def plain_counts(rows, digits):
    """Counts by comparing all pairs one by one."""
    out = {}
    for k, (a, who, v) in enumerate(rows):
        for b, other, w in rows[k + 1 :]:
            if a is not None and b is not None and a != b:
                kind = "genuine" if who is not None and who == other else "impostor"
                s = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), digits) + 0.0
                out[kind, s] = out.get((kind, s), 0) + 1
    return out


@pytest.mark.parametrize("digits", [3, 7])
def test_pairs_over_several_blocks_and_rows_without_identity(spark, monkeypatch, digits):
    monkeypatch.setattr(identity, "BLOCK", 20)
    monkeypatch.setattr(identity, "STRIP", 5)
    rows = [(None if k == 7 else k, None if k % 9 == 0 else k % 3, v) for k, v in enumerate(some_vectors(70))]
    df = spark.createDataFrame(rows, "id long, who long, v array<double>")
    got = {(r["kind"], r["s"]): r["n"] for r in identity.pair_counts(df, "id", "who", "v", digits).collect()}
    assert got == plain_counts(rows, digits)
    scores = identity.pair_scores(df, "id", "who", "v").collect()
    assert len({(r["a"], r["b"]) for r in scores}) == len(scores) == sum(got.values())
    assert all(r["a"] < r["b"] for r in scores)


def test_counting_two_blocks_takes_little_memory():
    """A block against a block held all its pairs, over two GB; now a strip of them."""
    left, right = (pd.DataFrame({"id": np.arange(identity.BLOCK) + at, "who": "x", "v": some_vectors(identity.BLOCK, 8, at)}) for at in (0, identity.BLOCK))
    tracemalloc.start()
    counts = identity.count_tiles(identity.pair_tiles(left, right, False), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts["n"].sum() == identity.BLOCK**2
    assert peak < 200 << 20


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_nearest_over_blocks_with_ties_by_number(spark, monkeypatch, broadcast):
    """Copies tie exactly, and go by their number, not its text: 9, 10, 100."""
    monkeypatch.setattr(identity, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(identity, "BLOCK", 16)
    monkeypatch.setattr(identity, "STRIP", 3)
    own = some_vectors(25)
    gallery = spark.createDataFrame([(k, k % 2, own[k % 25]) for k in range(125)], "id long, label long, v array<double>")
    probes = gallery.where("id < 25")
    got = {(r["id"], r["rank"]): (r["other"], round(r["score"], 9)) for r in identity.nearest(probes, gallery.select(F.col("id").alias("other"), "v"), "id", "other", "v", 4).collect()}
    assert got == {(k, n + 1): (k + 25 * n, 1.0) for k in range(25) for n in range(4)}
    unit = np.array(own) / np.linalg.norm(own, axis=1, keepdims=True)
    sims = unit @ unit.T
    some = gallery.where("id >= 25 and id < 50")
    best = {(r["id"], r["rank"]): (r["label"], round(r["score"], 9)) for r in identity.nearest(probes, some, "id", "label", "v").collect()}
    for k in range(25):
        most = sorted(((round(max(sims[k][(n - 25) % 25] for n in range(25, 50) if n % 2 == who), 9), who) for who in (0, 1)), reverse=True)
        assert [best[k, 1], best[k, 2]] == [(who, s) for s, who in most]


def test_an_identity_of_many_vectors_is_dealt_to_many_blocks(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("string").alias("identity"), F.array(F.rand(1), F.rand(2)).alias("gvec"))
    sizes = [r["count"] for r in identity.in_blocks(rows, 20).groupBy("b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200


def test_the_nearest_of_a_block_take_little_memory():
    probes = pd.DataFrame({"probe": np.arange(10_000).astype(str), "pvec": some_vectors(10_000)})
    block = pd.DataFrame({"identity": np.arange(identity.BLOCK).astype(str), "gvec": some_vectors(identity.BLOCK, seed=1)})
    tracemalloc.start()
    n = sum(len(part) for part in identity.best_of_block(probes, block, 5, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50_000 and peak < 100 << 20
