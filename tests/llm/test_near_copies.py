import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import near_copies, simhash
from tests.llm.conftest import passage


def shingles(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute_first(rows, least=0.8):
    """Least id of each row's group, by comparing all pairs of sets."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return sorted(ids.values()) + [None] * len({root(i) for i in range(len(rows))} - set(ids))


def edited_texts():
    """Texts of 8 to 400 words and chains of copies, each with one to many words changed, cut or added."""
    rng, out = random.Random(3), []
    for k in range(60):
        own = passage(k + 50, rng.choice([8, 12, 20, 40, 100, 400])).split()
        for _ in range(4):
            out.append(" ".join(own))
            for _ in range(rng.randint(1, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            own = own + ["more"] if rng.random() < 0.5 else own[1:]
    rng.shuffle(out)
    return list(enumerate(out))


def kept_ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stage_equals_brute_force_jaccard(spark, docs, edge, none, frame, sf_dir):
    for df in (frame(edited_texts()), docs, edge):
        got = corpus_pipeline.near_dedup(spark, df, sf_dir)
        assert got.columns == df.columns
        assert kept_ids(got) == brute_first([(r["doc_id"], r["text"]) for r in df.collect()])
    assert corpus_pipeline.near_dedup(spark, none, sf_dir).count() == 0


def test_stage_takes_what_lies_over_two_bits(spark, frame, sf_dir):
    own = passage(9, 300).split()
    other = [f"changed{k}" if k % 60 == 30 else w for k, w in enumerate(own)]
    texts = [" ".join(own), " ".join(other)]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 2
    assert kept_ids(corpus_pipeline.near_dedup(spark, frame(list(enumerate(texts))), sf_dir)) == [0]


def test_repeated_ids_equal_rows_and_nulls(frame):
    a, b, c = passage(1, 80), passage(2, 80), passage(3, 80)
    df = frame([(3, a), (7, a), (7, b), (3, a), (None, c), (None, c), (9, None), (9, ""), (8, "")])
    assert Counter((r["doc_id"], r["text"]) for r in near_copies.drop_near_copies(df).collect()) == Counter([(3, a), (7, b), (None, c), (8, "")])


def test_a_band_that_many_share_is_dealt_anew(frame, monkeypatch):
    """Copies that all share most of their text, and so many bands: the same groups with buckets of a few rows, and salted pairs."""
    from sightline.llm import near_copies
    from tests.llm.conftest import passage

    common = passage(77, 60)
    texts = [(k, f"{common} {passage(k // 3, 18)} tail{k % 3}") for k in range(60)] + [(100 + k, passage(900 + k, 40)) for k in range(5)]
    want = sorted(r["doc_id"] for r in near_copies.drop_near_copies(frame(texts)).collect())
    monkeypatch.setattr(near_copies, "BUCKET", 4)
    monkeypatch.setattr(near_copies, "MANY", 3)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(frame(texts)).collect()) == want
    with pytest.raises(ValueError):
        near_copies.drop_near_copies(frame(texts), least=0.5)


def test_fingerprints_link_texts_whatever_their_bands(spark, frame, sf_dir, monkeypatch):
    """Close copies are linked by their fingerprints, as in op5, where they share no band."""
    own = passage(9, 600).split()
    texts = [" ".join(own), " ".join([*own[:-1], "other"]), passage(10, 600)]
    fps = [near_copies.simhash_of(near_copies.shingles(t)) for t in texts]
    assert 0 <= ((fps[0] ^ fps[1]) % (1 << 64)).bit_count() <= 2 < ((fps[0] ^ fps[2]) % (1 << 64)).bit_count()
    sketched = near_copies._sketched
    monkeypatch.setattr(near_copies, "_sketched", lambda *a: sketched(*a).withColumn("bands", F.array().cast("array<bigint>")))
    assert kept_ids(corpus_pipeline.near_dedup(spark, frame(list(enumerate(texts))), sf_dir)) == [0, 2]


def test_first_pairs_are_verified_at_once(spark, frame, sf_dir, monkeypatch):
    """Pairs of fingerprints and of bands are one pass over the texts and one search for components."""
    runs, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda *a: runs.append(a) or verified(*a))
    own = passage(9, 600).split()
    texts = [" ".join(own), " ".join([*own[:-1], "other"]), " ".join(own[:560]), passage(10, 600)]
    assert kept_ids(corpus_pipeline.near_dedup(spark, frame(list(enumerate(texts))), sf_dir)) == [0, 3] and len(runs) == 1


def test_small_sets_may_differ_in_more_bits():
    """Fingerprints of four and five shingles, four of them the same, may be over 24 bits apart."""
    own = np.array([[1, 2], [1, 2], [4, 5], [0, (1 << 30) - 1]], dtype=np.int64)
    (_, _, _, may), = near_copies._tiles(own, 0.8)
    assert may.any()
    own[2] = [400, 500]
    (_, _, _, may), = near_copies._tiles(own, 0.8)
    assert not may.any()


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from sightline.llm import rows

    texts = ["x" * n for n in (0, 700_000, 300_000, 100_000, 5_000_000, 0, 3)] + [None] * 3_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(rows.slices(iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= rows.SLICE and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= rows.SLICE_BYTES) for p in parts)
