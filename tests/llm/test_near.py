import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sightline.llm import minhash, simhash
from tests.llm.conftest import passage


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(str(rows[i][0]), f"{fps[i]:016x}", min(least[root(i)], default=None)) for i in range(len(rows))]


def test_groups_equal_brute_force(docs, edge, none):
    for df in (docs, edge):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [(str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_groups(df).collect()]
        assert sorted(got, key=repr) == sorted(brute_groups(rows), key=repr)
    assert simhash.near_groups(none).count() == 0


def spanning_groups(fps, pairs):
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(int(a))] = root(int(b))
    groups = defaultdict(set)
    for f in parent:
        groups[root(f)].add(f)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("bound", [16_384, 8])
def test_links_with_hot_buckets(spark, monkeypatch, bound):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in r.choice(64, r.integers(1, 4), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "BUCKET", bound)
    got = [(np.uint64(a % (1 << 64)), np.uint64(b % (1 << 64))) for a, b in simhash.links(df).collect()]
    want = [(a, b) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2]
    assert all(int(a ^ b).bit_count() <= 2 for a, b in got)
    assert spanning_groups(fps, got) == spanning_groups(fps, want)
    a, b = simhash.tiled_links(fps, 2)
    assert spanning_groups(fps, zip(fps[a], fps[b], strict=True)) == spanning_groups(fps, want)


def test_drop_near_copies(edge, frame):
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for i, _, c in brute_groups([(r["doc_id"], r["text"]) for r in edge.collect()]) if i != "None"} - {None})
    assert kept.where("doc_id is null").count() == 1


def test_minhash_beside_next(docs, edge, none, frame):
    for df in (docs, edge, frame([(3, passage(1))])):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
        got = minhash.beside_next(df, target_rows=40).collect()
        assert len(got) == len(rows)
        if df is docs:
            by = {r["doc_id"]: r for r in got}
            for i, (doc_id, text) in enumerate(rows):
                following = rows[(i + 1) % len(rows)][1]
                n = len(text) // 3
                new = text[: len(text) - n] + following[:n]
                r = by[doc_id]
                assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
                assert r["fingerprint"] == minhash.fingerprint(text).hex() and r["edited_fingerprint"] == minhash.fingerprint(new).hex()
                assert r["near_next"] == minhash.likeness(minhash.fingerprint(text), minhash.fingerprint(following))
    assert minhash.beside_next(none).count() == 0


def test_minhash_estimates_jaccard():
    wrong = []
    for k in range(40):
        a, b = passage(k, 400).split(), passage(k + 1000, 400).split()
        cut = 10 * k
        x, y = " ".join(a), " ".join(a[:cut] + b[cut:])
        s, t = (set(minhash.shingle_hashes(v).tolist()) for v in (x, y))
        wrong.append(minhash.likeness(minhash.fingerprint(x), minhash.fingerprint(y)) - len(s & t) / len(s | t))
    assert abs(np.mean(wrong)) < 0.02 and np.std(wrong) < 0.06
    assert minhash.likeness(b"", b"") == 1.0 and minhash.likeness(b"", b"\x01") == 0.0
    short = minhash.fingerprint("one two")
    assert minhash.likeness(short, minhash.fingerprint("ONE  two")) == 1.0


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """256 hex digits: least shingle hash of each bin, empty bins from the first filled one they ask, 4 bits of each; by plain numbers."""
    words = text.encode().lower().split()
    if not words:
        return ""
    spread, size, bins = 0x9E3779B97F4A7C15, min(5, len(words)), {}
    for k in range(len(words) - size + 1):
        h = size
        for w in words[k : k + size]:
            h = mixed((h * spread + xxhash.xxh64_intdigest(w)) & M64)
        bins[h >> 56] = min(h, bins.get(h >> 56, M64))
    out = []
    for k in range(256):
        donor = k if k in bins else next((d for t in range(1, 513) if (d := mixed((((k << 32) + t) * spread) & M64) % 256) in bins), None)
        donor = sorted(bins)[k % len(bins)] if donor is None else donor
        out.append(f"{mixed(bins[donor]) & 15:x}")
    return "".join(out)


def plain_likeness(x, y):
    if not x or not y:
        return float(x == y)
    same = sum(a == b for a, b in zip(x, y, strict=True)) / 256
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def test_minhash_equals_plain_numbers(docs, edge, frame):
    """Every column by brute force, with ties, nulls and rows without an id in the order that is documented."""
    ties = frame([(3, "a b c d e f g"), (3, "a b c d e f g"), (3, None), (None, "x y z"), (None, None), (1, "word " * 9), (2, "")])
    for df in (docs, edge, ties):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        tie = lambda t: -(h - (1 << 64) if (h := xxhash.xxh64_intdigest(t.encode(), 42)) >> 63 else h)
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
        want = []
        for k, (doc_id, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            n = len(text) // 3
            new = text[: len(text) - n] + after[:n]
            own, other, of_next = plain_fingerprint(text), plain_fingerprint(new), plain_fingerprint(after)
            want.append((str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, round(plain_likeness(own, other), 9), round(plain_likeness(own, of_next), 9)))
        got = [(str(r["doc_id"]), *tuple(r)[1:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in minhash.beside_next(df, target_rows=3 if df is not docs else 40).collect()]
        assert sorted(got) == sorted(want)
