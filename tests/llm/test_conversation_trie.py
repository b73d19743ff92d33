import hashlib
import random
import zlib

import pytest

from sightline.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, d string, piece string, k1 string, node string"


def plain(rows):
    """The contract, with a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        seq = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    below = {p: [] for p in members}
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = {p: sum(len(x) == len(p) + 1 for x in below[p]) for p in members}
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c, e in m if e)
        out.append((m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), kids[p], sum(not kids[x] for x in below[p]), sum(saved[x] for x in below[p]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, parts=4, batches=3):
    df = spark.createDataFrame([(*r, "d", "p", "k", "n") for r in rows], SCHEMA).repartition(parts)
    out = conversation_trie.prefix_trie(df, batches)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def talk(seed, n, longest=9, words=3):
    """Conversations that share beginnings of all lengths, some of them equal."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "hello", "grüß", "bye bye"][: words + 1])))
    return rows


@pytest.mark.parametrize(("seed", "longest", "batches"), [(1, 9, 3), (2, 30, 1), (3, 4, 6)])
def test_equals_plain(spark, seed, longest, batches):
    rows = talk(seed, 60, longest)
    assert got(spark, rows, batches=batches) == plain(rows)


def test_long_chains(spark):
    """Each conversation goes on where another ends, so edges are cut again and again; one is much longer than the others."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(12) for t in range(3 * c + 1)]
    rows += [(5 * c + 600, t, "user", f"turn {t}" if t < 2 * c else f"{c} {t}") for c in range(12) for t in range(2 * c + 3)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(150)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    """Nulls, turns without a number or with the same one, repeated rows, turnless conversations, negative and large ids."""
    rows = talk(4, 20) + [(None, 1, "user", "x"), (3, None, None, None), (3, None, "user", None), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "a", "user"), (4, 0, "auser", "")]
    rows += [(2**40 + k, 0, "user", "hello") for k in range(12)] + [(100 + k, k, "user", "x" * 5_000) for k in range(9)]
    assert got(spark, rows) == plain(rows)
    assert any(len(c) == 1 for c in [set(r[:1]) for r in rows])


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    only = [(next(c for c in range(1, 99, 5) if zlib.crc32(str(c).encode()) % 9 >= 1), 0, "user", "lost")]  # its base is absent
    assert got(spark, only) == plain(only) and len(plain(only)) == 1


def test_fattest_depths(spark):
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    out = spark.createDataFrame(pairs, "a long, b long").withColumn("f", conversation_trie._fattest(F.col("a"), F.col("b")))
    for r in out.collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 64)
    ends = [(1, 2, 3, c) for c in range(300)] + [(1, 2, 4, 7), (0, 0, 0, -5), (0, 0, 0, -4)]
    out = conversation_trie.id_lists(spark.createDataFrame(ends, "d long, k1 long, k2 long, conv long").repartition(5))
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {tuple(r) for r in out.collect()} == {(1, 2, 3, sha(range(300))), (1, 2, 4, sha([7])), (0, 0, 0, sha([-5, -4]))}


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversation_trie(spark, sf_dir).collect()), key=repr) == plain(rows)
