import hashlib
import re

from pyspark.sql import functions as F

from sightline.llm import secret_scan
from tests.llm.conftest import passage

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ["assign", "access", "hex"]


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


TRICKY = [
    (1, "password: token=abcdefgh"),
    (2, "PaSsWord='12345678' api_key = x apikey:ABCDEFGHIJ"),
    (3, "ſecret=abcdefghij toKen=abcdefghij"),
    (4, "AKIAAKIA AKIA123456789012 AKIA12345678901"),
    (5, "é" * 5 + "deadbeef" * 4 + " " + "deadbeef" * 3 + "g"),
    (6, 'secret="Zx9Qw8Er7Ty6Ui5Op4As" and Zx9Qw8Er7Ty6Ui5Op4As again'),
    (7, None),
    (8, ""),
]


def test_base_spans(docs, edge, none, frame):
    for df in (docs, edge, frame(TRICKY)):
        got = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.find_secrets(df).collect())
        want = []
        for r in df.collect():
            spans = brute(r["text"] or "")
            want.append((str(r["doc_id"]), *(sum(s.startswith(k) for s in spans) for k in KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
        assert got == sorted(want)
    assert secret_scan.find_secrets(none).count() == 0


def test_ownership_separates_copies_from_live(frame, spark):
    shared, own = "9f86d081884c7d659a2feaa0c55ad015", "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    rows = [(i, f"{passage(i)} token = {shared}") for i in range(30)] + [(100, f"secret: {own}"), (101, "id Ab3dE5gH7jK9mN1pQ3sT5v end")]
    df = frame(rows)
    df = df.withColumn("source", F.concat(F.lit("s"), "doc_id"))
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(df).collect()}
    assert got[0]["n_copied"] == 2 and got[0]["n_live"] == 0
    assert got[100]["n_live"] == 2 and got[100]["n_copied"] == 0
    assert got[101]["spans"] == "bare:3:25"
    masked = {r["doc_id"]: r for r in secret_scan.mask_secrets(df).collect()}
    assert shared in masked[3]["text"] and own not in masked[100]["text"] and "Ab3d" not in masked[101]["text"]
    assert masked[100]["n_chars"] == len(masked[100]["text"]) and len(masked) == len(rows)


def test_mask_keeps_all_rows_and_columns(edge):
    out = secret_scan.mask_secrets(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert secret_scan.mask_spans("abcdef", [(1, 3), (2, 4)]) == "a[SECRET]ef"


def test_query_covers_whole_table(docs, none):
    assert secret_scan.mask_secrets(none).count() == 0
    assert secret_scan.find_secrets(docs).count() == docs.count()
