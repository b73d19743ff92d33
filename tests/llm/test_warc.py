import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import types as T

from sightline.llm import warc

PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b/ x\n", None),
    (4, "http://c/", ""),
    (5, "http://d/", "é🙂\r\n\r\nWARC/1.1\r\n" * 50),
    (None, "http://e/", "<p>one</p>"),
    (7, "http://f/", "x" * 3_000_000),
    (8, "http://g/", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType())])
    return spark.createDataFrame([(*p, "d", "r") for p in PAGES], schema)


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        lead = first.get(html or "")
        again = page_id is not None and page_id != lead
        out.append((str(page_id), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=repr)


def test_round_trip(pages, spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (pages, given):
        rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
        got = sorted(((str(r["page_id"]), *tuple(r)[1:]) for r in warc.round_trip(df).collect()), key=repr)
        assert got == expected(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_members_and_index(pages):
    archives = warc.write_archives(pages)
    mono = {r["archive"]: bytes(r["data"]) for r in archives.collect()}
    for r in warc.normalise_archives(archives).collect():
        data, whole = bytes(r["data"]), gzip.decompress(mono[r["archive"]])
        assert gzip.decompress(data) == whole
        ends = 0
        for entry in r["index"]:
            assert entry["offset"] == ends
            ends += entry["length"]
            record = gzip.decompress(data[entry["offset"] : ends])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert ends == len(data)


def test_input_forms():
    record = warc.page_record(1, "http://a/", b"hello", None, "2020-01-01T00:00:00Z")
    other = warc.page_record(2, "http://b/", b"", 1, "2020-01-01T00:00:00Z")
    for raw in (record + other, gzip.compress(record + other), gzip.compress(record) + gzip.compress(other), b""):
        found = [gzip.decompress(m) for _, m in warc.normalise(io.BytesIO(raw))]
        assert found == ([record, other] if raw else [])
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(record[:-10]))))


def test_cut_archives_raise():
    record = warc.page_record(1, "http://a/", b"hello", None, "2020-01-01T00:00:00Z")
    other = warc.page_record(2, "http://b/", b"more", None, "2020-01-01T00:00:00Z")
    whole = gzip.compress(record + other)
    for raw in (record + other[:20], gzip.compress(record + other[:20]), whole[:-12], whole[: len(whole) // 2], whole + b"junk", gzip.compress(record) + whole[:30]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.normalise(io.BytesIO(raw)))
    assert len(list(warc.normalise(io.BytesIO(whole + b"\0" * 100)))) == 2


def test_files_and_sidecar(pages, tmp_path):
    normalised = warc.normalise_archives(warc.write_archives(pages))
    saved = {r["archive"]: r for r in warc.save(normalised, str(tmp_path)).collect()}
    assert sum(r["records"] for r in saved.values()) == len(PAGES)
    rows = 0
    for name, r in saved.items():
        data = (tmp_path / f"{name}.warc.gz").read_bytes()
        assert len(data) == r["bytes"]
        for line in (tmp_path / f"{name}.index.jsonl").read_text().splitlines():
            entry = json.loads(line)
            assert entry["record_id"].encode() in gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            rows += 1
    assert rows == warc.sidecar(normalised).count() == len(PAGES)
