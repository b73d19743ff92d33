import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from sightline.llm import decontaminate, importance, secret_scan
from sightline.llm.byte_bpe import read_ranks
from tests.llm.conftest import EDGE, passage
from tests.llm.test_near_copies import brute_first


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "encode"]


def test_stages_take_effect(spark, docs, sf_dir):
    columns, rows = docs.columns, docs
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir).cache()
        assert rows.columns == columns
        kept.append(rows)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    selected = {r["doc_id"] for r in importance.resample(docs, labels).where("selected").collect()}
    assert ids[1] == selected and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert sorted(ids[2]) == brute_first([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    leaked = {r["doc_id"] for r in decontaminate.leaks(kept[2], bench).collect()}
    assert ids[3] == ids[2] - leaked
    before = {r["doc_id"]: (r["text"], r["source"]) for r in kept[3].collect()}
    owners, found = {}, {}
    for i, (text, source) in before.items():
        base = secret_scan.find_base(text, set(secret_scan.KINDS))
        found[i] = base + secret_scan.find_bare(text, base)
        for _, _, _, value in found[i]:
            owners.setdefault(value, set()).add(source)
    for r in kept[4].collect():
        cut = [(s, e) for s, k, e, v in found[r["doc_id"]] if len(owners[v]) < 5 and (k != "bare" or len(owners[v]) == 1)]
        assert r["text"] == secret_scan.mask_spans(before[r["doc_id"]][0], cut) and r["n_chars"] == len(r["text"])
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[4], sf_dir).collect():
        assert r["ids"] == reference.encode_ordinary(texts[r["doc_id"]])


def test_stages_on_edge_cases(spark, edge, none, frame, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without an id, clashing columns, and an empty table."""
    item = "how many of the two hundred green lamps in the long hall were lit when we came back from the old harbour"
    secret = "password = 'hunter2hunter2'"
    more = [(20, f"{passage(20)} {item} {passage(21)}"), (21, f"{passage(22)} {secret}"), (22, f"{passage(22)} {secret}"), (None, None), (None, None)]
    df = frame([*EDGE, *more]).withColumnRenamed("owner", "gone").withColumnRenamed("salt", "nth")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (21, 1, 0), (20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_dedup", "decontamination", "secrets"):
        out = stage[name](spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
        assert stage[name](spark, df, str(tmp_path)).columns == df.columns
    assert stage["encode"](spark, none, str(tmp_path)).count() == 0
    near = sorted(((r["doc_id"], r["text"]) for r in stage["near_dedup"](spark, df, str(tmp_path)).collect()), key=repr)
    want = brute_first([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted((i for i, _ in near), key=repr) == sorted(want, key=repr)
    clean = stage["decontamination"](spark, df, str(tmp_path))
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(map(repr, (r["doc_id"] for r in df.collect() if r["doc_id"] != 20)))
    texts = {r["doc_id"]: r["text"] for r in stage["secrets"](spark, df, str(tmp_path)).collect()}
    assert secret not in texts[21] and secret not in texts[22] and texts[1] is None and texts[2] == "" and texts[4] == passage(1)
    encoded = stage["encode"](spark, df, str(tmp_path)).collect()
    assert len(encoded) == df.count() and all(r["ids"] == [] for r in encoded if r["doc_id"] in (1, 2))
