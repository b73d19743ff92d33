"""Detection tables derived from the given tables, written once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_W, FRAME_H = 1024, 768

VIEWS = {
    "detections": """
        select cast(floor(event_id / 20) as bigint) image_id, event_id det_id,
          case event_type when 'click' then 'contactor' when 'error' then 'overload_relay' when 'purchase' then 'mcb'
            when 'signup' then 'terminal_block' else 'plc' end class_id,
          case when event_id % 20 < 10 then 'm0' else 'm1' end source,
          cast((event_id % 10) % 5 * 180 + (event_id * 7) % 25 as double) x1,
          cast(floor((event_id % 10) / 5) * 300 + (event_id * 11) % 25 as double) y1,
          cast((event_id % 10) % 5 * 180 + (event_id * 7) % 25 + 90 + (event_id * 13) % 40 as double) x2,
          cast(floor((event_id % 10) / 5) * 300 + (event_id * 11) % 25 + 110 + (event_id * 17) % 50 as double) y2,
          cast(500 + (event_id * 7919) % 9500 as double) / 10000 score
        from {events}""",
    "ground_truth": """
        select cast(floor(event_id / 20) as bigint) image_id, event_id gt_id,
          case event_type when 'click' then 'contactor' when 'error' then 'overload_relay' when 'purchase' then 'mcb'
            when 'signup' then 'terminal_block' else 'plc' end class_id,
          cast((event_id % 10) % 5 * 180 + 10 as double) x1, cast(floor((event_id % 10) / 5) * 300 + 10 as double) y1,
          cast((event_id % 10) % 5 * 180 + 120 as double) x2, cast(floor((event_id % 10) / 5) * 300 + 145 as double) y2
        from {events} where event_id % 20 < 10""",
    # candidates as a detector might emit them: some boxes inverted, out of the frame, tiny, or with bad scores
    "candidates": """
        select image_id, det_id, class_id, source,
          case when det_id % 31 = 0 then x2 when det_id % 37 = 0 then x1 - 300 else x1 end x1, y1,
          case when det_id % 31 = 0 then x1 when det_id % 41 = 0 then x1 + 2 when det_id % 43 = 0 then x2 + 700 else x2 end x2,
          case when det_id % 47 = 0 then cast('NaN' as double) when det_id % 53 = 0 then y2 + 500 else y2 end y2,
          case when det_id % 59 = 0 then -0.5 when det_id % 61 = 0 then 1.5 else score end score
        from detections""",
    "class_dim": """
        select * from (values ('contactor', 'control', 0.45, 2.2, 0.002, 0.08, 0.40, true, 1), ('overload_relay', 'protection', 0.4, 2.4, 0.001, 0.06, 0.40, true, 2),
          ('mcb', 'protection', 0.12, 1.6, 0.0004, 0.015, 0.40, true, 3), ('terminal_block', 'wiring', 0.8, 40.0, 0.0005, 0.3, 0.30, false, 4),
          ('plc', 'automation', 0.3, 4.0, 0.005, 0.35, 0.40, true, 5))
          as t(class_id, category, ar_lo, ar_hi, area_lo, area_hi, min_conf, countable, ordinal)""",
    # panels of different sizes: some boxes of a frame belong to a second panel
    "panel_boxes": """
        select case when det_id % 20 < 4 + image_id % 16 then image_id else image_id + 1000000000 end image_id, det_id, class_id, source, x1, y1, x2, y2, score
        from detections""",
    "sightings": """
        select user_id, event_id, event_type, value, cast(epoch_s as bigint) t
        from (select *, {epoch_s} epoch_s from {events}) e""",
    "vectors": "select vec_id, embedding, cast(label as bigint) label from {embeddings}",
}
#: Brightness of a stretch of text: its letters weighed; a text is 61 stretches of equal length, whole.
_LETTERS = {"a": 5, "d": 11, "e": 3, "i": 7, "l": 13, "n": 6, "o": 9, "r": 4, "s": 10, "t": 8, "u": 12}
_LUMA = " + ".join(f"{w} * (length(x) - length(replace(x, '{c}', '')))" for c, w in _LETTERS.items())
_BITS = " + ".join(f"case when {{at}}(luma, {k + 1}) > {{at}}(luma, {k + 2}) then {1 << k} else 0 end" for k in range(60))
#: All stretches of a text, as DuckDB takes them; in Spark that cost 90 passes over a text, ``luma`` takes one.
_STRETCHES = f"""(select doc_id, source, sha, {{map_open}}parts{{map_arrow}} {_LUMA}) luma
            from (select doc_id, source, sha256(text) sha, {{range_open}} substr(text, 1 + cast(floor(k * length(text) / 61) as int), cast(floor((k + 1) * length(text) / 61) - floor(k * length(text) / 61) as int))) parts from {{documents}}) d) e"""
_STRETCHED = "(select doc_id, source, sha256(text) sha, luma from {documents}) e"
_LEVELS = " + ".join(f"case when 61 * {{at}}(luma, {k + 1}) > total then {1 << k} else 0 end" for k in range(60))
VIEWS |= {
    # documents as images: gradient and level hashes of the text's stretches stand for those of pixels
    "images": f"""
        select doc_id image_id, source, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'val' else 'test' end split,
          concat('Panel', cast(doc_id % 89 as varchar(20)), case when doc_id % 3 = 0 then '_rot90' when doc_id % 3 = 1 then '' else '-flip' end, '_', cast(doc_id % 7 as varchar(20)),
            case when doc_id % 5 = 0 then '_jpg.rf.0123456789abcdef' else '' end, '.jpg') filename,
          cast({_BITS} as bigint) dhash, cast({_LEVELS} as bigint) ahash, sha
        from (select doc_id, source, luma, {{sum}} total, sha
          from {_STRETCHES}) f""",
    # annotation lines of the ground truth, some of them broken
    "label_lines": """
        select image_id, gt_id, class_no, case when gt_id % 97 = 1 then concat(cast(class_no as varchar(20)), ' 0.5 0.5') when gt_id % 97 = 2 then concat(cast(class_no as varchar(20)), ' a 0.5 0.1 0.1')
            when gt_id % 97 = 3 then '77 0.5 0.5 0.1 0.1' when gt_id % 97 = 4 then concat(cast(class_no as varchar(20)), ' 1.5 0.5 0.1 0.1') when gt_id % 97 = 5 then concat(cast(class_no as varchar(20)), ' 0.5 0.5 0 0.1')
            when gt_id % 97 = 6 then concat(cast(class_no as varchar(20)), ' 0.5 0.5 1.5 0.1') when gt_id % 97 = 7 then concat(cast(class_no as varchar(20)), ' 0.5 0.5 0.97 0.99') when gt_id % 97 = 8 then concat(cast(class_no as varchar(20)), ' 0.02 0.5 0.3 0.1')
            when gt_id % 97 = 9 then concat(cast(class_no as varchar(20)), ' 0.5 0.5 0.001 0.001')
            else concat(cast(class_no as varchar(20)), '  0.', cast(100 + gt_id % 700 as varchar(20)), ' 0.', cast(100 + gt_id % 800 as varchar(20)), ' 0.1', cast(gt_id % 10 as varchar(20)), ' 0.15') end line
        from (select image_id, gt_id, case class_id when 'contactor' then 0 when 'overload_relay' then 1 when 'mcb' then 2 when 'terminal_block' then 3 else 4 end class_no from ground_truth) g""",
    "image_stats": """
        select event_id image_id, 200 + event_id % 900 w, 150 + event_id % 700 h, cast(event_id % 256 as double) luma_mean, cast(event_id % 60 as double) luma_std,
          cast(event_id % 100 as double) / 200 clipped_frac, cast(event_id % 400 as double) laplacian_var
        from {events}""",
}
#: Views that others read.
NEEDS = {"panel_boxes": ["detections"], "candidates": ["detections"], "label_lines": ["ground_truth"]}
#: What the two engines write differently.
SPARK_WORDS = {"at": "element_at", "sum": "aggregate(luma, 0L, (a, v) -> a + v)", "map_open": "transform(", "map_arrow": ", x ->", "range_open": "transform(sequence(0, 60), k ->"}
DUCK_WORDS = {"at": "list_extract", "sum": "list_sum(luma)", "map_open": "list_transform(", "map_arrow": ", lambda x:", "range_open": "list_transform(range(0, 61), lambda k:"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Weights by code point; all from 127 on have none.
_WEIGHTS = np.array([_LETTERS.get(chr(c), 0) for c in range(128)])


def luma(texts: pa.Array) -> pa.Array:
    """Brightness of the 61 stretches of each text; null for a null text."""
    out: list[np.ndarray | None] = []
    for at in range(0, len(texts), 256):
        for text in texts.slice(at, 256).to_pylist():
            if text is None:
                out.append(None)
                continue
            codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 127)
            upto = np.concatenate([[0], np.cumsum(_WEIGHTS[codes])])
            out.append(np.diff(upto[np.floor(np.arange(62) * len(codes) / 61).astype(np.int64)]))
    return pa.array(out, pa.list_(pa.int64()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the tables that it reads are opened."""
    text = VIEWS[name].replace(_STRETCHES, _STRETCHED).replace("{epoch_s}", "unix_seconds(cast(ts as timestamp))")
    text = text.replace("sha256(text)", "sha2(text, 256)")
    for word, own in SPARK_WORDS.items():
        text = text.replace(f"{{{word}}}", own)
    for other in NEEDS.get(name, []):
        text = re.sub(rf"\bfrom {other}\b", f"from {{{other}}}", text)
    found = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in re.findall(r"\{(\w+)\}", text)}
    if name == "images":  # hashes of a text cost far more than to deal it out, and the file is one split
        found["documents"] = found["documents"].repartition("doc_id").withColumn("luma", F.arrow_udf(luma, "array<bigint>")("text"))
    return spark.sql(text, **found)


def oracle(sql: str, *views: str) -> str:
    """DuckDB statement: ``sql`` with the named views, those it names itself, and those they need, in front."""
    names: list[str] = []
    plain = lambda t: re.sub(r"[{}]", "", reduce(lambda x, w: x.replace(f"{{{w[0]}}}", w[1]), DUCK_WORDS.items(), t.replace("{epoch_s}", "floor(epoch(ts))")))
    for v in [*views, *(v for v in VIEWS if re.search(rf"\b{v}\b", sql))]:
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    text = [f"{n} as ({plain(VIEWS[n])})" for n in names]
    body = sql.strip()
    rest = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I)
    if rest != body:
        return f"with recursive {', '.join([*text, rest])}"
    return f"with recursive {', '.join(text)} {body}" if text else body
