"""Readers, writers and scorers: each query writes what it derives from the tables to the scratch folder and reads it back."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import events as ev
from sightline.operators import scorers
from sightline.plans.lineage import scratch_path
from sightline.registry import query
from sightline.sources import files
from sightline.views import table, view

LINE = "'0 ' || printf('%.6f', (x1 + x2) / 2048) || ' ' || printf('%.6f', (y1 + y2) / 1536) || ' ' || printf('%.6f', (x2 - x1) / 1024) || ' ' || printf('%.6f', (y2 - y1) / 768)"
SPLIT = "case when image_id % 5 = 0 then 'val' else 'train' end"


@query("select event_id, event_type, case when event_type = 'click' then 1 else 0 end version from events where event_type <> 'click' or event_id % 2 = 0")
def s6_replace_partition(spark: SparkSession, d: str) -> DataFrame:
    """All events by type, then those of one type replaced by a newer, smaller set."""
    e, path = table(spark, d, "events").select("event_id", "event_type", F.lit(0).alias("version")), scratch_path(spark, "replace")
    ev.replace_partition(e, path, "event_type")
    ev.replace_partition(e.where("event_type = 'click' and event_id % 2 = 0").withColumn("version", F.lit(1)), path, "event_type")
    return spark.read.parquet(path).select("event_id", "event_type", "version")


@query(f"select {SPLIT} split, i.image_id::varchar stem, coalesce(t, '') label_text from (select distinct image_id from detections) i left join (select image_id, string_agg({LINE}, chr(10) order by {LINE}) t from ground_truth where image_id % 3 > 0 group by 1) using (image_id)", "detections", "ground_truth")
def s9_label_files(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split")
    cx, cy, w, h = g.normalised(g.box(), 1024, 768)
    labels = view(spark, d, "ground_truth").where("image_id % 3 > 0").select(split, F.col("image_id").cast("string").alias("stem"), F.lit(0).alias("cls"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    images = view(spark, d, "detections").select(split, F.col("image_id").cast("string").alias("stem"))
    path = scratch_path(spark, "labels")
    files.write_label_table(labels, images, path)
    return spark.read.schema("split string, stem string, label_text string").parquet(path)


PATHS = "select page_id, case page_id % 5 when 0 then 'd/images/train/' || page_id || '.JPG' when 1 then 'd/valid/images/' || page_id || '.png' when 2 then 'd/Test/' || page_id || '.jpeg' when 3 then 'd/labels/train/' || page_id || '.txt' else 'd/other/class' || page_id % 3 || '/' || page_id || '.webp' end path, length(html) length from pages"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PATHS.replace("from pages", "from {p}"), p=table(spark, d, "pages")).withColumn("modificationTime", F.lit(None).cast("timestamp"))


@query(f"with p as ({PATHS}) select path, case page_id % 5 when 0 then 'train' when 1 then 'val' when 2 then 'test' end split, page_id::varchar stem, split_part(path, '/', -2) folder, length bytes from p where page_id % 5 <> 3")
def s10_image_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.image_rows(_listing(spark, d)).select("path", "split", "stem", "folder", F.col("bytes").cast("long").alias("bytes"))


@query(f"with p as ({PATHS}) select split_part(path, '/', -2) class_id, count(*) n from p where page_id % 5 <> 3 group by 1")
def s15_class_folders(spark: SparkSession, d: str) -> DataFrame:
    return files.per_class_folders(files.image_rows(_listing(spark, d)))


@query("select image_id, det_id annotation_id, case when class_id <> 'plc' then class_id end class_id, round(x1, 6) x1, round(y1, 6) y1, round(x2, 6) x2, round(y2, 6) y2 from detections", "detections")
def s12_coco(spark: SparkSession, d: str) -> DataFrame:
    """Annotation files of some frames each, with a category that they don't name."""
    rows = view(spark, d, "detections")
    known = F.when(F.col("class_id") == "contactor", 1).when(F.col("class_id") == "overload_relay", 2).when(F.col("class_id") == "mcb", 3).when(F.col("class_id") == "terminal_block", 4).otherwise(99)
    note = F.struct(F.col("det_id").alias("id"), "image_id", known.alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    categories = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(c).alias("name")) for k, c in ((1, "contactor"), (2, "overload_relay"), (3, "mcb"), (4, "terminal_block"))])
    docs = rows.groupBy(F.floor(F.col("image_id") / 50).alias("file")).agg(F.collect_list(note).alias("annotations")).withColumn("categories", categories)
    path = scratch_path(spark, "coco")
    docs.write.partitionBy("file").json(path)
    out = files.read_coco(spark, f"{path}/file=*")
    return out.select("image_id", "annotation_id", "class_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("select image_id || '.jpg' filename, class_id, round(x1, 6) x1, round(y2, 6) y2 from detections", "detections")
def s13_voc(spark: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    docs = view(spark, d, "detections").groupBy(F.concat("image_id", F.lit(".jpg")).alias("filename")).agg(F.collect_list(F.struct(F.col("class_id").alias("name"), box.alias("bndbox"))).alias("object"))
    path = scratch_path(spark, "voc")
    docs.write.format("xml").option("rowTag", "annotation").save(path)
    return files.read_voc(spark, path).select("filename", "class_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"))


@query("select row_number() over (order by p_type) - 1 cls, p_type class_id from (select distinct p_type from part)")
def s14_class_map(spark: SparkSession, d: str) -> DataFrame:
    """The types of parts as the side file of a data set, written and read back."""
    names = sorted(r[0] for r in table(spark, d, "part").select("p_type").distinct().collect())
    path = scratch_path(spark, "yaml")
    lines = ["path: .", "names:", *(f"  {k}: '{c}'" for k, c in enumerate(names))]
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    return files.read_class_map(spark, path).select(F.col("cls").cast("long").alias("cls"), "class_id")


@query("select event_id::double epoch, round(value, 6) map_50, null::double loss from events where event_id % 7 <> 3")
def s16_curves(spark: SparkSession, d: str) -> DataFrame:
    """A log whose column has another name, with ragged rows and words among the numbers."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    line = F.when(i % 7 == 3, F.concat_ws(",", i, F.round("value", 6), F.lit("9"), F.lit("9"))).otherwise(F.concat_ws(", ", i, F.round("value", 6)))
    path = scratch_path(spark, "curves")
    rows = e.select(line.alias("value")).repartition(4)
    rows.write.text(path)
    return files.read_curves(spark, path, {"epoch": [], "map_50": ["metrics/mAP50(B)"], "loss": ["train/loss"]}, ["epoch", "metrics/mAP50(B)"])


@query("select image_id::varchar image_id, det_id::varchar det_id, class_id, 'say \"' || class_id || '\", x' ocr from detections", "detections")
def s17_component_table(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").withColumn("ocr", F.concat(F.lit('say "'), "class_id", F.lit('", x')))
    path, columns = scratch_path(spark, "components"), ["image_id", "det_id", "class_id", "ocr"]
    files.write_components_csv(rows, path, columns)
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query("select event_type, count(*) n, avg(case when event_id % 2 = 0 and event_type <> 'view' then value end) is null absent, count(*) filter (where value < 0) zero from events group by 1")
def s19_json_report(spark: SparkSession, d: str) -> DataFrame:
    """A metric that was never measured is null in the file, a count of nothing is 0."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.when((F.col("event_id") % 2 == 0) & (F.col("event_type") != "view"), F.col("value"))).alias("mean"), F.count_if(F.col("value") < 0).alias("zero"))
    path = scratch_path(spark, "json")
    files.write_json_report(e, path)
    text = spark.read.text(path)
    return text.select(F.get_json_object("value", "$.event_type").alias("event_type"), F.get_json_object("value", "$.n").cast("long").alias("n"), F.col("value").contains('"mean":null').alias("absent"), F.get_json_object("value", "$.zero").cast("long").alias("zero"))


def _lengths(rows: pd.DataFrame) -> pd.DataFrame:
    if (rows["text"].str.len() % 5 == 3).any():
        raise ValueError("not such a text")
    return pd.DataFrame({"doc_id": rows["doc_id"], "score": rows["text"].str.len() * 0.5})


@query("select doc_id, length(text) * 0.5::double score from documents where length(text) % 5 <> 3")
def x3_batched_scores(spark: SparkSession, d: str) -> DataFrame:
    """Texts scored in batches; a batch with a text that can't be scored falls back to single rows, and that text has none."""
    empty = pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    scorers.register_scorer("quality", "half_length", scorers.one_by_one_on_failure(_lengths, "doc_id", empty), "doc_id long, score double")
    return scorers.score(table(spark, d, "documents").select("doc_id", "text"), "quality", "half_length")


@query("select doc_id, [length(text), length(replace(text, 'e', ''))] vec from documents")
def x4_embed(spark: SparkSession, d: str) -> DataFrame:
    """A function on series as the embedding of each text: its length, and that without one letter."""
    vec = scorers.embed(F.col("text"), lambda s: s.map(lambda t: [float(len(t)), float(len(t.replace("e", "")))]))
    return table(spark, d, "documents").select("doc_id", F.transform(vec, lambda x: x.cast("long")).alias("vec"))


@query("select doc_id, task, case task when 'length' then length(text) else length(text) - length(replace(text, 'a', '')) end n from documents, (values ('length'), ('letters')) t(task)")
def x1_registered_scorers(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks, each by the scorer that is registered for it."""
    def counter(letter: str | None) -> scorers.Scorer:
        def run(parts):
            for rows in parts:
                yield pd.DataFrame({"doc_id": rows["doc_id"], "n": rows["text"].str.count(letter) if letter else rows["text"].str.len()})

        return run

    docs, out = table(spark, d, "documents").select("doc_id", "text"), None
    for task, letter in (("length", None), ("letters", "a")):
        scorers.register_scorer(task, "count", counter(letter), "doc_id long, n long")
    for task, name in [s for s in scorers.scorers() if s[1] == "count"]:
        own = scorers.score(docs, task, name).withColumn("task", F.lit(task))
        out = own if out is None else out.unionByName(own)
    return out
