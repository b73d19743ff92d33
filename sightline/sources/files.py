"""Readers and writers of label files, annotations and reports; all through Spark's own file sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.datasets import label_rows

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
#: Split names and what else they are called.
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def _path() -> Column:
    return F.col("_metadata.file_path")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def split_of(path: Column) -> Column:
    """Split that a path names, in any layout: images/<split>/x, <split>/images/x or <split>/x; null if none."""
    names = F.transform(F.split(F.lower(path), "/"), lambda p: F.try_element_at(F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv]), p))
    return F.try_element_at(F.array_compact(names), F.lit(-1))


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """split, stem, line, n_fields, cls, cx, cy, w, h: rows of text label files; rows of under five fields or without numbers go.

    A file is cut into lines by Spark, so its size doesn't matter; line numbers aren't kept, boxes have their own order.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    rows = lines.select(split_of(_path()).alias("split"), stem(_path()).alias("stem"), F.col("value").alias("line"))
    parsed = label_rows(rows)
    return parsed.where("n_fields >= 5 and cls is not null and cx is not null and cy is not null and w is not null and h is not null")


def write_label_table(labels: DataFrame, images: DataFrame, path: str) -> None:
    """Parquet of (split, stem, label_text): one row an image, an empty text for images without boxes, partitioned by split."""
    line = F.concat_ws(" ", F.col("cls"), *[F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")])
    text = labels.withColumn("__l", line).groupBy("split", "stem").agg(F.array_join(F.array_sort(F.collect_list("__l")), "\n").alias("label_text"))
    images.select("split", "stem").distinct().join(text, ["split", "stem"], "left").fillna("", ["label_text"]).write.mode("overwrite").partitionBy("split").parquet(path)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """path, split, stem, folder, bytes, modified of image files; contents are not read."""
    return image_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def image_rows(files: DataFrame) -> DataFrame:
    """The rows of image files among ``files`` (path, length, modificationTime), with their split, stem and folder."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*IMAGE_SUFFIXES)).select("path", split_of(F.col("path")).alias("split"), stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha: SHA-256 of each file's content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"))


def per_class_folders(images: DataFrame) -> DataFrame:
    """class_id, n of a folder-per-class image set."""
    return images.groupBy(F.col("folder").alias("class_id")).agg(F.count("*").alias("n"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """image_id, annotation_id, class_id, x1, y1, x2, y2 of annotation JSON; an unknown category gives a null class."""
    doc = spark.read.option("multiLine", "true").json(path)
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("class_id")).distinct()
    b = F.col("bbox")
    return notes.join(names, "category_id", "left").select("image_id", F.col("id").alias("annotation_id"), "class_id", b[0].cast("double").alias("x1"), b[1].cast("double").alias("y1"), (b[0] + b[2]).cast("double").alias("x2"), (b[1] + b[3]).cast("double").alias("y2"))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """filename, class_id, x1, y1, x2, y2 of annotation XML, one file an image."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(f"filename string, object array<struct<name:string,bndbox:{box}>>").load(path)
    return doc.select("filename", F.explode("object").alias("o")).select("filename", F.col("o.name").alias("class_id"), F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"))


def class_map(spark: SparkSession, names: Mapping[int, str] | Sequence[str]) -> DataFrame:
    """cls, class_id of a label space given as a list or by index (as a data set's side file holds it)."""
    pairs = sorted((int(k), v) for k, v in names.items()) if isinstance(names, Mapping) else list(enumerate(names))
    return spark.createDataFrame([(k, str(v)) for k, v in pairs], "cls int, class_id string")


#: Classes of a label space.
MOST_CLASSES = 100_000


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """cls, class_id of the ``names`` in a data set's YAML side file, a list or a mapping by index; a bounded file."""
    import yaml

    text = spark.read.text(path, wholetext=True).where("length(value) > 0").first()[0]
    names = yaml.safe_load(text)["names"]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return class_map(spark, names)


def read_curves(spark: SparkSession, path: str, names: Mapping[str, Sequence[str]], columns: Sequence[str] | None = None) -> DataFrame:
    """A training log in CSV, its columns under the names given, each from the first alias that it has; ragged rows go.

    ``columns``: the names of the columns where the files have no head.
    """
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)) if columns else spark.read.option("header", "true")
    raw = reader.option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("mode", "DROPMALFORMED").csv(path)
    have = {c.strip(): c for c in raw.columns}
    found = lambda aliases: next((F.col(f"`{have[a]}`") for a in aliases if a in have), F.lit(None))
    return raw.select(*[found([k, *aliases]).try_cast("double").alias(k) for k, aliases in names.items()])


def write_components_csv(findings: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV row a component, columns in the order given, text quoted."""
    findings.select(*columns).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def summary_sections(sections: Mapping[str, DataFrame], key: str = "key", value: str = "value", detail: str = "detail") -> DataFrame:
    """section, key, value, detail: several small tables as one report."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), (F.col(detail).cast("string") if detail in df.columns else F.lit(None).cast("string")).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def write_json_report(df: DataFrame, path: str) -> None:
    """JSON lines in which what is absent is null, not left out and not zero."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """image, manifest: the boxes of each image as JSON."""
    cols = [c for c in boxes.columns if c != image]
    return boxes.groupBy(image).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("manifest"))


def sidecar_boxes(labels: DataFrame, sidecar: DataFrame, image: str = "image_id") -> DataFrame:
    """image, box_index, box: boxes of a sidecar (array ``boxes``), numbered on after the labelled ones."""
    n = labels.groupBy(image).agg(F.count("*").alias("n"))
    return sidecar.join(n, image, "left").select(image, F.coalesce("n", F.lit(0)).alias("n"), F.posexplode("boxes").alias("pos", "box")).select(image, (F.col("n") + F.col("pos")).cast("int").alias("box_index"), "box")


def detect_kind(paths: DataFrame, path: str = "path", *by: str) -> DataFrame:
    """kind of each data set, from the paths of its files: yolo, coco, voc, classification, images or unknown."""
    p = F.lower(path)
    image = p.rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")
    has = {
        "yaml": F.bool_or(p.rlike(r"\.ya?ml$")),
        "labels": F.bool_or(p.rlike(r"(^|/)labels/.*\.txt$")),
        "coco": F.bool_or(p.rlike(r"(annotations?|instances)[^/]*\.json$") | p.rlike(r"(^|/)annotations/.*\.json$")),
        "voc": F.bool_or(p.rlike(r"\.xml$")),
        "images": F.bool_or(image),
    }
    folders = F.count_distinct(F.when(image, F.regexp_extract(p, r"([^/]+)/[^/]+$", 1)))
    flags = paths.groupBy(*by).agg(*[c.alias(k) for k, c in has.items()], folders.alias("folders"))
    kind = F.when(F.col("labels") | (F.col("yaml") & F.col("images")), "yolo").when(F.col("coco"), "coco").when(F.col("voc"), "voc").when(F.col("images") & (F.col("folders") >= 2), "classification").when(F.col("images"), "images").otherwise("unknown")
    return flags.select(*by, kind.alias("kind"))
