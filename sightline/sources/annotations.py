"""Labels of annotated data sets of any known layout, read in one pass, with the files that can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.files import IMAGE_SUFFIXES, detect_kind, stem

#: Text files that hold annotations.
NOTES = ("txt", "json", "xml")
COCO = "annotations array<struct<category_id:string>>, categories array<struct<id:string,name:string>>, _bad string"
VOC = "object array<struct<name:string>>, _bad string"
NOT_LABELS = ("classes", "readme")
#: How image files begin, in hexadecimal.
BEGINS = {"jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E47", "bmp": "424D", "webp": "52494646"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """dataset, path (below its root), readable, content: every file of the data sets; only annotation files have a content.

    An image is readable if it begins as its format does; it is not decoded. Empty files are not listed. A file is one
    row, so it has 2 GB at most.
    """
    out = None
    for name, root in roots.items():
        below = lambda c: F.regexp_replace(c, rf"^.*?\Q{root.rstrip('/')}\E/", "")
        begins = F.try_element_at(F.create_map(*[F.lit(x) for kv in BEGINS.items() for x in kv]), suffix(F.col("path")))
        readable = begins.isNull() | F.startswith(F.hex(F.substring("content", 1, 4)), begins)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(below(F.col("path")).alias("path"), readable.alias("readable"))
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(NOTES)}}}").text(root, wholetext=True)
        texts = texts.select(below(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
        own = listed.join(texts, "path", "left").select(F.lit(name).alias("dataset"), "path", "readable", "content")
        out = own if out is None else out.unionByName(own)
    return out


def annotation_labels(files: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, path, stem, class_id: a row for each label; dataset, path: annotation files that can't be read).

    ``files``: dataset, path, content; ``kinds``: dataset, kind (``detect_kind``), which tells how a file is parsed. Text
    labels count up to a line whose class is no number; of annotation JSON and XML all counts or nothing; a category or
    object without a name goes by its number or as unknown. In class folders each image is a label.
    """
    rows = files.select("dataset", "path", "content").join(kinds.select("dataset", "kind"), "dataset").withColumn("suffix", suffix(F.col("path"))).withColumn("stem", stem(F.col("path")))
    bad = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    is_ = lambda kind, ending: (F.col("kind") == kind) & (F.col("suffix") == ending)
    classes = F.transform(F.filter(F.split(F.regexp_replace("content", "\r", ""), "\n"), lambda x: F.trim(x) != ""), lambda x: F.floor(F.regexp_extract(x, r"^\s*(\S+)", 1).try_cast("double")).cast("string"))
    first_bad = F.array_position(F.transform(classes, lambda c: c.isNull()), True)
    named = lambda c, names: F.coalesce(F.try_element_at(F.map_from_entries(F.array_distinct(names)), c), c)
    coco, voc = F.from_json("content", COCO, bad), F.from_xml("content", VOC, bad)
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    text = is_("yolo", "txt") & ~F.lower("stem").isin(*NOT_LABELS)
    json_, xml = is_("coco", "json"), is_("voc", "xml")
    in_folder = (F.col("kind") == "classification") & F.col("suffix").isin(*IMAGE_SUFFIXES) & F.contains("path", F.lit("/"))
    read = rows.where(text | json_ | xml | in_folder).withColumns({"coco": F.when(json_, coco), "voc": F.when(xml, voc), "lines": F.when(text, classes), "stop": F.when(text, first_bad)})
    names = F.transform(F.coalesce("coco.categories", F.expr("cast(array() as array<struct<id:string,name:string>>)")), lambda c: F.struct(c["id"].alias("key"), F.coalesce(c["name"], c["id"]).alias("value")))
    labels = (
        F.when(text, F.when(F.col("stop") > 0, F.slice("lines", F.lit(1), F.col("stop").cast("int") - 1)).otherwise(F.col("lines")))
        .when(json_, F.transform("coco.annotations", lambda a: named(a["category_id"], names)))
        .when(xml, F.transform("voc.object", lambda o: F.coalesce(o["name"], F.lit("unknown"))))
        .otherwise(F.array(folder))
    )
    # a document that ends early leaves the record as corrupt; one without annotations is another kind of file
    broken = F.when(text, F.coalesce(F.col("stop") > 0, F.lit(False))).when(json_, F.col("coco._bad").isNotNull()).when(xml, F.col("voc._bad").isNotNull()).otherwise(F.lit(False))
    read = read.select("dataset", "path", "stem", labels.alias("labels"), broken.alias("broken"), (json_ | xml).alias("whole"))
    good = read.where("not (broken and whole)").select("dataset", "path", "stem", F.explode("labels").alias("class_id"))
    return good, read.where("broken").select("dataset", "path")


def validate_annotated(files: DataFrame) -> DataFrame:
    """dataset, kind, n_images, n_labels, n_classes, imbalance, missing_labels, corrupt, broken, warnings, errors, ok of each data set.

    ``files``: dataset, path, readable, content (null for what is no annotation). n_labels counts labelled images (text
    labels), annotations (JSON), annotation files (XML) or images in class folders; images count as missing a label where
    each has a file of its own.
    """
    kinds = detect_kind(files, "path", "dataset")
    labels, broken = annotation_labels(files, kinds)
    ends = suffix(F.col("path"))
    images = files.where(ends.isin(*IMAGE_SUFFIXES)).select("dataset", stem(F.col("path")).alias("stem"), "readable")
    own = files.join(kinds, "dataset").where(((F.col("kind") == "yolo") & (ends == "txt") & ~F.lower(stem(F.col("path"))).isin(*NOT_LABELS)) | ((F.col("kind") == "voc") & (ends == "xml")))
    noted = own.select("dataset", stem(F.col("path")).alias("stem")).distinct().withColumn("noted", F.lit(True))
    per = images.join(noted, ["dataset", "stem"], "left").groupBy("dataset").agg(F.count("*").alias("n_images"), F.count("noted").alias("noted"), F.count_if(~F.col("readable")).alias("corrupt"))
    xmls = files.where(ends == "xml").groupBy("dataset").agg(F.count("*").alias("n_xml"))
    n = labels.groupBy("dataset", "class_id").agg(F.count("*").alias("n"))
    classes = n.groupBy("dataset").agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_rows"), F.round(F.max("n") / F.greatest(F.min("n"), F.lit(1)), 2).alias("imbalance"))
    bad = broken.groupBy("dataset").agg(F.count("*").alias("broken"))
    rows = kinds
    for part in (per, xmls, classes, bad):
        rows = rows.join(part, "dataset", "left")
    rows = rows.fillna(0, ["n_images", "noted", "corrupt", "n_xml", "n_classes", "n_rows", "broken"])
    kind = F.col("kind")
    n_labels = F.when(kind == "yolo", F.col("noted")).when(kind == "voc", F.col("n_xml")).when(kind.isin("coco", "classification"), F.col("n_rows")).otherwise(0)
    missing = F.when(kind.isin("yolo", "voc"), F.col("n_images") - F.col("noted")).otherwise(0)
    rows = rows.withColumns({"n_labels": n_labels, "missing_labels": missing})
    ratio = F.col("imbalance")
    warnings = F.array_compact(F.array(F.when(ratio >= 10, "severe_imbalance").when(ratio >= 3, "imbalance"), F.when(F.col("missing_labels") > 0, "missing_labels"), F.when(F.col("broken") > 0, "unreadable_annotations")))
    none = kind.isin("yolo", "coco", "voc") & (F.col("n_labels") == 0)
    errors = F.array_compact(F.array(F.when(F.col("corrupt") > 0, "corrupt_images"), F.when(F.col("n_images") == 0, "no_images").when(none, "no_labels")))
    return rows.select("dataset", "kind", "n_images", "n_labels", "n_classes", "imbalance", "missing_labels", "corrupt", "broken", warnings.alias("warnings"), errors.alias("errors"), (F.size(errors) == 0).alias("ok"))
