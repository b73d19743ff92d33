import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import events
from sightline.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.fixture
def tree(tmp_path):
    for split, name, text in (("train", "a", "0 0.5 0.5 0.1 0.2\n1 0.1 0.1 x 0.1\n1 0.2"), ("valid", "b", ""), ("test", "c", "2 0.25 0.25 0.5 0.5 0.9")):
        for kind, suffix, body in (("images", ".jpg", "img" + name), ("labels", ".txt", text)):
            d = tmp_path / "set" / kind / split
            d.mkdir(parents=True, exist_ok=True)
            (d / f"{name}{suffix}").write_text(body)
    return tmp_path / "set"


def test_label_files(spark, tree, tmp_path):
    got = files.read_label_files(spark, str(tree))
    assert rows(got, "split", "stem", "cls", "cx", "w") == [("test", "c", 2, 0.25, 0.5), ("train", "a", 0, 0.5, 0.1)]
    images = files.list_images(spark, str(tree))
    assert rows(images, "split", "stem", "bytes") == [("test", "c", 4), ("train", "a", 4), ("val", "b", 4)]
    files.write_label_table(got, images, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "split", "stem", "label_text") == [("test", "c", "2 0.250000 0.250000 0.500000 0.500000"), ("train", "a", "0 0.500000 0.500000 0.100000 0.200000"), ("val", "b", "")]
    assert files.content_hashes(spark, str(tree / "images")).select("sha").distinct().count() == 3
    paths = images.select("path").union(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tree / "labels")).select("path"))
    assert files.detect_kind(paths).first()["kind"] == "yolo"


@pytest.mark.parametrize("names,kind", [(["d/annotations/instances_val.json", "d/x.jpg"], "coco"), (["d/a.xml", "d/a.jpg"], "voc"), (["d/cat/1.png", "d/dog/2.png"], "classification"), (["d/1.png"], "images"), (["readme.md"], "unknown")])
def test_detect_kind(spark, names, kind):
    assert files.detect_kind(spark.createDataFrame([(n,) for n in names], "path string")).first()["kind"] == kind


def test_folders(spark, tree):
    assert rows(files.per_class_folders(files.list_images(spark, str(tree)))) == [("test", 1), ("train", 1), ("valid", 1)]


def test_coco_and_voc(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1}], "categories": [{"id": 7, "name": "mcb"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}]}, indent=1))
    got = {r["annotation_id"]: r for r in files.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert (got[1]["class_id"], got[1]["x2"], got[1]["y2"]) == ("mcb", 4.0, 6.0) and got[2]["class_id"] is None
    (tmp_path / "v.xml").write_text("<annotation><filename>v.jpg</filename><object><name>plc</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>mcb</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    assert rows(files.read_voc(spark, str(tmp_path / "v.xml")), "class_id", "x1", "y2") == [("mcb", 5.0, 8.0), ("plc", 1.0, 4.0)]


def test_class_map_and_curves(spark, tmp_path):
    assert rows(files.class_map(spark, ["a", "b"])) == rows(files.class_map(spark, {"1": "b", "0": "a"})) == [(0, "a"), (1, "b")]
    (tmp_path / "r.csv").write_text("  epoch, metrics/mAP50(B)\n 1, 0.5\n 2, 0.6, 7\n 3, nan\n 4, x\n")
    got = files.read_curves(spark, str(tmp_path / "r.csv"), {"epoch": [], "map_50": ["metrics/mAP50(B)", "mAP_0.5"], "loss": ["train/loss"]})
    assert [(r["epoch"], r["loss"]) for r in got.orderBy("epoch").collect()] == [(1.0, None), (3.0, None), (4.0, None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", x', None), (2, "b", 0.5)], "id int, text string, score double")
    files.write_components_csv(df, str(tmp_path / "csv"), ["text", "id"])
    assert rows(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))) == [("b", "2"), ('say "hi", x', "1")]
    files.write_json_report(df, str(tmp_path / "json"))
    assert rows(spark.read.text(str(tmp_path / "json")).where("value like '%\"score\":null%'").agg(F.count("*"))) == [(1,)]
    out = files.summary_sections({"totals": df.select(F.lit("n").alias("key"), F.col("id").alias("value")), "text": df.select(F.col("text").alias("key"), F.col("score").alias("value"), F.lit("d").alias("detail"))})
    assert out.count() == 4 and out.columns == ["section", "key", "value", "detail"]
    assert json.loads(files.manifest(df.withColumn("image_id", F.lit(1))).first()["manifest"])[1]["text"] == "b"


def test_sidecar(spark):
    labels = spark.createDataFrame([(1,), (1,)], "image_id int")
    side = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "image_id int, boxes array<string>")
    assert rows(files.sidecar_boxes(labels, side)) == [(1, 2, "x"), (1, 3, "y"), (2, 0, "z")]


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "panel_id int, v string")
    events.replace_partition(df, path, "panel_id")
    events.replace_partition(spark.createDataFrame([(2, "c"), (2, "d")], df.schema), path, "panel_id")
    assert rows(spark.read.parquet(path), "panel_id", "v") == [(1, "a"), (2, "c"), (2, "d")]


def test_annotated_sets_of_every_layout(spark, tmp_path):
    """Good and broken files of each layout, read from disk in one pass."""
    from sightline.sources import annotations

    sets = {
        "y": {"images/a.jpg": "x", "images/b.jpg": "x", "images/c.jpg": "", "labels/a.txt": "0 .5 .5 .1 .1\n\n2 .5 .5 .1 .1\r\n", "labels/b.txt": "0 .5\nbad\n1 .5\n", "labels/classes.txt": "panel\n"},
        "c": {"img/a.png": "x", "annotations/instances_a.json": json.dumps({"categories": [{"id": 7, "name": "mcb"}], "annotations": [{"id": 1, "category_id": 7}, {"id": 2, "category_id": 7}, {"id": 3, "category_id": 8}]}), "annotations/instances_b.json": '{"annotations": [{"id": 1, "cate', "annotations/info.json": '{"year": 2020}'},
        "v": {"x/a.jpeg": "x", "x/b.jpeg": "x", "x/a.xml": "<annotation><object><name>mcb</name></object><object><bndbox/></object></annotation>", "x/c.xml": "<annotation><object><name>mcb</na"},
        "f": {"mcb/1.webp": "x", "mcb/2.webp": "x", "plc/3.webp": "x", "top.webp": "x"},
        "n": {"a.md": "x"},
    }
    for name, files_ in sets.items():
        for path, text in files_.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            begins = bytes.fromhex(annotations.BEGINS.get(path.rpartition(".")[2], "")) if path != "images/c.jpg" else b"?"
            (tmp_path / name / path).write_bytes(begins + text.encode())
    read = annotations.read_files(spark, {n: str(tmp_path / n) for n in sets})
    assert read.where("content is not null").count() == 8
    kinds = files.detect_kind(read, "path", "dataset")
    labels, broken = annotations.annotation_labels(read, kinds)
    assert rows(labels.groupBy("dataset", "class_id").count()) == [("c", "8", 1), ("c", "mcb", 2), ("f", "mcb", 2), ("f", "plc", 1), ("v", "mcb", 1), ("v", "unknown", 1), ("y", "0", 2), ("y", "2", 1)]
    assert rows(broken) == [("c", "annotations/instances_b.json"), ("v", "x/c.xml"), ("y", "labels/b.txt")]
    report = {r["dataset"]: r for r in annotations.validate_annotated(read).collect()}
    assert {k: (r["kind"], r["n_images"], r["n_labels"], r["missing_labels"], r["broken"]) for k, r in report.items()} == {"y": ("yolo", 3, 2, 1, 1), "c": ("coco", 1, 3, 0, 1), "v": ("voc", 2, 2, 1, 1), "f": ("classification", 4, 3, 0, 0), "n": ("unknown", 0, 0, 0, 0)}
    assert report["y"]["errors"] == ["corrupt_images"] and report["n"]["errors"] == ["no_images"] and report["f"]["ok"]
