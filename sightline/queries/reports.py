"""Reports on models, data sets, image pairs, wires and people."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import panel_rules as rules
from sightline.functions import text as tx
from sightline.operators import compare as cp
from sightline.operators import reports as rp
from sightline.operators import selection as sel
from sightline.queries import compare as qc
from sightline.queries.inventory import RULES
from sightline.queries.selection import MODELS, _models
from sightline.registry import query
from sightline.sources import annotations, files
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
ids = lambda c: F.col(c)

SOURCES = "so as (select image_id % 7 source, case when image_id % 7 = 3 then 'manual' else 'public' end kind, image_id % 7 <> 5 usable from detections group by 1, 2, 3)"
COUNTED = "co as (select image_id % 7 source, class_id, case when image_id % 7 = 2 and class_id = 'plc' then null else count(*) end n from detections where class_id <> 'mcb' or image_id % 7 in (3, 5) group by image_id % 7, class_id)"
CLASSES = "cl as (select distinct class_id, class_id in ('mcb', 'plc', 'contactor') or class_id like 'r%' priority from (select class_id from detections union select 'rccb' union select 'busbar'))"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "detections").select("class_id").unionByName(spark.createDataFrame([("rccb",), ("busbar",)], "class_id string")).distinct()
    return c.withColumn("priority", F.col("class_id").isin("mcb", "plc", "contactor") | F.col("class_id").startswith("r"))


@query(
    f"with {SOURCES}, {COUNTED}, {CLASSES}, h as (select class_id, sum(case when kind <> 'manual' then n end) n, bool_or(kind <> 'manual') pub, bool_or(kind <> 'manual' and n is null) unq from co join so using (source) where usable group by 1) "
    "select cl.class_id, coalesce(n, 0)::bigint forecast, coalesce(unq, false) unquantified, case when coalesce(n, 0) = 0 then 'none' when n < 50 then 'untrainable' when n < 300 then 'weak' else 'reliable' end status, case when pub then 'public' when pub is not null then 'manual' else 'none' end origin, priority and coalesce(n, 0) = 0 priority_gap from cl left join h using (class_id)",
    "detections",
)
def a17_acquisition(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").withColumn("source", F.col("image_id") % 7)
    sources = rows.select("source", F.when(F.col("source") == 3, "manual").otherwise("public").alias("kind"), (F.col("source") != 5).alias("usable")).distinct()
    counts = rows.where((F.col("class_id") != "mcb") | F.col("source").isin(3, 5)).groupBy("source", "class_id").agg(F.count("*").alias("n"))
    counts = counts.withColumn("n", F.when(~((F.col("source") == 2) & (F.col("class_id") == "plc")), F.col("n")))
    return rp.acquisition(sources, counts, _classes(spark, d))


@query("select count(*) entries, count(distinct p_brand) makers, count(distinct p_type) classes, (select p_brand from part group by 1 order by count(*) desc, 1 limit 1) largest from part")
def a48_catalogue_summary(spark: SparkSession, d: str) -> DataFrame:
    return rp.catalogue_summary(table(spark, d, "part"), "p_brand", "p_type")


@query(f"with {RULES}, n as (select class_id, count(*) n from detections group by 1), r as (select rule, class_id, weight * coalesce(n, 0) weight from rules left join n using (class_id)) select rule, count(*) n_classes, round(sum(weight), 6)::double total, (select class_id from r x where x.rule = r.rule order by round(weight, 6) desc, class_id limit 1) heaviest from r group by rule", "detections")
def a48_rule_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rules weighed by how often the detections have their classes."""
    n = view(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n"))
    r = rules.rule_weights(spark).join(n, "class_id", "left").withColumn("weight", F.round(F.col("weight") * F.coalesce("n", F.lit(0)), 6))
    return rp.rule_summary(r).select("rule", "n_classes", R("total"), "heaviest")


COLOURS = {"black": (20, 20, 20), "red": (200, 30, 40), "blue": (40, 60, 200), "green": (40, 170, 60), "yellow": (220, 200, 40), "white": (240, 240, 240)}
PIXEL = "select image_id, det_id, det_id * 37 % 256 r, det_id * 91 % 256 g, det_id * 53 % 256 b from detections"


@query(
    f"with p as ({PIXEL}), c(color, x, y, z) as (values {', '.join(f'({k!r}, {x}, {y}, {z})' for k, (x, y, z) in COLOURS.items())}), "
    "w as (select image_id, det_id, color, row_number() over (partition by det_id order by (r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z), color) k from p cross join c) select image_id, color, count(*) n from w where k = 1 group by 1, 2",
    "detections",
)
def a49_colour_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("det_id")
    px = view(spark, d, "detections").select("image_id", (i * 37 % 256).alias("r"), (i * 91 % 256).alias("g"), (i * 53 % 256).alias("b"))
    off = lambda c: sum((F.col(k) - v) * (F.col(k) - v) for k, v in zip("rgb", c, strict=True))
    near = F.array_min(F.array(*[F.struct(off(c).alias("d"), F.lit(k).alias("color")) for k, c in COLOURS.items()]))["color"]
    return rp.colour_counts(px.withColumn("color", near))


@query(
    f"with {CLASSES}, n as (select class_id, count(*) n from detections where class_id <> 'plc' group by 1), gone as (select class_id from cl left join n using (class_id) where priority and n is null), i as (select count(distinct image_id) n from detections) "
    "select (select count(*) from gone) missing, (select string_agg(class_id, ',' order by class_id) from gone) first_missing, concat_ws(',', case when (select count(*) from gone) > 0 then 'priority_classes_without_data' end, case when n < 500 then 'few_images' end) warnings from i",
    "detections",
)
def a50_health(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections")
    n = rows.withColumn("class_id", F.when(F.col("class_id") != "plc", F.col("class_id"))).groupBy("class_id").agg(F.count("*").alias("instances"))
    images = rows.agg(F.count_distinct("image_id")).first()[0]
    out = rp.dataset_health(n, _classes(spark, d).where("priority").select("class_id"), images)
    return out.select(F.col("missing").cast("long").alias("missing"), F.array_join("first_missing", ",").alias("first_missing"), F.array_join("warnings", ",").alias("warnings"))


@query(
    f"with {MODELS}, j as (select m.*, latency, case when latency is null then null when latency <= 10 then 1.0 when latency >= 540 then 0.0 else 1 - ln(latency / 10) / ln(54.0) end speed from models m left join prof using (label)), "
    "q as (select *, case when map_50_95 < 0.585 then 'accuracy_floor' when latency > 540 then 'latency_budget' end reason from j), "
    "s as (select *, case when reason is null then case when speed is null then (0.45 * map_50_95 + 0.2 * map_50 + 0.2 * f1) / 0.85 else 0.45 * map_50_95 + 0.2 * map_50 + 0.2 * f1 + 0.15 * speed end end score from q), "
    "r as (select *, case when score is not null then row_number() over (order by score desc nulls last, label) end place from s), b as (select max(case when place = 1 then map_50_95 end) win, (select label from r where place is not null order by map_50_95 desc, place limit 1) acc from r) "
    "select label, place, round(score, 6) score, reason, case when latency is null and place is not null then 'accuracy_only' end note, case when place = 1 then 'winner' when label = acc then 'most_accurate' when place = 2 then 'runner_up' end role, round(case when place is not null then map_50_95 - win end, 6) accuracy_lost from r cross join b"
)
def d8_model_report(spark: SparkSession, d: str) -> DataFrame:
    evals, prof = _models(spark, d)
    return rp.model_report(evals, prof, 540.0, 0.585).select("label", "place", R("score"), "reason", "note", "role", R("accuracy_lost"))


PAIR_TEXTS = f"pt as (select a.conv_id * 100 + a.turn image_id, {qc.TOKENS.format(t='a.text')} x, {qc.TOKENS.format(t='b.text')} y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def _pair_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("x"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    texts = pairs.select((F.col("conv_id") * 100 + F.col("turn")).alias("image_id"), F.array_except("x", "y").alias("removed"), F.array_except("y", "x").alias("added"))
    rows = view(spark, d, "detections")
    regions = rows.where("score > 0.9").select("image_id", F.col("det_id").alias("region_id"), F.when(F.col("det_id") % 2 == 0, "color_change").otherwise("region_change").alias("type"))
    s = rows.groupBy("image_id").agg(F.min("score").alias("a"), F.max("score").alias("b"))
    scores = s.select("image_id", cp.similarity(F.col("b"), F.col("a"), F.col("a") * F.col("b"), F.lit(0.4)).alias("similarity"))
    return qc.j18_object_diff(spark, d), texts, regions, scores


@query(
    f"with {qc.OREFS}, {qc.assign_sql(qc.OPAIRS, panel='image_id')}, j as (select m.image_id, m.ref_id, m.obs_id, r.label l, o.label ol, sqrt(power((r.x1 + r.x2 - o.x1 - o.x2) / 2, 2) + power((r.y1 + r.y2 - o.y1 - o.y2) / 2, 2)) s from m join refs r using (image_id, ref_id) left join obs o on o.image_id = m.image_id and o.obs_id = m.obs_id), {PAIR_TEXTS}, "
    "df as (select * from (select image_id, case when obs_id is null then 'missing_object' when l <> ol then 'changed_object' when s > 20 then 'moved_object' end type from j) where type is not null union all select image_id, 'new_object' from obs where (image_id, obs_id) not in (select (image_id, obs_id) from m where obs_id is not null) "
    "union all select image_id, 'text_removed' from (select image_id, unnest(list_filter(x, lambda w: not list_contains(y, w))) from pt) union all select image_id, 'text_added' from (select image_id, unnest(list_filter(y, lambda w: not list_contains(x, w))) from pt) union all select image_id, 'region' from detections where score > 0.9), "
    "n as (select image_id, count(*) n, count(*) filter (where type in ('missing_object', 'changed_object', 'text_removed')) k from df group by 1), sc as (select image_id, min(score) a, max(score) b from detections group by 1) "
    "select image_id, round((0.5 * b + 0.2 * a + 0.15 * a * b + 0.15 * 0.4) * 100, 2) similarity, coalesce(n, 0) n_diffs, coalesce(k, 0) n_major, case when coalesce(n, 0) = 0 then 'identical' when k > 0 then 'major' else 'minor' end status from sc left join n using (image_id)",
    "detections",
    "ground_truth",
)
def d22_image_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rp.image_pair_report(*_pair_tables(spark, d))[1]


FILES = "fl as (select page_id % 9 dataset, page_id stem, page_id % 9 <> 8 and page_id % 23 <> 0 is_image, not (page_id % 9 = 2 and page_id % 50 = 20) readable from pages), lb as (select event_id % 9 dataset, event_id % 300 stem, case when event_id % 9 = 4 and event_id % 40 > 0 then 'plc' else event_type end class_id from events where event_id % 9 not in (6, 8))"


@query(
    f"with {FILES}, im as (select fl.*, l.stem is not null labelled from fl left join (select distinct dataset, stem from lb) l using (dataset, stem) where is_image), per as (select dataset, count(*) n_images, count(*) filter (where labelled) n_labels, count(*) filter (where not labelled) missing, count(*) filter (where not readable) corrupt from im group by 1), "
    "c as (select dataset, count(*) n_classes, round(max(n) / greatest(min(n), 1), 2) ratio from (select dataset, class_id, count(*) n from lb group by 1, 2) group by 1), "
    "a as (select dataset, coalesce(n_images, 0) n_images, coalesce(n_labels, 0) n_labels, coalesce(n_classes, 0) n_classes, ratio, coalesce(missing, 0) missing, coalesce(corrupt, 0) corrupt from (select distinct dataset from fl) left join per using (dataset) left join c using (dataset)) "
    "select dataset, n_images, n_labels, n_classes, ratio imbalance, missing missing_labels, corrupt, concat_ws(',', case when ratio >= 10 then 'severe_imbalance' when ratio >= 3 then 'imbalance' end, case when missing > 0 then 'missing_labels' end) warnings, "
    "concat_ws(',', case when corrupt > 0 then 'corrupt_images' end, case when n_images = 0 then 'no_images' when n_labels = 0 then 'no_labels' end) errors, corrupt = 0 and n_images > 0 and n_labels > 0 ok from a"
)
def d24_dataset_report(spark: SparkSession, d: str) -> DataFrame:
    p, i = F.col("page_id"), F.col("event_id")
    fl = table(spark, d, "pages").select((p % 9).alias("dataset"), p.alias("stem"), ((p % 9 != 8) & (p % 23 != 0)).alias("is_image"), (~((p % 9 == 2) & (p % 50 == 20))).alias("readable"))
    lb = table(spark, d, "events").where(~(i % 9).isin(6, 8)).select((i % 9).alias("dataset"), (i % 300).alias("stem"), F.when((i % 9 == 4) & (i % 40 > 0), "plc").otherwise(F.col("event_type")).alias("class_id"))
    out = rp.validate_datasets(fl, lb)
    return out.withColumn("warnings", F.array_join("warnings", ",")).withColumn("errors", F.array_join("errors", ","))


#: Annotated data sets of every layout: two of text labels, of JSON, of XML, of class folders, one of images alone and one of notes. Every 70th file is cut short.
ANNOTATED = {
    "image": "case page_id % 10 when 0 then 'images/train/' || page_id || '.jpg' when 1 then 'images/train/' || page_id || '.jpg' when 2 then 'img/' || page_id || '.png' when 3 then 'img/' || page_id || '.png' when 4 then 'x/' || page_id || '.jpeg' when 5 then 'x/' || page_id || '.jpeg' when 8 then 'all/' || page_id || '.bmp' when 9 then page_id || '.md' else 'class' || page_id % 4 || '/' || page_id || '.webp' end",
    "note": "case when page_id % 10 < 2 and page_id % 3 <> 0 then 'labels/train/' || page_id || '.txt' when page_id % 10 in (2, 3) then 'annotations/instances_' || page_id || '.json' when page_id % 10 in (4, 5) and page_id % 3 <> 0 then 'x/' || page_id || '.xml' end",
    "content": "case when page_id % 10 < 2 then repeat(page_id % 3 || ' 0.5 0.5 0.1 0.1\n', cast(page_id % 4 + 1 as int)) || case when page_id % 70 < 2 then 'x 0.5' else '' end "
    "when page_id % 10 in (2, 3) then '{\"categories\":[{\"id\":0,\"name\":\"a\"},{\"id\":1,\"name\":\"b\"}],\"annotations\":[{\"id\":1,\"category_id\":0}' || repeat(',{\"id\":2,\"category_id\":' || page_id % 3 || '}', cast(page_id % 4 as int)) || case when page_id % 70 in (2, 3) then '' else ']}' end "
    "when page_id % 10 in (4, 5) then '<annotation>' || repeat('<object><name>c' || page_id % 3 || '</name></object>', cast(page_id % 4 + 2 as int)) || case when page_id % 70 in (4, 5) then '<object>' else '</annotation>' end end",
}


@query(
    f"with p as (select page_id, page_id % 10 dataset, {ANNOTATED['note']} note, case when page_id % 10 < 8 then page_id % 70 = page_id % 10 else false end cut, page_id % 10 <> 9 is_image, page_id % 33 <> 5 readable from pages), "
    "l as (select dataset, page_id, (page_id % 3)::varchar class_id, page_id % 4 + 1 n from p where note like '%.txt' union all select dataset, page_id, 'a', 1 from p where note like '%.json' and not cut "
    "union all select dataset, page_id, case page_id % 3 when 0 then 'a' when 1 then 'b' else '2' end, page_id % 4 from p where note like '%.json' and not cut and page_id % 4 > 0 union all select dataset, page_id, 'c' || page_id % 3, page_id % 4 + 2 from p where note like '%.xml' and not cut "
    "union all select dataset, page_id, 'class' || page_id % 4, 1 from p where dataset in (6, 7)), "
    "c as (select dataset, count(*) n_classes, sum(n)::bigint n_rows, round(max(n) / greatest(min(n), 1), 2) imbalance from (select dataset, class_id, sum(n) n from l group by 1, 2) group by 1), "
    "i as (select dataset, count(*) filter (is_image) n_images, count(note) notes, count(*) filter (is_image and not readable) corrupt, count(*) filter (cut and note is not null) broken from p group by 1), "
    "k as (select i.*, coalesce(n_classes, 0) n_classes, imbalance, case when dataset < 2 then 'yolo' when dataset < 4 then 'coco' when dataset < 6 then 'voc' when dataset < 8 then 'classification' when dataset = 8 then 'images' else 'unknown' end kind, "
    "case when dataset in (0, 1, 4, 5) then notes when dataset < 8 then coalesce(n_rows, 0) else 0 end n_labels, case when dataset in (0, 1, 4, 5) then n_images - notes else 0 end missing_labels from i left join c using (dataset)) "
    "select dataset, kind, n_images, n_labels, n_classes, imbalance, missing_labels, corrupt, broken, concat_ws(',', case when imbalance >= 10 then 'severe_imbalance' when imbalance >= 3 then 'imbalance' end, case when missing_labels > 0 then 'missing_labels' end, case when broken > 0 then 'unreadable_annotations' end) warnings, "
    "concat_ws(',', case when corrupt > 0 then 'corrupt_images' end, case when n_images = 0 then 'no_images' when dataset < 6 and n_labels = 0 then 'no_labels' end) errors, corrupt = 0 and n_images > 0 and not (dataset < 6 and n_labels = 0) ok from k"
)
def d24_annotated_formats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("dataset"), *(F.expr(x).alias(n) for n, x in ANNOTATED.items()))
    image = p.select("dataset", F.col("image").alias("path"), (F.col("page_id") % 33 != 5).alias("readable"), F.lit(None).cast("string").alias("content"))
    out = annotations.validate_annotated(image.unionByName(p.where("note is not null").select("dataset", F.col("note").alias("path"), F.lit(True).alias("readable"), "content")))
    return out.withColumn("warnings", F.array_join("warnings", ",")).withColumn("errors", F.array_join("errors", ","))


def _wires(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("det_id")
    end = lambda c, k, a, b: F.when(i % k == 0, F.concat(F.lit(a), i % b)).alias(c)
    return view(spark, d, "detections").select("image_id", F.concat(F.lit("w"), i).alias("wire_uid"), end("from_terminal", 3, "T", 10), end("from_component", 2, "C", 10), end("to_terminal", 4, "T", 7), end("to_component", 5, "C", 7), F.when(i % 2 == 0, "red").otherwise("blue").alias("color"))


ENDS = "wi as (select image_id, det_id, 'w' || det_id wire_uid, case when det_id % 2 = 0 then 'red' else 'blue' end color, coalesce(case when det_id % 3 = 0 then 'T' || det_id % 10 end, case when det_id % 2 = 0 then 'C' || det_id % 10 end) src, coalesce(case when det_id % 4 = 0 then 'T' || det_id % 7 end, case when det_id % 5 = 0 then 'C' || det_id % 7 end) dst from detections)"


@query(f"with {ENDS} select wire_uid edge, src, dst, color, src is not null and dst is not null complete from wi", "detections")
def g2_connections(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "ref_id string, comp_type string, kind string")
    return rp.connections(cp.wire_graph(none, none, _wires(spark, d))[1])


@query(f"with {ENDS} select image_id, 'node' kind, (row_number() over (partition by image_id order by det_id) - 1)::varchar id, class_id label, null src, null dst from detections union all select image_id, 'edge', wire_uid, color, src, dst from wi", "detections")
def g9_topology(spark: SparkSession, d: str) -> DataFrame:
    w = _wires(spark, d).select("image_id", "wire_uid", "color", F.coalesce("from_terminal", "from_component").alias("src"), F.coalesce("to_terminal", "to_component").alias("dst"))
    return rp.topology(view(spark, d, "detections"), w)


DEVICES = "concat('Q', doc_id % 9 + 1, case when doc_id % 2 = 0 then concat(' feeds KM', doc_id % 7 + 1) else '' end, case when doc_id % 3 = 0 then concat(' via -X1:', doc_id % 5 + 1) else '' end, case when doc_id % 5 = 0 then '' else concat(' and Q', doc_id % 9 + 1, ' -> KM', doc_id % 4 + 20) end, '. ', n_chars)"


@query(
    f"with t as (select doc_id, {DEVICES} text from documents), tag as (select distinct doc_id, unnest(regexp_extract_all(text, '\\b-?([A-Z]{{1,3}}\\d{{1,3}})\\b', 1)) tag from t), term as (select distinct doc_id, unnest(regexp_extract_all(text, '\\bX\\d{{1,3}}:[0-9A-Z]{{1,4}}\\b')) tag from t), "
    "link as (select doc_id, unnest(regexp_extract_all(text, '([A-Z]{1,3}\\d{1,3}) -> ([A-Z]{1,3}\\d{1,3})')) l from t) "
    "select doc_id, (select count(*) from tag where tag.doc_id = t.doc_id) n_components, (select count(*) from term where term.doc_id = t.doc_id) n_terminals, (select count(*) from link where link.doc_id = t.doc_id) n_edges from t"
)
def d23_document_graph(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.expr(DEVICES).alias("text"))
    tags = tx.document_tags(t, "doc_id")
    n = tags.groupBy("doc_id").agg(F.count_if(F.col("kind") == "component").alias("n_components"), F.count_if(F.col("kind") == "terminal").alias("n_terminals"))
    e = cp.expected_graph(tags, tx.document_links(t, "doc_id"), "doc_id")[1].groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    return t.select("doc_id").join(n, "doc_id", "left").join(e, "doc_id", "left").fillna(0)


LISTING = "select page_id % 6 root, case page_id % 6 when 0 then case when page_id % 4 = 0 then 'r/labels/train/' || page_id || '.txt' else 'r/images/train/' || page_id || '.JPG' end when 1 then case when page_id % 60 = 1 then 'r/annotations/instances_train.json' else 'r/img/' || page_id || '.png' end when 2 then 'r/x/' || page_id || case when page_id % 2 = 0 then '.xml' else '.jpeg' end when 3 then 'r/class' || page_id % 4 || '/' || page_id || '.webp' when 4 then 'r/all/' || page_id || '.bmp' else 'r/notes/' || page_id || '.md' end path from pages"


@query(
    f"with l as ({LISTING}), f as (select root, bool_or(regexp_matches(path, '/labels/.*[.]txt$')) lab, bool_or(path like '%.json') js, bool_or(path like '%.xml') xm, bool_or(regexp_matches(lower(path), '[.](jpg|jpeg|png|bmp|webp)$')) im, count(distinct case when regexp_matches(lower(path), '[.](jpg|jpeg|png|bmp|webp)$') then split_part(path, '/', -2) end) folders from l group by 1) "
    "select root, case when lab then 'yolo' when js then 'coco' when xm then 'voc' when im and folders >= 2 then 'classification' when im then 'images' else 'unknown' end kind from f"
)
def s24_detect_kind(spark: SparkSession, d: str) -> DataFrame:
    listing = spark.sql(LISTING.replace("from pages", "from {p}"), p=table(spark, d, "pages"))
    return files.detect_kind(listing, "path", "root")


U = lambda *parts: f"((('0x' || substr(md5(concat_ws(':', 42, vec_id, {', '.join(parts)})), 1, 8))::bigint + 0.5) / 4294967296.0)"


@query(
    "with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) x from vectors), "
    f"e as (select vec_id, label, k, x[k + 1] v from (select *, unnest(range(0, 64)) k from v)), n as (select vec_id, label, k, least(1.0, greatest(0.0, v * (0.9 + 0.2 * {U(repr('s'))}) + 0.03 * sqrt(-2 * ln({U('k', repr('a'))})) * cos(2 * pi() * {U('k', repr('b'))}))) v from e) "
    "select vec_id, label, true augmented, round(sum(v), 6) total, round(max(v), 6) most from n group by 1, 2 union all select vec_id, label, false, round(sum(v), 6), round(max(v), 6) from e group by 1, 2",
    "vectors",
)
def p26_augment(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = rp.augment(v, "vec_id", "x")
    return out.select("vec_id", "label", "augmented", R(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), "total"), R(F.array_max("x"), "most"))


@query("select det_id, round(w / h, 2) w_h from (select det_id, (x2 - x1) * (1 + det_id % 3) / 2 w, y2 - y1 h from detections) where h > 0 and w / h >= 1.3", "detections")
def p14_fall(spark: SparkSession, d: str) -> DataFrame:
    """Boxes between half and one and a half times as wide as detected, on both sides of the default ratio."""
    people = view(spark, d, "detections").withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) * (1 + F.col("det_id") % 3) / 2)
    return rp.falls(people).select("det_id", "w_h")
