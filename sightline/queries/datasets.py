"""Annotated datasets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators import datasets as ds
from sightline.operators import reports as rp
from sightline.plans.lineage import materialize
from sightline.registry import query
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
CLASSES = ("contactor", "overload_relay", "mcb", "terminal_block", "plc")
PARSED = r"""p as (select *, case when trim(line) = '' then 0 else len(f) end n_fields, floor(try_cast(f[1] as double))::int cls, try_cast(f[2] as double) cx, try_cast(f[3] as double) cy, try_cast(f[4] as double) w, try_cast(f[5] as double) h from (select *, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') f from label_lines)),
i as (select *, case when n_fields < 5 then 'malformed_row' when cls is null or cx is null or cy is null or w is null or h is null then 'unparseable_row' when cls not between 0 and 4 then 'class_out_of_range' when not (cx between 0 and 1 and cy between 0 and 1) then 'centre_out_of_range'
  when w <= 0 or h <= 0 then 'degenerate_box' when w > 1 or h > 1 then 'box_exceeds_image' end fatal,
  case when w * h > 0.9 then 'box_covers_frame' when w * h < 1e-5 then 'box_too_small' end w1, case when cx - w / 2 < -0.01 or cx + w / 2 > 1.01 or cy - h / 2 < -0.01 or cy + h / 2 > 1.01 then 'box_outside_frame' end w2 from p)"""
GOOD = f"{PARSED}, good as (select image_id, gt_id, cls, cx, cy, w, h from i where fatal is null)"
CASE = "case cls when 0 then 'contactor' when 1 then 'overload_relay' when 2 then 'mcb' when 3 then 'terminal_block' else 'plc' end"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return ds.label_rows(view(spark, d, "label_lines")).withColumn("issues", ds.row_issues(5))


def _map(spark: SparkSession, n: int = 5) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES))[:n], "cls int, class_id string")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    fatal = F.exists("issues", lambda x: x.isin("malformed_row", "unparseable_row", "class_out_of_range", "centre_out_of_range", "degenerate_box", "box_exceeds_image"))
    return ds.remap(_parsed(spark, d).where(~fatal), _map(spark))[0]


@query(f"with {PARSED} select gt_id, cls, cx, cy, w, h from p where n_fields >= 5 and cx is not null", "label_lines")
def s8_label_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("n_fields >= 5 and cx is not null").select("gt_id", "cls", "cx", "cy", "w", "h")


@query(f"with {PARSED} select gt_id, case when fatal is not null then fatal else concat_ws(',', w1, w2) end issues from i", "label_lines")
def p13_label_validation(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("gt_id", F.array_join("issues", ",").alias("issues"))


@query("select image_id, concat_ws(',', case when least(w, h) < 320 then 'image_too_small' end, case when greatest(w, h) / least(w, h) > 4 then 'extreme_aspect' end, case when luma_mean < 30 then 'too_dark' when luma_mean > 225 then 'too_bright' end, case when clipped_frac > 0.35 then 'clipped' end, case when laplacian_var < 40 then 'blurred' end, case when luma_std < 8 then 'featureless' end) issues from image_stats", "image_stats")
def p12_image_checks(spark: SparkSession, d: str) -> DataFrame:
    return ds.image_issues(view(spark, d, "image_stats")).select("image_id", F.array_join("issues", ",").alias("issues"))


ANALYSED = f"{GOOD}, a as (select {CASE} class_id, count(*) instances, count(distinct image_id) images, avg(w * h) mean_area, min(w * h) min_area, max(w * h) max_area from good group by 1)"


@query(f"with {ANALYSED} select class_id, instances, images, round(mean_area, 6) mean_area, round(min_area, 6) min_area, round(max_area, 6) max_area from a", "label_lines")
def a13_dataset_analysis(spark: SparkSession, d: str) -> DataFrame:
    return ds.analyse(_labels(spark, d)).select("class_id", "instances", "images", R("mean_area"), R("min_area"), R("max_area"))


@query(f"with {ANALYSED} select (select class_id from a order by instances desc, class_id limit 1) most_common, (select class_id from a order by instances, class_id limit 1) least_common, round(max(instances) / greatest(min(instances), 1), 6) ratio, count(*) filter (where instances < 100) n_small from a", "label_lines")
def a14_class_balance(spark: SparkSession, d: str) -> DataFrame:
    return ds.balance(ds.analyse(_labels(spark, d)), 100).select("most_common", "least_common", R("ratio"), "n_small")


@query(f"with {ANALYSED}, c as (select unnest(['contactor', 'overload_relay', 'mcb', 'terminal_block', 'plc', 'vfd', 'fuse']) class_id) select class_id, coalesce(instances, 0) instances, case when coalesce(instances, 0) = 0 then 'absent' when instances < 50 then 'untrainable' when instances < 300 then 'weak' else 'reliable' end status, greatest(0, 300 - coalesce(instances, 0)) shortfall, ceil(greatest(0, 300 - coalesce(instances, 0)) / 12)::bigint images_needed from c left join a using (class_id)", "label_lines")
def a15_coverage(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in (*CLASSES, "vfd", "fuse")], "class_id string")
    return ds.coverage(classes, ds.analyse(_labels(spark, d)))


@query(f"with {ANALYSED}, c as (select unnest(['contactor', 'mcb', 'vfd', 'fuse']) class_id) select sum(greatest(0, 300 - coalesce(instances, 0)))::bigint shortfall, count(*) filter (where coalesce(instances, 0) = 0) absent from c left join a using (class_id)", "label_lines")
def a16_requirements(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in ("contactor", "mcb", "vfd", "fuse")], "class_id string")
    return ds.coverage(classes, ds.analyse(_labels(spark, d))).agg(F.sum("shortfall").alias("shortfall"), F.count_if(F.col("status") == "absent").alias("absent"))


@query(f"with {GOOD} select kept, class_id, count(*) n from (select cls < 3 kept, case when cls < 3 then {CASE} else cls::varchar end class_id from good) group by 1, 2", "label_lines")
def a32_remap_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).drop("class_id")
    kept, dropped = ds.remap(rows, _map(spark, 3))
    return kept.groupBy(F.lit(True).alias("kept"), "class_id").agg(F.count("*").alias("n")).unionByName(dropped.groupBy(F.lit(False).alias("kept"), F.col("cls").cast("string").alias("class_id")).agg(F.count("*").alias("n")))


@query(f"with {GOOD} select gt_id, {CASE} class_id from good where cls < 3", "label_lines")
def j27_remap(spark: SparkSession, d: str) -> DataFrame:
    return ds.remap(_labels(spark, d).drop("class_id"), _map(spark, 3))[0].select("gt_id", "class_id")


@query("select 's' || (case when split = 'train' then 0 else 1 end) || '_' || filename filename, image_id from images where split <> 'test'", "images")
def u1_merge(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images").select("filename", "image_id", "split")
    return ds.merge([i.where("split = 'train'"), i.where("split = 'val'")]).select("filename", "image_id")


BANDS = " union all ".join(f"select image_id, dhash, ahash, {k} k, (dhash >> {16 * k}) & 65535 v from images" for k in range(4))
LINKS = f"""b as ({BANDS}), near as (select distinct x.image_id a, y.image_id b from b x join b y on x.k = y.k and x.v = y.v and x.image_id < y.image_id where bit_count(xor(x.dhash, y.dhash)) <= 5 and bit_count(xor(x.ahash, y.ahash)) <= 10),
links as (select a, b from near union select min(x.image_id) over (partition by sha), image_id from images x)"""
GROUPS = f"""{LINKS}, e as (select a, b from links where a <> b union select b, a from links where a <> b), reach as (select a, a r from e union select reach.a, e.b from reach join e on e.a = reach.r),
g as (select a image_id, min(r) group_id from reach group by 1), m as (select g.*, dhash, sha, split, filename from g join images using (image_id)),
kinds as (select x.group_id, case when bool_and(x.sha = y.sha) then 'exact' else 'near' end kind, max(bit_count(xor(x.dhash, y.dhash)))::int max_distance from m x join m y using (group_id) group by 1)"""
#: Labels of images: those of a frame that the content names, of every fifth image those of the next.
FRAME = "case when image_id % 5 = 0 then 1 else 0 end + ascii(substr(sha, 1, 1)) % 16"
SIGNATURES = f"""frames as (select image_id, string_agg(sig, ',' order by sig) signature from (select image_id, concat_ws(':', cls, floor(cx * 100 + 0.5)::bigint, floor(cy * 100 + 0.5)::bigint, floor(w * 100 + 0.5)::bigint, floor(h * 100 + 0.5)::bigint) sig from p where n_fields >= 5 and cls is not null and cx is not null and cy is not null and w is not null and h is not null) group by 1),
signed as (select m.*, coalesce(signature, '') signature from m left join frames on frames.image_id = {FRAME.replace("image_id", "m.image_id")}), clash as (select group_id from signed group by 1 having count(distinct signature) > 1)"""
RANKED = "select image_id, group_id, split, row_number() over (partition by group_id order by case split when 'train' then 1 when 'val' then 2 else 3 end, filename, image_id) r from m"


def _images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(images, their groups), both written: several steps read them."""
    images = materialize(view(spark, d, "images"), "images")
    return images, materialize(ds.duplicate_groups(images), "groups")


@query(f"with {LINKS} select count(*) n, count(distinct a) firsts from (select a, b from near where a in (select min(image_id) from images group by dhash, ahash) and b in (select min(image_id) from images group by dhash, ahash) union select min(image_id) over (partition by sha), image_id from images union select min(image_id) over (partition by dhash, ahash), image_id from images) where a <> b", "images")
def j23_hash_links(spark: SparkSession, d: str) -> DataFrame:
    return ds.hash_links(view(spark, d, "images")).agg(F.count("*").alias("n"), F.count_distinct("a").alias("firsts"))


def _signatures(spark: SparkSession, d: str, images: DataFrame) -> DataFrame:
    rows = _parsed(spark, d).where("n_fields >= 5 and cls is not null and cx is not null and cy is not null and w is not null and h is not null")
    frames = rp.label_signature(rows).withColumnRenamed("image_id", "frame")
    return images.withColumn("frame", F.expr(FRAME)).join(frames, "frame").select("image_id", "signature")


@query(f"with {GROUPS} select image_id, group_id, kind, max_distance from g join kinds using (group_id)", "images")
def g5_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return ds.duplicate_groups(view(spark, d, "images"))


@query(
    f"with {GROUPS}, {PARSED}, {SIGNATURES}, s as (select group_id, kind, max_distance, count(*) n, count(distinct split) k from m join kinds using (group_id) group by 1, 2, 3) select (select count(*) from images) images, count(*) groups, count(*) filter (where kind = 'exact') exact, count(*) filter (where kind = 'near') near, (sum(n) - count(*))::bigint redundant, "
    "count(*) filter (where k > 1) cross_split, coalesce(sum(n) filter (where k > 1), 0)::bigint cross_images, (select count(*) from clash) label_conflicts, max(max_distance) max_distance, round((sum(n) - count(*)) / (select count(*) from images), 6) redundancy from s",
    "images", "label_lines",
)
def a34_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    images, groups = _images(spark, d)
    return ds.duplicate_report(images, groups, _signatures(spark, d, images)).withColumn("redundancy", R("redundancy"))


@query(
    f"with {GROUPS}, {PARSED}, {SIGNATURES}, s as (select group_id, count(*) n, count(distinct split) k from m group by 1), t as (select (select count(*) from images) images, (sum(n) - count(*))::bigint redundant, count(*) filter (where k > 1) across, (select count(*) from clash) clash from s) "
    "select concat_ws(' ', case when redundant = 0 then 'Every image is its own.' else redundant || ' of ' || images || ' images (' || printf('%.1f', 100.0 * redundant / images) || ' %) repeat another.' end, case when across > 0 then across || ' groups lie in more than one split, so scores measured here are too good.' end, case when clash > 0 then clash || ' groups have labels that disagree and need a look.' end) verdict from t",
    "images", "label_lines",
)
def f25_duplicate_verdict(spark: SparkSession, d: str) -> DataFrame:
    images, groups = _images(spark, d)
    return rp.duplicate_verdict(ds.duplicate_report(images, groups, _signatures(spark, d, images)))


@query(f"with {GROUPS}, k as ({RANKED}) select split, count(*) redundant from k where r > 1 group by 1", "images")
def a34_redundant_by_split(spark: SparkSession, d: str) -> DataFrame:
    return ds.redundant_by_split(*_images(spark, d))


@query(f"with {GROUPS}, {PARSED}, {SIGNATURES} select group_id from clash", "images", "label_lines")
def a34_label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    images, groups = _images(spark, d)
    return ds.label_conflicts(images, groups, _signatures(spark, d, images))


@query(f"with {GROUPS}, {PARSED}, {SIGNATURES}, k as ({RANKED}) select image_id, filename, split from images where image_id not in (select image_id from k where r > 1 and group_id not in (select group_id from clash))", "images", "label_lines")
def d13_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    images, groups = _images(spark, d)
    whole = ds.label_conflicts(images, groups, _signatures(spark, d, images))
    return ds.keep_one(images, groups, whole=whole).select("image_id", "filename", "split")


@query(f"with {GROUPS}, k as ({RANKED}) select image_id from k where r > 1", "images")
def w7_redundant(spark: SparkSession, d: str) -> DataFrame:
    i, groups = _images(spark, d)
    return i.select("image_id").join(ds.keep_one(i, groups).select("image_id"), "image_id", "left_anti")


KEY = "'panel' || (image_id % 89)"


@query(f"select image_id, {KEY} group_key from images", "images")
def f15_group_key(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "images").select("image_id", tx.group_key(F.col("filename")).alias("group_key"))


@query(f"select count(*) groups, round(avg(n), 6) mean_size, count(*) filter (where k > 1) leaking from (select {KEY}, count(*) n, count(distinct split) k from images group by 1)", "images")
def a33_group_report(spark: SparkSession, d: str) -> DataFrame:
    keyed = view(spark, d, "images").withColumn("group_key", tx.group_key(F.col("filename")))
    return ds.group_report(keyed).select("groups", R("mean_size"), "leaking")


def _short(k: int) -> str:
    """Shortfall of split ``k`` in the step that follows ``s``."""
    share = (0.7, 0.2, 0.1)[k] / sum((0.7, 0.2, 0.1))
    return f"list_sum(list_transform(q.c, lambda x: (x.t * {share!r} - coalesce(list_extract(map_extract(s.have{k}, x.c), 1), 0)) * (1.0 / sqrt(x.t))))"


_NEXT = "case when d0 > d1 or (d0 = d1 and n0 <= n1) then case when d0 > d2 or (d0 = d2 and n0 <= n2) then 0 else 2 end when d1 > d2 or (d1 = d2 and n1 <= n2) then 1 else 2 end"
_MORE = "map_from_entries(list_concat(list_filter(map_entries(have{k}), lambda e: not list_contains(list_transform(c, lambda x: x.c), e.key)), list_transform(c, lambda x: {{'key': x.c, 'value': coalesce(list_extract(map_extract(have{k}, x.c), 1), 0) + x.n}})))"


@query(
    f"with gc as (select {KEY} group_key, source c, count(*) n from images group by 1, 2), t as (select c, sum(n)::bigint t from gc group by 1), "
    "q as (select *, row_number() over (order by rarity, alike, md5('0:' || group_key), group_key) i from (select group_key, min(t) rarity, '[' || string_agg('{\"class_id\":\"' || c || '\",\"n\":' || n || '}', ',' order by c) || ']' alike, list({'c': c, 't': t, 'n': n} order by c) c from gc join t using (c) group by 1)), "
    "st as (select 0::bigint i, 0 pick, 0 n0, 0 n1, 0 n2, map([]::varchar[], []::bigint[]) have0, map([]::varchar[], []::bigint[]) have1, map([]::varchar[], []::bigint[]) have2 "
    f"union all select i, pick, n0 + (pick = 0)::int, n1 + (pick = 1)::int, n2 + (pick = 2)::int, {', '.join(f'case when pick = {k} then {_MORE.format(k=k)} else have{k} end' for k in range(3))} "
    f"from (select *, {_NEXT} pick from (select q.i, q.c, s.n0, s.n1, s.n2, s.have0, s.have1, s.have2, {', '.join(f'{_short(k)} d{k}' for k in range(3))} from st s join q on q.i = s.i + 1) z) y), "
    "a as (select alike, count(*) filter (pick = 0) train, count(*) filter (pick = 1) val from st join q using (i) group by 1), "
    "p as (select group_key, alike, row_number() over (partition by alike order by md5('0:' || group_key), group_key) - 1 place from q) "
    "select group_key, case when place < train then 'train' when place < train + val then 'val' else 'test' end split from p join a using (alike)",
    "images",
)
def d14_group_split(spark: SparkSession, d: str) -> DataFrame:
    keyed = view(spark, d, "images").withColumn("group_key", tx.group_key(F.col("filename")))
    return ds.assign_groups(keyed.groupBy("group_key", F.col("source").alias("class_id")).agg(F.count("*").alias("n")))


@query(f"select image_id, coalesce(e.g, {KEY}) group_key from images left join (select image_id i, 'explicit' || (image_id % 4) g from images where image_id % 6 = 0) e on e.i = image_id", "images")
def j26_explicit_groups(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images")
    given = i.where("image_id % 6 = 0").select("image_id", F.concat(F.lit("explicit"), F.col("image_id") % 4).alias("g"))
    return i.join(given, "image_id", "left").select("image_id", F.coalesce("g", tx.group_key(F.col("filename"))).alias("group_key"))


@query("select image_id, filename || case when r > 1 then '_' || (r - 1) else '' end unique_name from (select *, row_number() over (partition by filename order by image_id) r from images)", "images")
def w10_unique_names(spark: SparkSession, d: str) -> DataFrame:
    return ds.unique_names(view(spark, d, "images"), "filename", "image_id").select("image_id", "unique_name")


@query("select class_id from (select distinct source class_id from images where split = 'train') where class_id not in (select source from images where split = 'test' and image_id % 4 = 1)", "images")
def u3_absent_classes(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images").select(F.col("source").alias("class_id"), "split", "image_id")
    return i.where("split = 'train'").select("class_id").distinct().join(i.where("split = 'test' and image_id % 4 = 1"), "class_id", "left_anti")


@query("select round(f / (1 - f) * n)::bigint + (select count(*) from images) total, n from (select 0.2 f, count(*) n from images where split = 'train')", "images")
def u5_mix(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images").select("image_id", "filename", "split")
    out = ds.mix_synthetic(i, i, 0.2)
    return out.agg(F.count("*").alias("total"), F.count_if((F.col("split") == "train") & ~F.col("synthetic")).alias("n"))


@query("select image_id, case when a < 0.64 then 'train' when a < 0.8 then 'val' else 'test' end split from (select image_id, (row_number() over (partition by source order by md5('0:' || image_id), image_id) - 1) / count(*) over (partition by source) a from images)", "images")
def u9_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return ds.stratified_split(view(spark, d, "images"), "source", "image_id").select("image_id", "split")


@query("select image_id from images where image_id not in (select image_id from images where image_id % 3 = 0)", "images")
def u8_pending(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images").select("image_id")
    return i.join(i.where("image_id % 3 = 0"), "image_id", "left_anti")


@query("select image_id, case when coalesce(n, 0) = 0 then case when coalesce(u, false) then 'uncertain' else 'empty' end when u then 'uncertain' when r then 'review' else 'auto' end verdict, least from (select distinct image_id from detections) i left join (select image_id, count(*) filter (where not (class_id = 'plc' and det_id % 40 < 3)) n, bool_or(class_id = 'plc' and det_id % 40 < 3) u, bool_or(score < 0.35) r, min(score) least from (select * from detections where score >= 0.15 and det_id % 5 < 1 + image_id % 4) group by 1) using (image_id)", "detections")
def p20_triage(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").withColumn("class_id", F.when((F.col("class_id") == "plc") & (F.col("det_id") % 40 < 3), "unknown_industrial_component").otherwise(F.col("class_id")))
    rows = rows.withColumn("score", F.when(F.col("det_id") % 5 < 1 + F.col("image_id") % 4, F.col("score")).otherwise(0.0))
    return ds.triage(rows)[1]


@query(f"with {PARSED} select image_id from (select distinct image_id from label_lines) where image_id not in (select image_id from i where fatal is not null)", "label_lines")
def d12_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed(spark, d)
    fatal = F.exists("issues", lambda x: x.isin("malformed_row", "unparseable_row", "class_out_of_range", "centre_out_of_range", "degenerate_box", "box_exceeds_image"))
    issues = rows.select("image_id", F.when(fatal, "fatal").otherwise("warning").alias("severity"))
    return ds.quarantine(rows.select("image_id").distinct(), issues)[0]


@query("select image_id, det_id box_index, case when det_id % 9 = 1 then 'vfd' else class_id end class_id from detections where image_id % 7 <> 2 and image_id % 5 <> 0 and det_id % 9 <> 0", "detections")
def d18_export_reviewed(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "detections").select("image_id", F.col("det_id").alias("box_index"), "class_id")
    v = b.where("box_index % 9 < 3").select("image_id", "box_index", F.when(F.col("box_index") % 9 == 0, "reject").when(F.col("box_index") % 9 == 1, "relabel").otherwise("accept").alias("verdict"), F.lit("vfd").alias("class_id"))
    s = b.select("image_id").distinct().where("image_id % 5 <> 0").withColumn("state", F.when(F.col("image_id") % 7 == 2, "needs_redraw").otherwise("reviewed"))
    return ds.export_reviewed(b, v, s)


@query("select state, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from (select case when image_id % 5 = 0 then 'pending' when image_id % 7 = 2 then 'needs_redraw' else 'reviewed' end state from (select distinct image_id from detections)) group by 1", "detections")
def a31_review_progress(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "detections").select("image_id").distinct()
    s = i.select(F.when(F.col("image_id") % 5 == 0, "pending").when(F.col("image_id") % 7 == 2, "needs_redraw").otherwise("reviewed").alias("state"))
    return rp.review_progress(s).select("state", "n", R("share"))


SPACES = "n as (select p_type c, count(*) n, min(p_partkey) k from part group by 1), a as (select row_number() over (order by k) o, c from n), b as (select o, case when o = (select max(o) from a) // 2 then 'other' else c end c from a where o <= (select max(o) from a) * 4 // 5)"


@query(f"with {SPACES}, j as (select coalesce(a.o, b.o) o, a.c y, b.c x from a full join b on a.o = b.o) select count(*) filter (where x is not null and x is distinct from y) = 0 is_prefix, min(case when x is not null and x is distinct from y then o end) first_divergence, (select count(*) from (select c from a except select c from b)) n_added, (select count(*) from (select c from b except select c from a)) n_removed from j")
def u4_label_space(spark: SparkSession, d: str) -> DataFrame:
    """The types of all parts, in order of their first part, and an older space of four fifths of them with one renamed."""
    from pyspark.sql import Window

    n = table(spark, d, "part").groupBy(F.col("p_type").alias("class_id")).agg(F.min("p_partkey").alias("k"))
    a = n.select("class_id", F.row_number().over(Window.orderBy("k")).cast("long").alias("ordinal"))
    size = a.count()
    b = a.where(F.col("ordinal") <= size * 4 // 5).withColumn("class_id", F.when(F.col("ordinal") == size // 2, "other").otherwise(F.col("class_id")))
    return ds.label_space(b, a).select("is_prefix", "first_divergence", F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"))


@query("select image_id, sha from images", "images")
def s11_image_hash(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "images").select("image_id", "sha")


@query("select image_id, bit_count(xor(dhash, ahash))::bigint d from images", "images")
def f10_hamming(spark: SparkSession, d: str) -> DataFrame:
    from sightline.functions.geometry import hamming

    return view(spark, d, "images").select("image_id", hamming(F.col("dhash"), F.col("ahash")).cast("long").alias("d"))


@query("select i.image_id, g.n is not null has_label, coalesce(g.n, 0) n from (select distinct image_id from detections) i left join (select image_id, count(*) n from ground_truth where image_id % 4 <> 1 group by 1) g using (image_id)", "detections", "ground_truth")
def j5_image_label_join(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "detections").select("image_id").distinct()
    g = view(spark, d, "ground_truth").where("image_id % 4 <> 1").groupBy("image_id").agg(F.count("*").alias("n"))
    return i.join(g, "image_id", "left").select("image_id", F.col("n").isNotNull().alias("has_label"), F.coalesce("n", F.lit(0)).alias("n"))
