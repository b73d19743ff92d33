"""Inventories of panels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import panel_rules as rules
from sightline.operators import inventory as inv
from sightline.registry import query
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
values = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
RULES = f"rules(rule, ordinal, class_id, weight, cap) as (values {values(rules.rule_rows())}), keys(rule, class_id) as (values {values([(r, c) for r, x in rules.KEYSTONES.items() for c in x])}), expected(rule, class_id) as (values {values([(r, c) for r, x in rules.EXPECTED.items() for c in x])})"
INV = "inv as (select image_id, class_id, count(*) n from panel_boxes group by 1, 2)"
SCORES = """raw as (select i.image_id, r.rule, sum(weight * sqrt(least(n, cap))) raw from inv i join rules r using (class_id) group by 1, 2),
sc as (select p.image_id, r.rule, r.ordinal, greatest(0.0, coalesce(raw, 0.0) * case when exists (select 1 from inv i join keys k using (class_id) where i.image_id = p.image_id and k.rule = r.rule) then 1.0 else 0.3 end) score
  from (select distinct image_id from inv) p cross join (select distinct rule, ordinal from rules) r left join raw on raw.image_id = p.image_id and raw.rule = r.rule)"""
TYPES = """best as (select *, score / nullif(sum(score) over (partition by image_id), 0) share, row_number() over (partition by image_id order by round(score, 9) desc, ordinal) k from sc),
types as (select b.image_id, case when n < 3 then 'unclassified' when coalesce(share, 0) < 0.22 then 'unclassified' else rule end panel_type, case when n < 3 then 0.0 else coalesce(share, 0) end confidence,
  case when n < 3 then 'insufficient_evidence' when coalesce(share, 0) < 0.22 then 'ambiguous_composition' end reason from best b join (select image_id, sum(n) n from inv group by 1) using (image_id) where k = 1)"""
IMPORTANT = ", ".join(map(repr, rules.IMPORTANT_ABSENCES))
MISSING = f"gone as (select t.image_id, e.class_id, case when e.class_id in ({IMPORTANT}) then 'important' else 'advisory' end severity from types t join expected e on e.rule = t.panel_type where not exists (select 1 from inv i where i.image_id = t.image_id and i.class_id = e.class_id))"


def _dets(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "panel_boxes")


def _inv(spark: SparkSession, d: str) -> DataFrame:
    return inv.counts(_dets(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    out = inv.rule_scores(_inv(spark, d), rules.rule_weights(spark), rules.rule_classes(spark, rules.KEYSTONES))
    return out.withColumn("score", F.round("score", 9))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return inv.classify(_scores(spark, d), _inv(spark, d).groupBy("image_id").agg(F.sum("n").alias("n")))


def _missing(spark: SparkSession, d: str) -> DataFrame:
    return inv.missing(_types(spark, d), _inv(spark, d), rules.rule_classes(spark, rules.EXPECTED), rules.IMPORTANT_ABSENCES)


@query("select image_id, class_id, quantity, round(m, 9) mean_confidence, lo min_confidence, hi max_confidence, makers, indices, row_number() over (partition by image_id order by countable desc, quantity desc, class_id) place from (select image_id, d.class_id, count(*) quantity, avg(score) m, min(score) lo, max(score) hi, string_agg(distinct source, ',' order by source) makers, string_agg(det_id, ',' order by det_id) indices, any_value(countable) countable from detections d join class_dim using (class_id) group by 1, 2)", "detections", "class_dim")
def a8_bill_of_materials(spark: SparkSession, d: str) -> DataFrame:
    out = inv.bill_of_materials(view(spark, d, "detections").withColumn("maker", F.col("source")), view(spark, d, "class_dim"))
    return out.select("image_id", "class_id", "quantity", F.round("mean_confidence", 9).alias("mean_confidence"), "min_confidence", "max_confidence", F.array_join("makers", ",").alias("makers"), F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"), F.col("place").cast("long").alias("place"))


@query("select category, count(*) quantity from detections join class_dim using (class_id) group by 1", "detections", "class_dim")
def a9_by_category(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").join(F.broadcast(view(spark, d, "class_dim")), "class_id").groupBy("category").agg(F.count("*").alias("quantity"))


@query("select image_id, count(*) n, round(avg(score), 6) mean, round(median(score), 6) median, min(score) least, max(score) most, count(*) filter (where score < 0.5) low, 0::bigint \"unknown\" from detections group by 1", "detections")
def a10_confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    return inv.confidence_stats(view(spark, d, "detections")).select("image_id", "n", R("mean"), R("median"), "least", "most", "low", "unknown")


@query("select image_id, class_id, count(*) n from detections group by 1, 2", "detections")
def a11_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return inv.counts(view(spark, d, "detections"))


@query(f"with {RULES}, {INV}, {SCORES} select image_id, rule, round(score, 6) score from sc", "detections")
def a35_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("image_id", "rule", R("score"))


@query(f"with {RULES}, {INV}, {SCORES}, {TYPES} select image_id, panel_type, round(confidence, 6) confidence, reason from types", "detections")
def a36_panel_type(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).select("image_id", "panel_type", R("confidence"), "reason")


@query(f"with {RULES}, {INV}, {SCORES} select image_id, rule, round(score / nullif(sum(score) over (partition by image_id), 0), 6) share from sc", "detections")
def w13_share(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return _scores(spark, d).select("image_id", "rule", F.round(F.try_divide("score", F.sum("score").over(Window.partitionBy("image_id"))), 6).alias("share"))


@query(f"with {RULES}, {INV}, {SCORES} select image_id, rule, place from (select *, row_number() over (partition by image_id order by round(score, 9) desc, ordinal) place from sc) where place <= 3", "detections")
def t3_top_types(spark: SparkSession, d: str) -> DataFrame:
    return inv.top_types(_scores(spark, d)).select("image_id", "rule", F.col("place").cast("long").alias("place"))


@query(f"with {RULES}, {INV}, {SCORES}, {TYPES}, {MISSING} select image_id, class_id, severity from gone", "detections")
def j6_missing_components(spark: SparkSession, d: str) -> DataFrame:
    return _missing(spark, d)


PATTERNS = (("the th", "pumping"), ("ing of|der ", "hvac"), ("ción", "lifting"))
HINTS = (("pumping", ("contactor", "overload_relay")), ("lighting", ("contactor", "plc", "mcb")))


@query(
    f"with {INV}, t as (select doc_id image_id, lower(text) text from documents), v as ("
    + " union all ".join(f"select image_id, '{a}' application, 2.0 votes from t where regexp_matches(text, '{p}')" for p, a in PATTERNS)
    + "".join(f" union all select image_id, '{a}', 0.6 * count(*) from inv where class_id in ({', '.join(map(repr, c))}) group by 1 having count(*) >= 2" for a, c in HINTS)
    + ") select image_id, application, round(sum(votes), 6)::double votes from v group by 1, 2",
    "detections",
)
def a37_applications(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "text")
    return inv.applications(_inv(spark, d), texts, PATTERNS, HINTS).select("image_id", "application", R("votes"))


SAFETY = ", ".join(map(repr, rules.SAFETY_CRITICAL))


@query(
    f"""with {RULES}, {INV}, {SCORES}, {TYPES}, {MISSING},
    st as (select image_id, count(*) n, avg(score) mean, count(*) filter (where class_id = 'plc' and det_id % 2 = 0) unk from panel_boxes group by 1),
    wm as (select image_id, sum(case severity when 'important' then 3.0 else 1.0 end + case when class_id in ({SAFETY}) then 1.5 else 0 end) w from gone group by 1),
    wn as (select image_id, sum(case when det_id % 11 = 0 then 2.5 when det_id % 7 = 0 then 1.0 else 0.25 end) w from detections where det_id % 13 = 0 group by 1),
    s as (select st.image_id, n > 0 and unk / n < 0.5 ok, case when unk / n >= 0.2 then 1 + 2 * unk / n else 0 end + case when mean < 0.55 then 1 else 0 end + case when n >= 4 then coalesce(wm.w, 0) else 0 end + coalesce(wn.w, 0) score from st left join wm using (image_id) left join wn using (image_id))
    select image_id, round(case when ok then score else 0 end, 6)::double score, case when not ok then 'unknown' when score >= 9 then 'high' when score >= 5 then 'elevated' when score >= 2 then 'moderate' else 'low' end "level", ok assessable from s""",
    "detections",
)
def a38_risk(spark: SparkSession, d: str) -> DataFrame:
    dets = _dets(spark, d).withColumn("class_id", F.when((F.col("class_id") == "plc") & (F.col("det_id") % 2 == 0), inv.UNKNOWN).otherwise(F.col("class_id")))
    i = F.col("det_id")
    notes = view(spark, d, "detections").where("det_id % 13 = 0").select("image_id", F.when(i % 11 == 0, "important").when(i % 7 == 0, "advisory").otherwise("info").alias("severity"))
    out = inv.risk(inv.confidence_stats(dets), _missing(spark, d), notes, rules.SAFETY_CRITICAL)
    return out.select("image_id", R("score"), "level", "assessable")


@query("select det_id, coalesce(category, 'unknown') category from (select det_id, case when det_id % 10 = 0 then 'odd' else class_id end class_id from detections) left join class_dim using (class_id)", "detections", "class_dim")
def j9_dimension_default(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").select("det_id", F.when(F.col("det_id") % 10 == 0, "odd").otherwise(F.col("class_id")).alias("class_id"))
    return rows.join(F.broadcast(view(spark, d, "class_dim")), "class_id", "left").select("det_id", F.coalesce("category", F.lit("unknown")).alias("category"))


@query("select class_id, max(n) expected from (select image_id, class_id, count(*) n from detections group by 1, 2) group by 1", "detections")
def a30_template(spark: SparkSession, d: str) -> DataFrame:
    return inv.counts(view(spark, d, "detections")).groupBy("class_id").agg(F.max("n").alias("expected"))


@query("select a.det_id, string_agg(distinct b.class_id, ',' order by b.class_id) neighbours from detections a join detections b on a.image_id = b.image_id and a.det_id <> b.det_id and abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) <= 2.8 * (a.x2 - a.x1) and abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= 2.8 * (a.y2 - a.y1) group by 1", "detections")
def j14_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from sightline.functions import geometry as g

    a = view(spark, d, "detections")
    b = a.select("image_id", F.col("det_id").alias("other"), F.col("class_id").alias("oclass"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    (ax, ay), (bx, by) = g.centre(g.box()), g.centre(g.box("o"))
    near = (F.col("det_id") != F.col("other")) & (F.abs(ax - bx) <= 2.8 * g.width(g.box())) & (F.abs(ay - by) <= 2.8 * g.height(g.box()))
    return a.join(b, "image_id").where(near).groupBy("det_id").agg(F.array_join(F.array_sort(F.collect_set("oclass")), ",").alias("neighbours"))


@query("select det_id, case when (y1 + y2) / 2 < 256 then 'top' when (y1 + y2) / 2 < 512 then 'middle' else 'bottom' end || '-' || case when (x1 + x2) / 2 < 1024.0 / 3 then 'left' when (x1 + x2) / 2 < 2048.0 / 3 then 'center' else 'right' end position from detections", "detections")
def f4_position(spark: SparkSession, d: str) -> DataFrame:
    from sightline.functions import geometry as g

    return view(spark, d, "detections").select("det_id", g.position_label(g.box(), 1024, 768).alias("position"))
