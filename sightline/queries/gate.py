"""Gate cascade and its steps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import gate
from sightline.registry import query
from sightline.views import FRAME_H, FRAME_W, view

#: IoU of boxes a and b as DuckDB text.
INTER = "greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
AREA = "(greatest(0.0, {a}.x2 - {a}.x1) * greatest(0.0, {a}.y2 - {a}.y1))"


def iou_sql(a: str, b: str) -> str:
    inter = INTER.format(a=a, b=b)
    return f"(case when {inter} <= 0 then 0.0 else {inter} / ({AREA.format(a=a)} + {AREA.format(a=b)} - {inter}) end)"


def contain_sql(a: str, b: str) -> str:
    """Share of b that lies in a."""
    return f"(case when {AREA.format(a=b)} > 0 then {INTER.format(a=a, b=b)} / {AREA.format(a=b)} else 0.0 end)"


SANITISED = f"""clean as (
  select image_id, det_id, class_id, source,
    case when ok then greatest(0.0, least(least(x1, x2), {FRAME_W} - 1.0)) else x1 end x1, case when ok then greatest(0.0, least(least(y1, y2), {FRAME_H} - 1.0)) else y1 end y1,
    case when ok then greatest(0.0, least(greatest(x1, x2), {FRAME_W}.0)) else x2 end x2, case when ok then greatest(0.0, least(greatest(y1, y2), {FRAME_H}.0)) else y2 end y2,
    least(score, 1.0) score, ok
  from (select *, not (isnan(x1) or isnan(x2) or isnan(y1) or isnan(y2)) ok from candidates)),
reasoned as (
  select *, case when not ok then 'non_finite_box' when x2 - x1 < 4 or y2 - y1 < 4 then 'degenerate_box' when score <= 0 then 'invalid_score' end drop_reason from clean)"""


def greedy_sql(source: str, keys: str, order: str, clash: str, name: str) -> str:
    """Recursive CTEs that take the rows of each group in order and keep those that clash with none kept before."""
    on = " and ".join(f"s.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    return f"""{name}_o as (select *, row_number() over (partition by {keys} order by {order}) n from {source}),
{name}_s as (
  select distinct {keys}, 0::bigint n, [] :: struct(det_id bigint, class_id varchar, x1 double, y1 double, x2 double, y2 double)[] kept from {name}_o
  union all
  select {', '.join('s.' + k.strip() for k in keys.split(','))}, o.n, case when len(list_filter(s.kept, lambda k: {clash})) > 0 then s.kept
    else list_append(s.kept, {{'det_id': o.det_id, 'class_id': o.class_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) end
  from {name}_s s join {name}_o o on {on} and o.n = s.n + 1),
{name} as (select c.* from {source} c join (select unnest(kept).det_id det_id from (select *, row_number() over (partition by {keys} order by n desc) r from {name}_s) where r = 1) k using (det_id))"""


CONFUSABLE = "(k.class_id = o.class_id or (k.class_id in ('contactor', 'overload_relay') and o.class_id in ('contactor', 'overload_relay')) or (k.class_id in ('mcb', 'plc') and o.class_id in ('mcb', 'plc')))"
#: The five classes of the test frames have no look-alikes among them; these stand in.
CFG = gate.GateConfig(confusable=(("contactor", "overload_relay"), ("mcb", "plc")))
CLAIMS = greedy_sql("nms", "image_id", "score desc, det_id", f"{CONFUSABLE} and ({iou_sql('k', 'o')} > 0.65 or {contain_sql('k', 'o')} > 0.8)", "claims")
NMS = greedy_sql("good", "image_id, class_id", "score desc, det_id", f"{iou_sql('k', 'o')} > 0.5", "nms")
GOOD = f"{SANITISED}, good as (select * from reasoned where drop_reason is null)"
JUDGED = f"""judged as (
  select c.* exclude (drop_reason, ok, class_id), c.class_id orig_class,
    case when reason is not null then reason when score < thr and score < 0.18 then 'below_unknown_floor' end drop_reason,
    case when reason is null and score < thr and score >= 0.18 then c.class_id end demoted_from,
    case when reason is null and score < thr and score >= 0.18 then 'unknown_industrial_component' else c.class_id end class_id
  from (select c.*, least(0.99, greatest(0.01, d.min_conf)) thr,
      case when (x2 - x1) / (y2 - y1) < d.ar_lo / 1.35 or (x2 - x1) / (y2 - y1) > d.ar_hi * 1.35 then 'implausible_aspect_ratio'
        when (x2 - x1) * (y2 - y1) / ({FRAME_W}.0 * {FRAME_H}.0) < d.area_lo / 2 then 'implausible_too_small'
        when (x2 - x1) * (y2 - y1) / ({FRAME_W}.0 * {FRAME_H}.0) > least(1.0, d.area_hi * 2) then 'implausible_too_large' end reason
    from {{source}} c join class_dim d on d.class_id = c.class_id) c)"""


def _good(spark: SparkSession, d: str) -> DataFrame:
    return gate.sanitise(view(spark, d, "candidates")).where("drop_reason is null").drop("drop_reason")


@query(f"with {SANITISED} select det_id, drop_reason, case when ok then x1 end x1, case when ok then y1 end y1, case when ok then x2 end x2, case when ok then y2 end y2, score from reasoned", "candidates")
def p6_sanitise(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("drop_reason") != "non_finite_box", F.lit(True))
    return gate.sanitise(view(spark, d, "candidates")).select("det_id", "drop_reason", *[F.when(ok, F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")], "score")


@query(f"with {GOOD}, {NMS} select image_id, det_id, class_id, score from nms", "candidates")
def j11_nms_per_class(spark: SparkSession, d: str) -> DataFrame:
    return gate.nms_per_class(_good(spark, d)).select("image_id", "det_id", "class_id", "score")


@query(f"with {greedy_sql('detections', 'image_id', '(x2 - x1) * (y2 - y1) desc, det_id', iou_sql('k', 'o') + ' >= 0.4', 'big')} select image_id, det_id, class_id from big", "detections")
def j31_nms_largest(spark: SparkSession, d: str) -> DataFrame:
    return gate.nms_largest(view(spark, d, "detections")).select("image_id", "det_id", "class_id")


@query(f"with {greedy_sql('detections', 'image_id', 'score desc, det_id', iou_sql('k', 'o') + ' > 0.45', 'any_class')} select image_id, det_id, class_id from any_class", "detections")
def j32_nms_any_class(spark: SparkSession, d: str) -> DataFrame:
    return gate.nms_any_class(view(spark, d, "detections")).select("image_id", "det_id", "class_id")


@query(
    "with g(a) as (select unnest([['mcb','mccb','acb','rcbo','rccb','motor_starter'],['vfd','soft_starter','servo_drive']])), p as (select unnest(a) x, a from g), q as (select x, unnest(a) y from p) "
    "select e.event_type, count(*) n, sum(case when q.x is not null then 1 else 0 end)::bigint alike from (select event_type, case event_type when 'click' then 'mcb' when 'error' then 'vfd' when 'purchase' then 'acb' else 'plc' end c1, "
    "case when event_id % 3 = 0 then 'mccb' when event_id % 3 = 1 then 'soft_starter' else 'plc' end c2 from events) e left join q on q.x = c1 and q.y = c2 or (q.x = 'mcb' and q.y = 'mcb' and c1 = 'plc' and c2 = 'plc') group by event_type"
)
def j12_confusable(spark: SparkSession, d: str) -> DataFrame:
    c1 = F.when(F.col("event_type") == "click", "mcb").when(F.col("event_type") == "error", "vfd").when(F.col("event_type") == "purchase", "acb").otherwise("plc")
    c2 = F.when(F.col("event_id") % 3 == 0, "mccb").when(F.col("event_id") % 3 == 1, "soft_starter").otherwise("plc")
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("alike", gate.confusable(c1, c2))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("alike").cast("long")).alias("alike"))


@query(f"with {GOOD}, {NMS}, {CLAIMS} select image_id, det_id, class_id, score from claims", "candidates")
def d2_resolve_claims(spark: SparkSession, d: str) -> DataFrame:
    return gate.resolve_claims(gate.nms_per_class(_good(spark, d)), CFG).select("image_id", "det_id", "class_id", "score")


@query(f"with {GOOD}, {JUDGED.format(source='good')} select det_id, case when drop_reason like 'implausible%' then drop_reason end drop_reason from judged", "candidates", "class_dim")
def p7_plausibility(spark: SparkSession, d: str) -> DataFrame:
    rows = gate.judge(_good(spark, d), view(spark, d, "class_dim"))
    return rows.select("det_id", F.when(F.col("drop_reason").startswith("implausible"), F.col("drop_reason")).alias("drop_reason"))


@query(f"with {GOOD}, {JUDGED.format(source='good')} select det_id, class_id, demoted_from, drop_reason from judged where drop_reason is null or drop_reason = 'below_unknown_floor'", "candidates", "class_dim")
def p8_confidence(spark: SparkSession, d: str) -> DataFrame:
    return gate.judge(_good(spark, d), view(spark, d, "class_dim")).select("det_id", "class_id", "demoted_from", "drop_reason").where("drop_reason is null or drop_reason = 'below_unknown_floor'")


@query("select image_id, det_id, rank, rank > 15 over_cap from (select *, row_number() over (partition by image_id order by score desc, det_id) rank from detections)", "detections")
def t11_cap(spark: SparkSession, d: str) -> DataFrame:
    return gate.cap_per_image(view(spark, d, "detections"), 15).select("image_id", "det_id", F.col("rank").cast("long").alias("rank"), "over_cap")


ROWS = """ordered as (select *, row_number() over (partition by image_id order by (y1 + y2) / 2, score desc, det_id) n, (y1 + y2) / 2 cy from {source}),
bands as (select image_id, median(y2 - y1) * 0.6 band from {source} group by image_id),
walk as (
  select distinct image_id, 0::bigint n, 0 row_no, 0.0::double total, 0 k, null::bigint det_id from ordered
  union all
  select w.image_id, o.n, case when w.k > 0 and abs(o.cy - w.total / w.k) <= b.band then w.row_no else w.row_no + 1 end,
    case when w.k > 0 and abs(o.cy - w.total / w.k) <= b.band then w.total + o.cy else o.cy end,
    case when w.k > 0 and abs(o.cy - w.total / w.k) <= b.band then w.k + 1 else 1 end, o.det_id
  from walk w join ordered o on o.image_id = w.image_id and o.n = w.n + 1 join bands b on b.image_id = w.image_id),
placed as (select d.*, w.row_no, row_number() over (partition by d.image_id, w.row_no order by (x1 + x2) / 2, score desc, det_id) pos_in_row from {source} d join walk w using (image_id, det_id))"""


@query(f"with {ROWS.format(source='detections')} select image_id, det_id, row_no from placed", "detections")
def w2_row_clusters(spark: SparkSession, d: str) -> DataFrame:
    return gate.group_rows(view(spark, d, "detections")).select("image_id", "det_id", "row_no")


@query(f"with {ROWS.format(source='detections')} select det_id, row_no, pos_in_row from placed", "detections")
def w3_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return gate.group_rows(view(spark, d, "detections")).select("det_id", "row_no", F.col("pos_in_row").cast("long").alias("pos_in_row"))


GATED = f"""{GOOD}, {NMS}, {CLAIMS}, {JUDGED.format(source='claims')}, accepted as (select * from judged where drop_reason is null), {ROWS.format(source='accepted')},
gated as (
  select det_id, class_id, score, null drop_reason, demoted_from, row_no, pos_in_row from placed
  union all select det_id, class_id, score, drop_reason, null, null, null from judged where drop_reason is not null
  union all select det_id, class_id, score, drop_reason, null, null, null from reasoned where drop_reason is not null
  union all select det_id, class_id, score, 'nms_same_class', null, null, null from good where det_id not in (select det_id from nms)
  union all select det_id, class_id, score, 'duplicate_class_claim', null, null, null from nms where det_id not in (select det_id from claims))"""


@query(f"with {GATED} select det_id, class_id, score, drop_reason, demoted_from, row_no, pos_in_row from gated", "candidates", "class_dim")
def d1_gate_cascade(spark: SparkSession, d: str) -> DataFrame:
    out = gate.cascade(view(spark, d, "candidates"), view(spark, d, "class_dim"), CFG)
    return out.select("det_id", "class_id", "score", "drop_reason", "demoted_from", "row_no", F.col("pos_in_row").cast("long").alias("pos_in_row"))


@query(f"with {GATED} select coalesce(drop_reason, 'accepted') reason, count(*) n from gated group by 1 union all select 'relabelled_unknown', count(*) from gated where drop_reason is null and demoted_from is not null", "candidates", "class_dim")
def a12_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return gate.diagnostics(gate.cascade(view(spark, d, "candidates"), view(spark, d, "class_dim"), CFG))


@query(
    f"with n as (select a.image_id, a.det_id, count(distinct b.source) n from detections a join detections b on a.image_id = b.image_id and a.class_id = b.class_id and a.source <> b.source and {iou_sql('a', 'b')} >= 0.55 group by all) "
    "select d.det_id, coalesce(n, 0) n_sources, round(case when n > 0 then least(0.99, score + (1 - score) * 0.35 * n) else score end, 6) fused_score from detections d left join n using (image_id, det_id)",
    "detections",
)
def j22_agreement(spark: SparkSession, d: str) -> DataFrame:
    return gate.agree_across_sources(view(spark, d, "detections")).select("det_id", "n_sources", F.round("fused_score", 6).alias("fused_score"))


@query(
    """with p as (select a.det_id, a.x1, a.y1, a.x2, a.y2, a.x1 + (a.det_id % 9) * 8 - 20 nx1, a.y1 + (a.det_id % 7) * 10 - 20 ny1, a.x2 + (a.det_id % 5) * 15 - 40 nx2, a.y2 + (a.det_id % 4) * 20 - 60 ny2, d.ar_lo, d.ar_hi from detections a join class_dim d using (class_id))
    select det_id, case when nx2 - nx1 <= 1 or ny2 - ny1 <= 1 then 'degenerate' when ratio > 1.6 then 'grew_too_much' when ratio < 0.35 then 'shrank_too_much'
      when sqrt(power((x1 + x2) / 2 - (nx1 + nx2) / 2, 2) + power((y1 + y2) / 2 - (ny1 + ny2) / 2, 2)) > 0.35 * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) then 'moved_too_far'
      when (nx2 - nx1) / (ny2 - ny1) < ar_lo / 1.5 or (nx2 - nx1) / (ny2 - ny1) > ar_hi * 1.5 then 'implausible_shape' end reason
    from (select *, greatest(0.0, nx2 - nx1) * greatest(0.0, ny2 - ny1) / ((x2 - x1) * (y2 - y1)) ratio from p)""",
    "detections",
    "class_dim",
)
def p10_refinement_guard(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("det_id")
    rows = view(spark, d, "detections").join(F.broadcast(view(spark, d, "class_dim")), "class_id")
    new = (F.col("x1") + (i % 9) * 8 - 20, F.col("y1") + (i % 7) * 10 - 20, F.col("x2") + (i % 5) * 15 - 40, F.col("y2") + (i % 4) * 20 - 60)
    return rows.select("det_id", gate.refine_reason(g.box(), new, F.col("ar_lo"), F.col("ar_hi")).alias("reason"))
