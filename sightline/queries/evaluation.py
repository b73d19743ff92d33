"""Detection evaluation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import evaluation as ev
from sightline.plans.lineage import materialize
from sightline.queries.gate import iou_sql
from sightline.registry import query
from sightline.views import view


def match_sql(thr: float | str, same_class: bool = True, name: str = "matched") -> str:
    keys = ["image_id", "class_id"] if same_class else ["image_id"]
    k, on = ", ".join(keys), " and ".join(f"s.{x} = p.{x}" for x in keys)
    cls = "and g.class_id = p.class_id" if same_class else ""
    return f"""{name}_o as (select p.image_id, p.det_id, list(g.gt_id order by {iou_sql('p', 'g')} desc, g.gt_id desc) opts from detections p join ground_truth g on g.image_id = p.image_id {cls} and {iou_sql('p', 'g')} >= {thr} group by all),
{name}_p as (select d.image_id, d.class_id, d.det_id, d.score, coalesce(opts, []::bigint[]) opts, row_number() over (partition by {', '.join('d.' + x for x in keys)} order by score desc, det_id) n from detections d left join {name}_o using (image_id, det_id)),
{name}_s as (
  select distinct {k}, 0::bigint n, []::bigint[] used, null::bigint det_id, null::bigint gt_id from {name}_p
  union all
  select {', '.join('s.' + x for x in keys)}, p.n, case when len(list_filter(p.opts, lambda o: not list_contains(s.used, o))) > 0 then list_append(s.used, list_filter(p.opts, lambda o: not list_contains(s.used, o))[1]) else s.used end,
    p.det_id, list_filter(p.opts, lambda o: not list_contains(s.used, o))[1]
  from {name}_s s join {name}_p p on {on} and p.n = s.n + 1),
{name} as (select p.image_id, p.det_id, p.class_id, p.score, s.gt_id from {name}_p p join {name}_s s using (image_id, det_id))"""


AP = """support as (select class_id, count(*) n_gt from ground_truth group by 1),
run as (select *, sum(case when gt_id is not null then 1 else 0 end) over w ct, row_number() over w cn from {m} window w as (partition by class_id order by score desc, image_id, det_id rows unbounded preceding)),
env as (select *, ct / cn prec, max(ct / cn) over (partition by class_id order by score desc, image_id, det_id rows between current row and unbounded following) envelope from run),
ap as (select s.class_id, coalesce(sum(case when gt_id is not null then envelope end) / any_value(n_gt), 0.0) ap from support s left join env e on e.class_id = s.class_id group by 1)"""
COUNTS = """counts as (select coalesce(m.class_id, s.class_id) class_id, coalesce(tp, 0) tp, coalesce(n, 0) - coalesce(tp, 0) fp, greatest(0, coalesce(n_gt, 0) - coalesce(tp, 0)) fn, coalesce(n_gt, 0) support
  from (select class_id, count(gt_id) tp, count(*) n from {m} group by 1) m full join (select class_id, count(*) n_gt from ground_truth group by 1) s on s.class_id = m.class_id),
rated as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end r from counts)"""
F1 = "case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end"
R = lambda c: F.round(c, 6).alias(c)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "ground_truth"), view(spark, d, "detections")


@query(f"with {match_sql(0.5)} select image_id, det_id, class_id, score, gt_id from matched", "detections", "ground_truth")
def j19_match(spark: SparkSession, d: str) -> DataFrame:
    return ev.match(*_both(spark, d)).select("image_id", "det_id", "class_id", "score", "gt_id")


@query(f"with {match_sql(0.5)}, {AP.format(m='matched')} select det_id, ct::bigint cum_tp, cn cum_n, round(prec, 6) \"precision\", round(envelope, 6) envelope from env", "detections", "ground_truth")
def w1_precision_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.precision_curve(ev.match(*_both(spark, d))).select("det_id", "cum_tp", "cum_n", R("precision"), R("envelope"))


@query(f"with {match_sql(0.5)}, {AP.format(m='matched')} select class_id, round(ap, 6) ap from ap", "detections", "ground_truth")
def a24_average_precision(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return ev.average_precision(ev.match(t, p), t).select("class_id", R("ap"))


@query(f"with {match_sql(0.5)}, {COUNTS.format(m='matched')} select class_id, tp, fp, fn, support, round(p, 6) \"precision\", round(r, 6) recall, round({F1}, 6) f1 from rated", "detections", "ground_truth")
def a22_rates(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return ev.class_counts(ev.match(t, p), t).select("class_id", "tp", "fp", "fn", "support", R("precision"), R("recall"), R("f1"))


@query(f"with {match_sql(0.5)}, {COUNTS.format(m='matched')} select round(avg(p), 6) macro_precision, round(avg(r), 6) macro_recall, round(avg({F1}), 6) macro_f1 from rated where support > 0", "detections", "ground_truth")
def a23_macro(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return ev.class_counts(ev.match(t, p), t).where("support > 0").agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def evaluation_sql() -> str:
    matches = ", ".join(match_sql(t, name=f"m{round(t * 100)}") for t in ev.COCO_IOUS)
    every = " union all ".join(f"select {t} thr, * from m{round(t * 100)}" for t in ev.COCO_IOUS)
    return f"""with {matches}, every as ({every}), support as (select class_id, count(*) n_gt from ground_truth group by 1),
    run as (select *, sum(case when gt_id is not null then 1 else 0 end) over w ct, row_number() over w cn from every window w as (partition by thr, class_id order by score desc, image_id, det_id rows unbounded preceding)),
    env as (select *, max(ct / cn) over (partition by thr, class_id order by score desc, image_id, det_id rows between current row and unbounded following) envelope from run),
    ap as (select t.thr, s.class_id, coalesce(sum(case when gt_id is not null then envelope end) / any_value(n_gt), 0.0) ap from support s cross join (select distinct thr from every) t left join env e on e.class_id = s.class_id and e.thr = t.thr group by 1, 2),
    by_thr as (select thr, avg(ap) m from ap group by 1), {COUNTS.format(m='m50')},
    total as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end r from (select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from counts))
    select 'class' "scope", c.class_id, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round({F1}, 6) f1, round(coalesce(ap, 0.0), 6) ap, null::double map_50_95 from rated c left join ap on ap.class_id = c.class_id and thr = 0.5
    union all select 'overall', null, tp, fp, fn, round(p, 6), round(r, 6), round({F1}, 6), round((select m from by_thr where thr = 0.5), 6), round((select avg(m) from by_thr), 6) from total"""


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    return ev.evaluate(*_both(spark, d)).select("scope", "class_id", "tp", "fp", "fn", R("precision"), R("recall"), R("f1"), R("ap"), R("map_50_95"))


@query(evaluation_sql(), "detections", "ground_truth")
def d5_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d)


@query(evaluation_sql().split("select 'class'")[0] + " select thr::double thr, round(m, 6) map from by_thr", "detections", "ground_truth")
def a25_map_by_iou(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return ev.average_precisions(materialize(ev.match_each(t, p, ev.COCO_IOUS), "matches"), t, ev.COCO_IOUS).groupBy("thr").agg(F.round(F.avg("ap"), 6).alias("map"))


@query(
    f"with {match_sql(0.5, False)} select gt_class, class_id, count(*) n from (select coalesce(g.class_id, '__background__') gt_class, m.class_id from matched m left join ground_truth g on g.gt_id = m.gt_id "
    "union all select class_id, '__background__' from ground_truth where gt_id not in (select gt_id from matched where gt_id is not null)) group by 1, 2",
    "detections",
    "ground_truth",
)
def a21_confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(*_both(spark, d))


@query(
    f"with {match_sql(0.5)}, best as (select m.det_id, m.class_id, coalesce(max({iou_sql('p', 'g')}), 0.0) v from matched m join detections p on p.det_id = m.det_id left join ground_truth g on g.image_id = m.image_id where m.gt_id is null group by 1, 2) "
    "select class_id, case when v >= 0.5 then 'class_confusion' when v >= 0.1 then 'localisation' else 'spurious_detection' end cause, count(*) n from best group by 1, 2",
    "detections",
    "ground_truth",
)
def a26_false_positive_causes(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return ev.false_positive_causes(ev.match(t, p), t, p).groupBy("class_id", "cause").agg(F.count("*").alias("n"))


@query(
    f"""with {match_sql(0.5)}, grid as (select round(0.05 * k, 2)::double t from range(1, 20) r(k)), n_gt as (select class_id, count(*) n_gt from ground_truth group by 1),
    pts as (select c.class_id, t, count(m.gt_id) tp, count(m.det_id) n, any_value(c.n_gt) n_gt from (select distinct d.class_id, coalesce(n_gt, 0) n_gt from detections d left join n_gt using (class_id)) c cross join grid left join matched m on m.class_id = c.class_id and m.score >= t group by 1, 2),
    rt as (select *, n - tp fp, n_gt - tp fn, case when n > 0 then tp / n else 0.0 end p, case when n_gt > 0 then tp / n_gt else 0.0 end r from pts),
    rk as (select *, {F1} f1, row_number() over (partition by class_id order by {F1} desc, t) k from rt)
    select class_id, t "threshold", tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round(f1, 6) f1 from rk where k = 1""",
    "detections",
    "ground_truth",
)
def w9_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_thresholds(*_both(spark, d)).select("class_id", "threshold", "tp", "fp", "fn", R("precision"), R("recall"), R("f1"))
