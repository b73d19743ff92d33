"""Operating points, model selection, rankings and rules on single rows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import checks
from sightline.functions import geometry as g
from sightline.operators import gate
from sightline.operators import inventory as inv
from sightline.operators import reports as rp
from sightline.operators import selection as sel
from sightline.queries.evaluation import match_sql
from sightline.queries.gate import CFG, CLAIMS, GATED, JUDGED, NMS, SANITISED, iou_sql
from sightline.registry import query
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
MODELS = "models as (select p_brand label, avg(p_retailprice) / 2500 map_50_95, avg(p_retailprice) / 2000 map_50, avg(p_size) / 50 f1 from part group by 1), prof as (select p_brand label, case when p_brand like '%5' then null else avg(p_size) * 20 end latency from part group by 1)"
WORD = "select label, round((0.45 * map_50_95 + 0.2 * map_50 + 0.2 * f1) / 0.85, 6) s from models"


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("label"))
    evals = p.agg((F.avg("p_retailprice") / 2500).alias("map_50_95"), (F.avg("p_retailprice") / 2000).alias("map_50"), (F.avg("p_size") / 50).alias("f1"))
    prof = p.agg((F.avg("p_size") * 20).alias("latency")).withColumn("latency", F.when(~F.col("label").endswith("5"), F.col("latency")))
    return evals, prof


@query(f"with {MODELS} select label, case when latency is null then null when latency <= 10 then 1.0 when latency >= 540 then 0.0 else round(1 - ln(latency / 10) / ln(54.0), 6) end::double speed from prof")
def f20_speed_score(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d)[1].select("label", R(sel.speed_score(F.col("latency"), 540.0), "speed"))


@query(
    f"""with {MODELS}, j as (select m.*, latency, case when latency is null then null when latency <= 10 then 1.0 when latency >= 540 then 0.0 else 1 - ln(latency / 10) / ln(54.0) end speed from models m left join prof using (label)),
    s as (select label, case when map_50_95 < 0.5 then 'accuracy_floor' when latency > 540 then 'latency_budget' end disqualified, case when speed is null then (0.45 * map_50_95 + 0.2 * map_50 + 0.2 * f1) / 0.85 else 0.45 * map_50_95 + 0.2 * map_50 + 0.2 * f1 + 0.15 * speed end sc from j),
    t as (select label, disqualified, case when disqualified is null then sc end score from s)
    select label, round(score, 6) score, disqualified, case when score is not null then row_number() over (order by score desc nulls last, label) end place from t"""
)
def t9_select_model(spark: SparkSession, d: str) -> DataFrame:
    return sel.select_model(*_models(spark, d), budget=540.0, least_map=0.5).select("label", R("score"), "disqualified", F.col("place").cast("long").alias("place"))


@query(f"with {MODELS} select label, map_50_95, latency from models left join prof using (label)".replace("map_50_95, latency from", "round(map_50_95, 6) map_50_95, round(latency, 6) latency from"))
def j28_models_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    e, p = _models(spark, d)
    return e.join(p, "label", "left").select("label", R("map_50_95"), R("latency"))


@query(f"with {MODELS} select label, row_number() over (order by map_50_95 desc, f1 desc, label) place from models")
def t7_rank_models(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.desc("map_50_95"), F.desc("f1"), "label")
    return _models(spark, d)[0].select("label", F.row_number().over(w).cast("long").alias("place"))


@query(f"with {MODELS}, s as (select label, map_50 from models where label not like '%1'), r as (select label, f1 map_50 from models where label not like '%2') select coalesce(s.label, r.label) label, round(s.map_50 - r.map_50, 6) gap, case when r.map_50 is null then 'no_real_evaluation' when s.map_50 is null then 'no_synthetic_evaluation' when s.map_50 - r.map_50 <= 0.05 then 'small' when s.map_50 - r.map_50 >= 0.5 then 'meaningless' else 'substantial' end verdict from s full join r on s.label = r.label")
def j29_domain_gap(spark: SparkSession, d: str) -> DataFrame:
    e = _models(spark, d)[0]
    out = sel.domain_gap(e.where("label not like '%1'"), e.where("label not like '%2'").withColumn("map_50", F.col("f1")))
    return out.select("label", R("gap"), "verdict")


@query("with s as (select case when p_brand = 'Brand#11' then 'real_only' else p_brand end strategy, avg(p_size) / 50 map_50, avg(p_retailprice) / 2500 map_50_95 from part group by 1), r as (select *, row_number() over (order by map_50 desc, map_50_95 desc, strategy) place from s) select strategy, round(map_50, 6) map_50, place, coalesce(place = 1 and strategy <> 'real_only' and round(map_50 - (select map_50 from s where strategy = 'real_only'), 4) > 0.02, false) helped from r")
def t10_rank_strategies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy(F.when(F.col("p_brand") == "Brand#11", "real_only").otherwise(F.col("p_brand")).alias("strategy")).agg((F.avg("p_size") / 50).alias("map_50"), (F.avg("p_retailprice") / 2500).alias("map_50_95"))
    return sel.rank_strategies(s).select("strategy", R("map_50"), F.col("place").cast("long").alias("place"), "helped")


@query(f"with {GATED} select count(*) raw, (select count(*) from candidates where not coalesce(score >= 0.1, false) and not isnan(score)) + (select count(*) from candidates where isnan(score)) below_floor, null::bigint x from candidates".replace(", null::bigint x", ""), "candidates", "class_dim")
def p9_decode_floor(spark: SparkSession, d: str) -> DataFrame:
    out = sel.accounting(sel.replay(view(spark, d, "candidates"), view(spark, d, "class_dim"), 0.1, CFG))
    return out.select("raw", "below_floor")


@query(f"with {GATED} select count(*) raw, count(*) filter (where drop_reason is not null) by_gate, count(*) filter (where drop_reason is null and demoted_from is null) asserted, count(*) filter (where demoted_from is not null) \"unknown\", round(count(*) filter (where demoted_from is not null) / count(*) filter (where drop_reason is null), 6) unknown_rate from gated", "candidates", "class_dim")
def a27_accounting(spark: SparkSession, d: str) -> DataFrame:
    out = sel.accounting(sel.replay(view(spark, d, "candidates"), view(spark, d, "class_dim"), -1.0, CFG))
    return out.select("raw", "by_gate", "asserted", "unknown", R("unknown_rate"))


DECODE, MAYBE, STRICT = (0.1, 0.3), (0.1, 0.2), (0.8, 1.0, 1.2)
_values = lambda of: ", ".join(f"({x}::double)" for x in of)
#: The sweep with a row for each box and grid point.
SWEEP = f"""{SANITISED.replace("from candidates", "from detections")}, good as (select * from reasoned where drop_reason is null and score >= 0.1), {NMS}, {CLAIMS}, {JUDGED.format(source="claims")},
plausible as (select c.* from claims c join judged j using (det_id) where j.drop_reason is null or j.drop_reason = 'below_unknown_floor'), {match_sql(0.5).replace("detections", "plausible")},
points as (select d, u, s from (values {_values(DECODE)}) a(d) cross join (values {_values(MAYBE)}) b(u) cross join (values {_values(STRICT)}) c(s)),
boxes as (select d, u, s, m.*, score >= greatest(0.01, least(0.99, min_conf::double * s)) sure from matched m join class_dim using (class_id) cross join points where score >= d),
run as (select *, count(gt_id) over w / count(*) over w prec from boxes where sure window w as (partition by d, u, s, class_id order by score desc, image_id, det_id rows unbounded preceding)),
env as (select *, max(prec) over (partition by d, u, s, class_id order by score desc, image_id, det_id rows between current row and unbounded following) best from run),
support as (select class_id, count(*) n_gt from ground_truth group by 1), area as (select d, u, s, class_id, sum(best) filter (gt_id is not null) area from env group by all),
maps as (select d, u, s, avg(coalesce(area, 0) / n_gt) map_50 from points cross join support left join area using (d, u, s, class_id) group by all),
sums as (select d, u, s, count(gt_id) filter (sure) tp, count(*) filter (sure) n, count(*) filter (not sure and score >= u) maybe from boxes group by all),
rated as (select *, coalesce(tp / nullif(n, 0), 0.0) p, coalesce(tp / (select sum(n_gt) from support), 0.0) r, (n - tp) / (select count(distinct image_id) from detections) fp, coalesce(maybe / nullif(n + maybe, 0), 0.0) un from sums join maps using (d, u, s)),
swept as (select d "decode", u "unknown", s strict, p "precision", r recall, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end f1, map_50, fp fp_per_image, un unknown_rate, 0.6 * (case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end) + 0.4 * map_50 - 0.02 * fp - 0.05 * un score from rated)"""
SWEPT = ("precision", "recall", "f1", "map_50", "fp_per_image", "unknown_rate", "score")
_ROUNDED = '"decode", "unknown", strict, ' + ", ".join(f'round("{c}", 6) "{c}"' for c in SWEPT)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return sel.sweep(view(spark, d, "ground_truth"), view(spark, d, "detections"), view(spark, d, "class_dim"), DECODE, MAYBE, STRICT, cfg=CFG)


@query(f"with {SWEEP} select {_ROUNDED} from swept", "detections", "ground_truth", "class_dim")
def d6_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d).select("decode", "unknown", "strict", *map(R, SWEPT))


@query(f"with {SWEEP} select {_ROUNDED} from swept order by round(score, 9) desc, \"decode\" desc, \"unknown\" desc, abs(strict - 1) limit 1", "detections", "ground_truth", "class_dim")
def t8_best_point(spark: SparkSession, d: str) -> DataFrame:
    return sel.best_point(_sweep(spark, d)).select("decode", "unknown", "strict", *map(R, SWEPT))


@query("select det_id, case when score < 0.2 or score > 0.97 then null else round(0.6 * score + 0.4 * (1 - score) - 0.02 * (det_id % 7) - 0.05 * (det_id % 10) / 10, 6) end point from detections", "detections")
def f21_point_score(spark: SparkSession, d: str) -> DataFrame:
    s, i = F.col("score"), F.col("det_id")
    v = sel.point_score(s, 1 - s, i % 7, (i % 10) / 10, s, 1 - s, min_precision=0.2, min_recall=0.03)
    return view(spark, d, "detections").select("det_id", R(v, "point"))


@query("select event_id, cls, round(score, 6) score, round(x1, 6) x1, round(y2, 6) y2 from (select event_id, case when b >= a and b >= c then case when a = b then 0 else 1 end when a >= c then 0 else 2 end cls, greatest(a, b, c) * obj score, (cx - w / 2 - 8) / 0.5 x1, (cy + h / 2 - 4) / 0.5 y2 from (select event_id, cast(event_id % 11 as double) / 10 a, cast(event_id % 7 as double) / 10 b, cast(event_id % 5 as double) / 10 c, case when event_id % 2 = 0 then cast(event_id % 9 + 1 as double) / 10 else 1.0 end obj, cast(event_id % 600 as double) cx, cast(event_id % 400 as double) cy, 30.0 w, 20.0 h from events)) where score >= 0.3")
def p18_decode_heads(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    num = lambda c: c.cast("double")
    scores = [num(i % 11) / 10, num(i % 7) / 10, num(i % 5) / 10]
    box = [num(i % 600), num(i % 400), F.lit(30.0), F.lit(20.0)]
    head = F.when(i % 2 == 0, F.array(*box, num(i % 9 + 1) / 10, *scores)).otherwise(F.array(*box, *scores))
    rows = table(spark, d, "events").select("event_id", head.alias("head"))
    out = rows.withColumns(checks.decode_head(F.col("head"), 3, F.lit(0.5), F.lit(8.0), F.lit(4.0))).where("score >= 0.3")
    return out.select("event_id", "cls", R("score"), R("x1"), R("y2"))


@query(
    "with f as (select event_id, event_id % 120 side, case when event_id % 4 = 0 then null else cast(event_id % 100 as double) / 100 end det, cast(event_id % 230 as double) blur, cast(event_id % 256 as double) bright, cast(event_id % 50 as double) / 100 ov, cast(event_id % 60 as double) / 100 under from events) "
    "select event_id, case when side <= 0 then 'face_crop_empty' when side < 40 then 'face_too_small' when det < 0.5 then 'low_detection_confidence' when blur < 20 then 'blurry' when bright > 215 or ov > 0.35 then 'overexposed' when bright < 40 or under > 0.5 then 'underexposed' end reason, "
    "round(0.3 * least(1.0, side / 120.0) + 0.3 * least(1.0, blur / 200) + 0.2 * greatest(0.0, 1 - abs(bright - 128) / 128) + 0.2 * coalesce(least(1.0, greatest(0.0, det)), 1.0), 9) quality from f"
)
def p11_crop_quality(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    c = lambda v: v.cast("double")
    side, det, blur, bright, over, under = i % 120, F.when(i % 4 != 0, c(i % 100) / 100), c(i % 230), c(i % 256), c(i % 50) / 100, c(i % 60) / 100
    return table(spark, d, "events").select("event_id", checks.crop_reason(side, det, blur, bright, over, under).alias("reason"), F.round(checks.crop_quality(side, det, blur, bright), 9).alias("quality"))


@query(
    "with c as (select image_id, count(*) filter (where class_id = 'contactor') k, count(*) filter (where class_id = 'overload_relay') o, count(*) filter (where class_id = 'plc') p, count(*) filter (where class_id = 'terminal_block') t, count(*) total, count(*) filter (where det_id % 6 = 0) u from panel_boxes group by 1) "
    "select image_id, concat_ws(',', case when k > 0 and o > 0 and o < k then 'overload_mismatch' end, case when p > 0 then 'controller_without_supply' end, case when total >= 5 then 'no_earth_bar' end, case when t > 0 and total >= 8 then 'no_wire_duct' end, case when u / total >= 0.3 then 'many_unknown' end, case when u > 0 and u / total < 0.3 then 'some_unknown' end) notes from c",
    "detections",
)
def p21_engineering_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "panel_boxes")
    names = ("contactor", "overload_relay", "plc", "terminal_block")
    n = rows.groupBy("image_id").agg(*[F.count_if(F.col("class_id") == c).alias(c) for c in names], F.count("*").alias("total"), F.count_if(F.col("det_id") % 6 == 0).alias("u"))
    return n.select("image_id", F.array_join(checks.engineering_notes({c: F.col(c) for c in names}, F.col("u"), F.col("total")), ",").alias("notes"))


@query(
    "with n as (select a.det_id, any_value(a.class_id) class_id, list(distinct b.class_id) near from detections a join detections b on a.image_id = b.image_id and a.det_id <> b.det_id and abs(a.x1 - b.x1) < 200 group by 1) "
    "select det_id, case class_id when 'contactor' then case when list_contains(near, 'overload_relay') then 'motor_starter' else 'load_switching' end when 'overload_relay' then 'motor_protection' when 'mcb' then case when list_contains(near, 'plc') then 'control_supply_protection' else 'final_circuit_protection' end when 'plc' then 'controller' when 'terminal_block' then 'field_wiring' end purpose from n",
    "detections",
)
def f17_purpose(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "detections").select("image_id", "det_id", "class_id", "x1")
    b = a.select("image_id", F.col("det_id").alias("o"), F.col("class_id").alias("oc"), F.col("x1").alias("ox"))
    near = a.join(b, "image_id").where("det_id <> o and abs(x1 - ox) < 200").groupBy("det_id", "class_id").agg(F.collect_set("oc").alias("near"))
    return near.select("det_id", checks.purpose(F.col("class_id"), F.col("near")).alias("purpose"))


@query("select det_id, round(case when det_id % 3 = 0 then least(0.995, score + (1 - score) / 2) else score end, 6) confidence from detections", "detections")
def f18_corroborated(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").select("det_id", R(checks.corroborated(F.col("score"), F.col("det_id") % 3 == 0), "confidence"))


PALETTE = {"red": (220, 40, 40), "green": (40, 180, 60), "blue": (40, 80, 220), "black": (10, 10, 10), "white": (245, 245, 245)}


@query("with p(k, n, r, g, b) as (values (0, 'red', 220, 40, 40), (1, 'green', 40, 180, 60), (2, 'blue', 40, 80, 220), (3, 'black', 10, 10, 10), (4, 'white', 245, 245, 245)) select event_id, n colour from (select event_id, n, row_number() over (partition by event_id order by power(event_id % 256 - r, 2) + power(event_id * 7 % 256 - g, 2) + power(event_id * 13 % 256 - b, 2), k) q from events cross join p) where q = 1")
def f22_colour(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", checks.nearest_colour(i % 256, i * 7 % 256, i * 13 % 256, PALETTE).alias("colour"))


@query("select a.vec_id, round((corr + 1) / 2, 5) likeness from (select x.vec_id, x.label, list_aggregate(list_transform(x.embedding, lambda v: v::double), 'avg') m, x.embedding from vectors x) a join (select v.vec_id, corr(p, q) corr from (select x.vec_id, unnest(x.embedding)::double p, unnest(y.embedding)::double q from vectors x join vectors y on y.vec_id = x.vec_id + 1) v group by 1) c using (vec_id)", "vectors")
def f23_histogram_likeness(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(checks.correlation(F.col("a"), F.col("b")), 5).alias("likeness"))


@query("select vec_id, sum(case when e[k + 1] > e[k + 2] then power(2, k)::hugeint else 0 end)::bigint h from (select vec_id, embedding e, unnest(range(0, 50)) k from vectors) where (k % 9) < 8 or true group by 1".replace("sum(case when e[k + 1] > e[k + 2] then power(2, k)::hugeint else 0 end)", "sum(case when e[(k // 8) * 9 + k % 8 + 1] > e[(k // 8) * 9 + k % 8 + 2] then power(2, k)::hugeint else 0 end)").replace("range(0, 50)", "range(0, 56)").replace(" where (k % 9) < 8 or true", ""), "vectors")
def f11_gradient_hash(spark: SparkSession, d: str) -> DataFrame:
    grid = F.transform("embedding", lambda x: x.cast("double"))
    return view(spark, d, "vectors").select("vec_id", grid.alias("g")).select("vec_id", checks.grid_hash(F.col("g"), 8, 7).alias("h"))


@query(f"select l.label, a, p, round(case when p > 0 then a / p else 0 end, 6) \"precision\", round(ll, 6) log_loss from (select label, count(*) filter (where label = pred) a, (select count(*) from v v2 where v2.pred = v.label) p, avg(-ln(greatest(1e-15, pr))) ll from v group by label) l".replace("from (select label, count", "from (with v as (select label, vec_id % 10 pred, (vec_id % 97 + 1) / 100.0 pr from vectors) select label, count"), "vectors")
def a45_classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").select("label", (F.col("vec_id") % 10).alias("pred"), ((F.col("vec_id") % 97 + 1) / 100).alias("pr"))
    return rp.classifier_metrics(v).select(F.col("class").alias("label"), F.col("right").alias("a"), F.col("predicted").alias("p"), R("precision"), R("log_loss"))


@query(
    "with v as (select label, vec_id % 12 pred, (vec_id % 97 + 1) / 100.0 pr from vectors), c as (select label c from v union select pred from v), k as (select c, (select count(*) from v where label = c) s, (select count(*) from v where pred = c) q, (select count(*) from v where pred = c and label = c) h from c), "
    "r as (select *, case when q > 0 then h / q else 0.0 end p, case when s > 0 then h / s else 0.0 end r from k) select (select count(*) from v) n, round((select avg((label = pred)::int) from v), 6) accuracy, round(avg(p), 6) \"precision\", round(avg(r), 6) recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 6) f1, round((select avg(-ln(greatest(1e-15, pr))) from v), 6) log_loss from r",
    "vectors",
)
def a45_classifier_totals(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").select("label", (F.col("vec_id") % 12).alias("pred"), ((F.col("vec_id") % 97 + 1) / 100).alias("pr"))
    return rp.classifier_totals(v).select("n", *map(R, ("accuracy", "precision", "recall", "f1", "log_loss")))


@query("select det_id, 'any' class_id, score from detections", "detections")
def p24_class_agnostic(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").select("det_id", F.lit("any").alias("class_id"), "score")


@query("select det_id, verdict in ('accept', 'reject', 'relabel') ok from (select det_id, case det_id % 5 when 0 then 'accept' when 1 then 'reject' when 2 then 'relabel' when 3 then 'maybe' else 'ACCEPT' end verdict from detections)", "detections")
def p25_verdict_domain(spark: SparkSession, d: str) -> DataFrame:
    v = F.element_at(F.array(*map(F.lit, ("accept", "reject", "relabel", "maybe", "ACCEPT"))), (F.col("det_id") % 5 + 1).cast("int"))
    return view(spark, d, "detections").select("det_id", rp.valid_verdict(v).alias("ok"))


@query("select image_id, det_id, class_id, score from (select *, row_number() over (partition by image_id order by score desc, det_id) r from detections) where r <= 5", "detections")
def p17_capped_payload(spark: SparkSession, d: str) -> DataFrame:
    return gate.cap_per_image(view(spark, d, "detections"), 5).where("not over_cap").select("image_id", "det_id", "class_id", "score")


@query("select det_id, case when class_id in ('mcb', 'plc') then case class_id when 'mcb' then 0 else 1 end end new_index from detections where class_id in ('mcb', 'plc')", "detections")
def p19_profile_scope(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("mcb", 0), ("plc", 1)], "class_id string, new_index int")
    return rp.scope(view(spark, d, "detections"), m).select("det_id", "new_index")


@query("select gt_id from ground_truth where image_id in (select image_id from detections where image_id % 3 <> 0)", "ground_truth", "detections")
def j7_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ground_truth").join(view(spark, d, "detections").where("image_id % 3 <> 0"), "image_id", "left_semi").select("gt_id")


@query("select d.image_id, d.det_id, coalesce(v, 'pending') verdict from detections d left join (select det_id, case when det_id % 2 = 0 then 'accept' else 'reject' end v from detections where det_id % 3 = 0) x using (det_id)", "detections")
def j4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "detections").select("image_id", "det_id")
    v = b.where("det_id % 3 = 0").select("det_id", F.when(F.col("det_id") % 2 == 0, "accept").otherwise("reject").alias("v"))
    return b.join(v, "det_id", "left").select("image_id", "det_id", F.coalesce("v", F.lit("pending")).alias("verdict"))


@query("select det_id, coalesce(t, 'ok') status from detections left join (select det_id % 1000 * 3 det_id, max_by(event_type, event_id) t from (select event_id det_id, event_id, event_type from events) group by 1) e using (det_id)", "detections")
def j30_element_status(spark: SparkSession, d: str) -> DataFrame:
    from sightline.operators.compare import element_status

    errors = table(spark, d, "events").select((F.col("event_id") % 1000 * 3).alias("target"), "event_id", F.col("event_type").alias("type"))
    return element_status(view(spark, d, "detections").select("det_id"), errors, "det_id", "event_id").select("det_id", "status")


@query("select doc_id, coalesce(case when doc_id % 4 = 0 then 'ref' || doc_id end, 'computed' || n_chars) spec from documents")
def j33_spec_fallback(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    ref = t.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("ref"), "doc_id").alias("spec"))
    return rp.with_fallback(t, ref, "doc_id", "spec", F.concat(F.lit("computed"), "n_chars")).select("doc_id", "spec")


@query("select image_id, least, row_number() over (order by n_unknown desc, least, image_id) place from (select image_id, min(score) least, count(*) filter (where score < 0.1) n_unknown from detections group by 1) order by 3 limit 50".replace("order by 3 limit 50", "qualify place <= 50"), "detections")
def t5_review_queue(spark: SparkSession, d: str) -> DataFrame:
    return rp.review_queue(view(spark, d, "detections"), 50)


@query("select image_id, class_id, case severity when 'important' then 0 when 'advisory' then 1 else 2 end rank from (select image_id, class_id, case when score >= 0.7 then 'important' when score >= 0.4 then 'advisory' else 'info' end severity from detections)", "detections")
def t6_severity_order(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("score") >= 0.7, "important").when(F.col("score") >= 0.4, "advisory").otherwise("info")
    return view(spark, d, "detections").select("image_id", "class_id", rp.severity_rank(s).alias("rank")).orderBy("rank", "image_id")


@query("select class_id, n from (select class_id, count(*) n from detections group by 1) order by n desc, class_id limit 3", "detections")
def a40_top_objects(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_id").limit(3)


@query("select 'panel' || (image_id % 89) group_key, count(*) n from images group by 1 order by n desc, group_key limit 10", "images")
def t4_largest_groups(spark: SparkSession, d: str) -> DataFrame:
    from sightline.functions.text import group_key

    return view(spark, d, "images").groupBy(group_key(F.col("filename")).alias("group_key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_key").limit(10)


@query("select reason, n, round(mean_iou, 6) mean_iou from (select coalesce(reason, 'accepted') reason, count(*) n, avg(v) mean_iou from (select d.det_id, case when det_id % 4 = 0 then 'grew_too_much' when det_id % 4 = 1 then 'moved_too_far' end reason, d.score v from detections d) group by 1)", "detections")
def a28_refinement_summary(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("det_id") % 4 == 0, "grew_too_much").when(F.col("det_id") % 4 == 1, "moved_too_far")
    return rp.refinement_summary(view(spark, d, "detections").select(r.alias("reason"), F.col("score").alias("iou"))).select("reason", "n", R("mean_iou"))


@query(
    "with r as (select case when det_id % 4 = 0 then 'grew_too_much' when det_id % 4 = 1 then 'moved_too_far' end reason, score v, (x2 - x1) * (y2 - y1) a, (x2 - x1) * (y2 - y1) * (0.8 + det_id % 5 / 10.0) b from detections) "
    "select count(*) boxes, count(*) filter (reason is null) accepted, round(count(*) filter (reason is null) / count(*), 6) accept_rate, round(avg(v) filter (reason is null), 6) mean_iou, count(*) filter (reason is null and b < a) tightened, round(1 - avg(b / a) filter (reason is null and b < a), 6) mean_area_reduction from r",
    "detections",
)
def a28_refinement_totals(spark: SparkSession, d: str) -> DataFrame:
    i, area = F.col("det_id"), g.area(g.box())
    r = F.when(i % 4 == 0, "grew_too_much").when(i % 4 == 1, "moved_too_far")
    rows = view(spark, d, "detections").select(r.alias("reason"), F.col("score").alias("iou"), area.alias("area"), (area * (0.8 + i % 5 / 10.0)).alias("new_area"))
    return rp.refinement_totals(rows).select("boxes", "accepted", R("accept_rate"), R("mean_iou"), "tightened", R("mean_area_reduction"))


@query(f"with o as (select a.image_id, count(*) n from detections a join detections b on a.image_id = b.image_id and a.det_id < b.det_id and {iou_sql('a', 'b')} > 0.5 group by 1) select image_id, n from o", "detections")
def u6_overlap_edges(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "detections")
    b = a.select("image_id", F.col("det_id").alias("o"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, "image_id").where((F.col("det_id") < F.col("o")) & (g.iou(g.box(), g.box("o")) > 0.5)).groupBy("image_id").agg(F.count("*").alias("n"))


@query("select class_id from detections union select class_id from class_dim", "detections", "class_dim")
def u7_class_union(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").select("class_id").union(view(spark, d, "class_dim").select("class_id")).distinct()


@query("select det_id, x2 - x1 w, y2 - y1 h, (x2 - x1) * (y2 - y1) area, (x1 + x2) / 2 cx from detections", "detections")
def f3_box_measures(spark: SparkSession, d: str) -> DataFrame:
    b = g.box()
    return view(spark, d, "detections").select("det_id", g.width(b).alias("w"), g.height(b).alias("h"), g.area(b).alias("area"), g.centre(b)[0].alias("cx"))


SIDES = {"cx": "(x1 + x2) / 2048", "cy": "(y1 + y2) / 1536", "w": "(x2 - x1) / 1024", "h": "(y2 - y1) / 768"}


@query(f"select image_id, string_agg(sig, ',' order by sig) signature from (select image_id, concat_ws(':', class_id, {', '.join(f'floor({x} * 100 + 0.5)::bigint' for x in SIDES.values())}) sig from ground_truth) group by 1", "ground_truth")
def f26_label_signature(spark: SparkSession, d: str) -> DataFrame:
    return rp.label_signature(view(spark, d, "ground_truth").select("image_id", F.col("class_id").alias("cls"), *(F.expr(x).alias(n) for n, x in SIDES.items())))


@query("select event_id, try_cast(case when event_id % 3 = 0 then value::varchar when event_id % 3 = 1 then 'x' else null end as double) v from events")
def f29_safe_coercion(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "x")
    return table(spark, d, "events").select("event_id", rp.number(t).alias("v"))


@query("select image_id, 'inventory' section, class_id \"key\", count(*)::varchar \"value\" from detections group by 1, 3 union all select image_id, 'confidence', 'n', count(*)::varchar from detections group by 1", "detections")
def s18_report_sections(spark: SparkSession, d: str) -> DataFrame:
    dets = view(spark, d, "detections")
    a = inv.counts(dets).select("image_id", F.lit("inventory").alias("section"), F.col("class_id").alias("key"), F.col("n").cast("string").alias("value"))
    return a.unionByName(inv.confidence_stats(dets).select("image_id", F.lit("confidence").alias("section"), F.lit("n").alias("key"), F.col("n").cast("string").alias("value")))
