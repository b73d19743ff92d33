"""Chained jobs, dimension summaries and small rankings."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import panel_rules as rules
from sightline.functions import text as tx
from sightline.operators import compare as cp
from sightline.operators import datasets as ds
from sightline.operators import evaluation as ev
from sightline.operators import gate
from sightline.operators import identity as idn
from sightline.operators import inventory as inv
from sightline.operators import jobs
from sightline.operators import reports as rp
from sightline.operators import selection as sel
from sightline.queries import compare as qc
from sightline.queries import datasets as qd
from sightline.queries.evaluation import COUNTS, F1, match_sql
from sightline.queries.gate import CFG, GATED, contain_sql, greedy_sql, iou_sql
from sightline.queries.identity import CENT, UNITS
from sightline.queries.inventory import INV, MISSING, RULES, SCORES, TYPES, _dets
from sightline.registry import query
from sightline.sources import files
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
NOTES = "nt as (select image_id, count(*) filter (where class_id = 'contactor') k, count(*) filter (where class_id = 'overload_relay') o, count(*) filter (where class_id = 'plc') p, count(*) filter (where class_id = 'terminal_block') t, count(*) total, avg(score) mean from panel_boxes group by 1)"


@query(f"with {RULES}, {INV}, {SCORES}, {TYPES}, {MISSING}, {NOTES} select image_id, total n, round(mean, 6) mean, panel_type, round(confidence, 6) confidence, reason, concat_ws(',', case when k > 0 and o > 0 and o < k then 'overload_mismatch' end, case when p > 0 then 'controller_without_supply' end, case when total >= 5 then 'no_earth_bar' end, case when t > 0 and total >= 8 then 'no_wire_duct' end) notes, coalesce((select string_agg(class_id, ',' order by class_id) from gone g where g.image_id = nt.image_id), '') missing from nt join types using (image_id)", "detections")
def d3_inspection(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.inspect(_dets(spark, d))
    return out.select("image_id", "n", R("mean"), "panel_type", R("confidence"), "reason", F.array_join("notes", ",").alias("notes"), F.array_join(F.transform("missing", lambda m: m["class_id"]), ",").alias("missing"))


@query(
    f"with {RULES}, {INV}, {SCORES}, {TYPES}, {MISSING}, {NOTES}, wm as (select image_id, count(*) n_missing, sum(case severity when 'important' then 3.0 else 1.0 end + case when class_id in ({', '.join(map(repr, rules.SAFETY_CRITICAL))}) then 1.5 else 0 end) w from gone group by 1), "
    "wn as (select image_id, (case when k > 0 and o > 0 and o < k then 1 else 0 end + case when p > 0 then 1 else 0 end + case when total >= 5 then 1 else 0 end + case when t > 0 and total >= 8 then 1 else 0 end) n_notes, (case when k > 0 and o > 0 and o < k then 2.5 else 0 end + case when p > 0 then 1.0 else 0 end + case when total >= 5 then 2.5 else 0 end + case when t > 0 and total >= 8 then 0.25 else 0 end) w from nt), "
    "s as (select nt.image_id, total n, panel_type, coalesce(n_missing, 0) n_missing, n_notes, case when mean < 0.55 then 1 else 0 end + case when total >= 4 then coalesce(wm.w, 0) else 0 end + wn.w score from nt join types using (image_id) join wn using (image_id) left join wm using (image_id)) "
    "select image_id, n, panel_type, n_missing, n_notes, round(score, 6)::double score, case when score >= 9 then 'high' when score >= 5 then 'elevated' when score >= 2 then 'moderate' else 'low' end \"level\" from s",
    "detections",
)
def d4_report(spark: SparkSession, d: str) -> DataFrame:
    return jobs.report(jobs.inspect(_dets(spark, d))).select("image_id", "n", "panel_type", F.col("n_missing").cast("long").alias("n_missing"), F.col("n_notes").cast("long").alias("n_notes"), R("score"), "level")


KEPT = f"kd as (select d.* from detections d join class_dim using (class_id) where score >= min_conf), {match_sql(0.5, True, 'kept').replace('detections', 'kd')}"
BEST = f"""{match_sql(0.5)}, grid as (select round(0.05 * k, 2)::double t from range(1, 20) r(k)), ng as (select class_id, count(*) n_gt from ground_truth group by 1),
pts as (select c.class_id, t, count(m.gt_id) tp, count(m.det_id) n, any_value(c.n_gt) n_gt from (select distinct d.class_id, coalesce(n_gt, 0) n_gt from detections d left join ng using (class_id)) c cross join grid left join matched m on m.class_id = c.class_id and m.score >= t group by 1, 2),
rt as (select *, case when n > 0 then tp / n else 0.0 end p, case when n_gt > 0 then tp / n_gt else 0.0 end r from pts), best as (select class_id, t, {F1} f from rt qualify row_number() over (partition by class_id order by {F1} desc, t) = 1)"""


@query(
    f"with {KEPT}, {BEST}, {COUNTS.format(m='kept')}, old as (select class_id, {F1} f from rated) select c.class_id, case when coalesce(b.f > coalesce(old.f, 0), false) then t else min_conf end min_conf, coalesce(b.f > coalesce(old.f, 0), false) adopted from class_dim c left join best b using (class_id) left join old using (class_id)",
    "detections",
    "ground_truth",
    "class_dim",
)
def d7_refine_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t, p, c = view(spark, d, "ground_truth"), view(spark, d, "detections"), view(spark, d, "class_dim")
    kept = p.join(F.broadcast(c.select("class_id", "min_conf")), "class_id").where("score >= min_conf").drop("min_conf")
    return sel.refine_thresholds(ev.class_counts(ev.match(t, kept), t), t, p, c)


OLD_GATE = greedy_sql("loose", "image_id", "score desc, det_id", iou_sql("k", "o") + " > 0.45", "oldp")
NEW_GATE = "newp as (select * from placed where class_id <> 'unknown_industrial_component')"


def _outcome(gate: str) -> str:
    counts = COUNTS.format(m=f"m{gate}").replace("counts as", f"c{gate} as").replace("from counts", f"from c{gate}").replace("rated as", f"r{gate} as")
    return f"{match_sql(0.5, True, f'm{gate}').replace('detections', f'{gate}p')}, {counts}, t{gate} as (select '{gate}' gate, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from c{gate})"


@query(
    f"with {GATED}, loose as (select * from good where score >= 0.25), {OLD_GATE}, {NEW_GATE}, {_outcome('old')}, {_outcome('new')}, o as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end r from (select * from told union all select * from tnew)) "
    f"select gate, tp, fp, fn, round(p, 6) \"precision\", round(r, 6) recall, round({F1}, 6) f1 from o",
    "candidates",
    "class_dim",
    "ground_truth",
)
def d25_gate_experiment(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.gate_experiment(view(spark, d, "ground_truth"), view(spark, d, "candidates"), view(spark, d, "class_dim"), CFG)
    return out.select("gate", "tp", "fp", "fn", R("precision"), R("recall"), R("f1"))


WIRE_ROWS = "refs as (select image_id panel_id, gt_id ref_id, x1 sx, y1 sy, x2 ex, y2 ey, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) length from ground_truth), obs as (select image_id panel_id, det_id obs_id, x1 sx, y1 sy, x2 ex, y2 ey, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) length from detections)"
WIRE_PAIRS = qc.assign_sql(f"select * from (select r.panel_id, r.ref_id, o.obs_id, round({qc.COST}, 9) c from refs r join obs o using (panel_id)) where c < 90")


@query(
    f"with c as (with recursive {qc.COMPONENTS} select panel_id, severity from err), w as (with recursive {WIRE_ROWS}, {WIRE_PAIRS}, j as (select m.*, r.length l, o.length ol from m join refs r using (panel_id, ref_id) left join obs o on o.panel_id = m.panel_id and o.obs_id = m.obs_id) "
    "select panel_id, 'error' severity from j where obs_id is null or ol / l < 0.6 union all select panel_id, 'warning' from obs where (panel_id, obs_id) not in (select (panel_id, obs_id) from m where obs_id is not null)), "
    "e as (select * from c union all select * from w), n as (select image_id panel_id, 2 * count(*) n from ground_truth group by 1), k as (select panel_id, n, count(*) filter (where severity = 'error') n_err, count(*) filter (where severity = 'warning') n_warn from n left join e using (panel_id) group by 1, 2) "
    "select panel_id, n_err, n_warn, round(greatest(0.0, 1 - (n_err + 0.4 * n_warn) / n), 6)::double score, case when n_err > 0 then 'fail' when n_warn > 0 then 'warning' else 'pass' end status from k",
    "detections",
    "ground_truth",
)
def d20_compare_panels(spark: SparkSession, d: str) -> DataFrame:
    wire = lambda df, i: df.select(F.col("image_id").alias("panel_id"), F.col(i).alias("ref_id" if i == "gt_id" else "obs_id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"), g.distance(*g.box()).alias("length"), F.lit("red").alias("color"))
    wires = wire(view(spark, d, "detections"), "det_id")
    # two of three panels are seen at twice the size and elsewhere, and registered again
    p, seen = F.col("panel_id"), F.col("panel_id") % 3 != 0
    far = lambda df, xs, ys: df.withColumns({c: F.when(seen, 2 * F.col(c) + 16 * (p % 5)).otherwise(F.col(c)) for c in xs} | {c: F.when(seen, 2 * F.col(c) - 8 * (p % 4)).otherwise(F.col(c)) for c in ys})
    h = F.array(*(x.cast("double") for x in (F.lit(0.5), F.lit(0), -8 * (p % 5), F.lit(0), F.lit(0.5), 4 * (p % 4), F.lit(0), F.lit(0), F.lit(1))))
    transforms = wires.select("panel_id").distinct().where(seen).select("panel_id", h.alias("h"))
    out = jobs.compare_panels(qc._refs(spark, d), far(qc._obs(spark, d), ["cx"], ["cy"]), wire(view(spark, d, "ground_truth"), "gt_id"), far(wires, ["sx", "ex"], ["sy", "ey"]), transforms=transforms)
    return out.select("panel_id", "n_err", "n_warn", R("score"), "status")


@query("with n as (select image_id, class_id comp_type, count(*) n from detections group by 1, 2) select comp_type, max(n) expected, count(*) seen_in from n group by 1", "detections")
def d19_template(spark: SparkSession, d: str) -> DataFrame:
    return jobs.learn_template(view(spark, d, "detections").withColumnRenamed("class_id", "comp_type"))


FACES = f"""fd as (select d.* from detections d join vectors v on v.vec_id = d.det_id % (select count(*) from vectors)), {greedy_sql('fd', 'image_id', '(x2 - x1) * (y2 - y1) desc, det_id', iou_sql('k', 'o') + ' >= 0.4', 'big')}, {UNITS}, {CENT},
fa as (select *, least(x2 - x1, y2 - y1) side, det_id % 90 blur, det_id % 256 bright, det_id % 50 ov, det_id % 60 un from big where least(x2 - x1, y2 - y1) >= 20),
q as (select *, case when side < 40 then 'small' when score < 0.5 then 'unsure' when blur < 20 then 'blurry' when bright > 215 or ov > 35 then 'over' when bright < 40 or un > 50 then 'under' end reason from fa),
rk as (select q.det_id, cn.label, list_dot_product(u.v, cn.v) s, row_number() over (partition by q.det_id order by list_dot_product(u.v, cn.v) desc, cn.label) k from q join u on u.vec_id = q.det_id % (select count(*) from vectors) cross join cn where reason is null),
de as (select a.det_id, a.label, a.s, a.s >= 0.15 and a.s - coalesce(b.s, -1) >= 0.02 ok from rk a left join rk b on b.det_id = a.det_id and b.k = 2 where a.k = 1),
rec as (select image_id, q.det_id, case when reason is not null then 'low_quality' when ok then 'known' else 'unknown' end status, case when ok then label end \"identity\", case when ok then round(greatest(0.0, least(1.0, (s - 0.15) / 0.85)), 6) end confidence from q left join de using (det_id))"""


@query(f"with {FACES} select * from rec", "detections", "vectors")
def d27_recognise(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    gallery = idn.centroids(v.where("vec_id % 5 <> 0 and label < 8"), "label", "embedding").select(F.col("label").alias("identity"), F.col("embedding").alias("vec"))
    n = v.count()
    faces = view(spark, d, "detections").withColumn("vec_id", F.col("det_id") % n).join(v.select("vec_id", F.col("embedding").alias("vec")), "vec_id").drop("vec_id")
    i = F.col("det_id")
    faces = faces.withColumns({"blur": (i % 90).cast("double"), "brightness": (i % 256).cast("double"), "over": (i % 50) / 100, "under": (i % 60) / 100})
    return jobs.recognise(faces, gallery, 0.15, 0.02).withColumn("confidence", F.round("confidence", 6))


@query("select vec_id, label from vectors where label % 4 <> 1 union all select vec_id + 100000, label from vectors where label % 4 = 1 and vec_id % 2 = 0", "vectors")
def d28_reembed(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").select("vec_id", "label")
    return jobs.reembed(v, v.where("label % 4 = 1 and vec_id % 2 = 0").withColumn("vec_id", F.col("vec_id") + 100_000), "label")


@query("with n as (select class_id, count(*) n from (select case when det_id % 3 = 0 or class_id = 'plc' then class_id else 'mcb' end class_id from detections) group by 1), k as (select class_id, n, ordinal from n join class_dim using (class_id) where n > (select avg(n) from n)) select row_number() over (order by ordinal) - 1 ordinal, class_id, n from k", "detections", "class_dim")
def d15_derive_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").withColumn("class_id", F.when((F.col("det_id") % 3 == 0) | (F.col("class_id") == "plc"), F.col("class_id")).otherwise("mcb"))
    mean = rows.groupBy("class_id").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0]
    out = jobs.derive_profile(rows, view(spark, d, "class_dim").select("ordinal", "class_id"), int(mean) + 1)
    return out.select(F.col("ordinal").cast("long").alias("ordinal"), "class_id", "n")


@query(f"with {qd.GOOD}, m as (select gt_id, {qd.CASE} class_id, image_id from good where cls < 4) select class_id, count(*) instances, count(distinct image_id) images, case when count(*) < 50 then 'untrainable' when count(*) < 300 then 'weak' else 'reliable' end status from m group by 1", "label_lines")
def d11_remap_to_coverage(spark: SparkSession, d: str) -> DataFrame:
    kept = ds.remap(qd._labels(spark, d).drop("class_id"), qd._map(spark, 4))[0]
    per = ds.analyse(kept)
    return ds.coverage(qd._map(spark, 4), per).join(per.select("class_id", "images"), "class_id").select("class_id", "instances", "images", "status")


@query("select verdict, count(*) n from (select case when n = 0 then 'empty' when r > 0 then 'review' else 'auto' end verdict from (select image_id, count(*) filter (where score >= 0.15) n, count(*) filter (where score >= 0.15 and score < 0.35) r from detections group by 1)) group by 1", "detections")
def d17_auto_label(spark: SparkSession, d: str) -> DataFrame:
    return ds.triage(view(spark, d, "detections"))[1].groupBy("verdict").agg(F.count("*").alias("n"))


@query("with n as (select count(*) filter (where split = 'train') n, count(*) filter (where split = 'train' and image_id % 2 = 0) m from images), f(share) as (values (0.1), (0.3), (0.5)) select split, false synthetic, count(*) n, share::double share from images, f group by 1, 4 union all select 'train', true, least(m, round_even(share / (1 - share) * n, 0))::bigint, share::double from n, f", "images")
def d16_strategy_mix(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "images").select("image_id", "filename", "split")
    out = None
    for share in (0.1, 0.3, 0.5):
        n = ds.mix_synthetic(i, i.where("image_id % 2 = 0"), share).groupBy("split", "synthetic").agg(F.count("*").alias("n")).withColumn("share", F.lit(share))
        out = n if out is None else out.unionByName(n)
    return out


CASES = (("p1", "contactor", 4), ("p1", "overload_relay", 4), ("p1", "mcb", 2), ("p2", "vfd", 2), ("p2", "line_reactor", 1), ("p2", "cooling_fan", 2), ("p3", "plc", 1), ("p3", "io_module", 4), ("p3", "power_supply", 1), ("p4", "mcb", 18), ("p4", "rccb", 2), ("p4", "busbar", 1), ("p5", "capacitor", 6), ("p5", "pf_controller", 1), ("p6", "terminal_block", 1))


@query(
    f"with {RULES}, {INV}, cases(image_id, class_id, n) as (values {', '.join(f'({p!r}, {c!r}, {n})' for p, c, n in CASES)}), bx as (select image_id::varchar image_id, class_id, n from inv union all select * from cases), {SCORES}, {TYPES} select panel_type, reason, count(*) n from types group by 1, 2".replace("inv i", "bx i").replace("from inv)", "from bx)").replace("from inv group by 1)", "from bx group by 1)"),
    "detections",
)
def d26_panel_types(spark: SparkSession, d: str) -> DataFrame:
    """Share of each panel type over all frames, with labelled inventories beside them."""
    fixed = spark.createDataFrame(list(CASES), "image_id string, class_id string, n int").withColumn("n", F.col("n").cast("long"))
    own = inv.counts(_dets(spark, d)).select(F.col("image_id").cast("string").alias("image_id"), "class_id", "n")
    n = own.unionByName(fixed)
    scores = inv.rule_scores(n, rules.rule_weights(spark), rules.rule_classes(spark, rules.KEYSTONES)).withColumn("score", F.round("score", 9))
    types = inv.classify(scores, n.groupBy("image_id").agg(F.sum("n").alias("n")))
    return types.groupBy("panel_type", "reason").agg(F.count("*").alias("n"))


@query(
    "select det_id, concat_ws(',', case when a <> c and d is distinct from a then 'wrong_source' end, case when b <> d and c is distinct from b then 'wrong_destination' end, "
    "case when a is null and c is null and not ((p = r and q = s) or (p = s and q = r)) then 'wrong_terminal' end) issues "
    "from (select det_id, case when det_id % 2 = 0 then det_id % 3 end a, det_id % 5 b, case when det_id % 2 = 0 then det_id % 4 end c, det_id % 7 d, det_id % 3 p, det_id % 5 q, det_id % 4 r, det_id % 7 s from detections)",
    "detections",
)
def g6_endpoint_issues(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("det_id")
    known = lambda c: F.when(i % 2 == 0, c)
    rows = view(spark, d, "detections").select("det_id", known(i % 3).alias("rs"), (i % 5).alias("re"), known(i % 4).alias("os"), (i % 7).alias("oe"), (i % 3).alias("rsc"), (i % 5).alias("rec"), (i % 4).alias("osc"), (i % 7).alias("oec"))
    return cp.endpoint_issues(rows).select("det_id", F.array_join("issues", ",").alias("issues"))


_D = "sqrt(power({a}x - {b}x, 2) + power({a}y - {b}y, 2))"


@query(
    "with w as (select g.image_id panel_id, gt_id ref_id, g.x1 sx, g.y1 sy, g.x2 ex, g.y2 ey, case when det_id % 3 = 0 then d.x2 else d.x1 end osx, case when det_id % 3 = 0 then d.y2 else d.y1 end osy, case when det_id % 3 = 0 then d.x1 else d.x2 end oex, case when det_id % 3 = 0 then d.y1 else d.y2 end oey from ground_truth g join detections d on d.det_id = g.gt_id), "
    "rt as (select image_id panel_id, x1 x, y1 y from ground_truth union all select image_id, x2, y2 from ground_truth), ot as (select image_id panel_id, x1 x, y1 y from detections where det_id % 4 <> 1 and (image_id % 5 > 0 or det_id % 20 = 0) union all select image_id, x2 + case when det_id % 4 = 1 then 60 else 0 end, y2 from detections where det_id % 8 <> 1 and image_id % 5 > 0), "
    "ends as (select *, 'source' side, sx x, sy y from w where ref_id % 5 <> 0 union all select *, 'destination', ex, ey from w where ref_id % 7 <> 0), "
    "seen as (select panel_id, ref_id, side, x, y, case when sqrt(power(x - osx, 2) + power(y - osy, 2)) <= sqrt(power(x - oex, 2) + power(y - oey, 2)) then osx else oex end px, case when sqrt(power(x - osx, 2) + power(y - osy, 2)) <= sqrt(power(x - oex, 2) + power(y - oey, 2)) then osy else oey end py from ends), "
    f"r as (select *, (select min({_D.format(a='s.p', b='t.')}) from ot t where t.panel_id = s.panel_id) - (select min({_D.format(a='s.', b='t.')}) from rt t where t.panel_id = s.panel_id) reg from seen s) "
    "select panel_id, ref_id, side, case when reg > 80 then 'disconnected_wire' else 'loose_wire' end \"type\", case when reg > 80 then 'error' else 'warning' end severity, round(reg, 6) regression, round(least(1.0, reg / 120), 3) confidence from r where reg > 40",
    "detections",
    "ground_truth",
)
def g6_connections(spark: SparkSession, d: str) -> DataFrame:
    gt, dets = view(spark, d, "ground_truth"), view(spark, d, "detections")
    i, turned = F.col("det_id"), F.col("det_id") % 3 == 0
    o = dets.select(i.alias("obs_id"), *(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("osx", "x1", "x2"), ("osy", "y1", "y2"), ("oex", "x2", "x1"), ("oey", "y2", "y1"))))
    wires = gt.select(F.col("image_id").alias("panel_id"), F.col("gt_id").alias("ref_id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"), F.when(F.col("gt_id") % 5 != 0, "a").alias("rs"), F.when(F.col("gt_id") % 7 != 0, "b").alias("re"))
    corner = lambda df, x, y: df.select(F.col("image_id").alias("panel_id"), x.alias("x"), F.col(y).alias("y"))
    ref = corner(gt, F.col("x1"), "y1").union(corner(gt, F.col("x2"), "y2"))
    bare = F.col("image_id") % 5 == 0  # frames with one terminal
    obs = corner(dets.where((i % 4 != 1) & (~bare | (i % 20 == 0))), F.col("x1"), "y1").union(corner(dets.where((i % 8 != 1) & ~bare), F.col("x2") + F.when(i % 4 == 1, 60).otherwise(0), "y2"))
    return cp.connection_issues(wires.join(o, F.col("ref_id") == F.col("obs_id")), ref, obs).withColumn("regression", R("regression"))


def _off(p: str, q: str) -> str:
    """Distance of a point from the wire k."""
    t = f"greatest(0.0, least(1.0, coalesce((({p} - k.x1) * (k.x2 - k.x1) + ({q} - k.y1) * (k.y2 - k.y1)) / nullif(power(k.x2 - k.x1, 2) + power(k.y2 - k.y1, 2), 0), 0.0)))"
    return f"sqrt(power({p} - k.x1 - {t} * (k.x2 - k.x1), 2) + power({q} - k.y1 - {t} * (k.y2 - k.y1), 2)) < case when k.class_id = o.class_id then 30 else 15 end"


COVERED = greedy_sql("ws", "image_id", "sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) desc, det_id", f"{_off('o.x1', 'o.y1')} and {_off('o.x2', 'o.y2')} and {_off('(o.x1 + o.x2) / 2', '(o.y1 + o.y2) / 2')}", "kw")


@query(f"with ws as (select image_id, det_id, case when det_id % 2 = 0 then 'red' else 'blue' end class_id, x1, y1, x2, y2 from detections), {COVERED} select image_id panel_id, det_id wire_id from kw", "detections")
def g8_drop_covered(spark: SparkSession, d: str) -> DataFrame:
    w = view(spark, d, "detections").select(F.col("image_id").alias("panel_id"), F.col("det_id").alias("wire_id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"), g.distance(*g.box()).alias("length"), F.when(F.col("det_id") % 2 == 0, "red").otherwise("blue").alias("color"))
    return cp.drop_covered(w, 30.0).select("panel_id", "wire_id")


@query("select image_id, det_id, row_number() over (partition by image_id order by (x2 - x1) desc, det_id) new_id from detections", "detections")
def w11_renumber(spark: SparkSession, d: str) -> DataFrame:
    return rp.renumber(view(spark, d, "detections"), F.desc(F.col("x2") - F.col("x1")), F.col("det_id")).select("image_id", "det_id", "new_id")


@query("select class_id, row_number() over (order by countable desc, n desc, class_id) place from (select class_id, any_value(countable) countable, count(*) n from detections join class_dim using (class_id) group by 1)", "detections", "class_dim")
def t13_bill_order(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n")).join(view(spark, d, "class_dim").select("class_id", "countable"), "class_id")
    return n.select("class_id", F.row_number().over(Window.orderBy(F.desc("countable"), F.desc("n"), "class_id")).cast("long").alias("place"))


@query(f"with {RULES}, {INV}, {SCORES}, {TYPES}, {MISSING} select image_id, class_id, row_number() over (partition by image_id order by case severity when 'important' then 3 else 1 end desc, class_id) place from gone", "detections")
def t14_drivers(spark: SparkSession, d: str) -> DataFrame:
    from sightline.queries.inventory import _missing

    w = Window.partitionBy("image_id").orderBy(F.when(F.col("severity") == "important", 0).otherwise(1), "class_id")
    return _missing(spark, d).select("image_id", "class_id", F.row_number().over(w).cast("long").alias("place"))


@query("select event_id, value from events where event_type = 'purchase' order by value desc, event_id limit 10")
def t15_best_trials(spark: SparkSession, d: str) -> DataFrame:
    return rp.best_trials(table(spark, d, "events").where("event_type = 'purchase'"), "value", "event_id", 10).select("event_id", "value")


@query("select event_id, s from (select event_id, case when event_id % 3 = 0 then null else value end s from events) order by s is null, s desc, event_id limit 20")
def t16_sweep_table(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return rp.best_trials(table(spark, d, "events").select("event_id", s.alias("s")), "s", "event_id", 20)


@query("select event_type, event_id best from (select *, row_number() over (partition by event_type order by value desc, event_id) r from events) where r = 1")
def t17_best_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query(f"select a.det_id, round({contain_sql('b', 'a')}, 6) inside from detections a join detections b on a.image_id = b.image_id and b.det_id = a.det_id + 10", "detections")
def f2_containment(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "detections")
    b = a.select("image_id", (F.col("det_id") - 10).alias("det_id"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, ["image_id", "det_id"]).select("det_id", R(g.containment(g.box(), g.box("o")), "inside"))


@query("select det_id, round(least(abs(x1 - y1) % 180, 180 - abs(x1 - y1) % 180), 6) turn from detections", "detections")
def f7_axis_difference(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").select("det_id", R(g.axis_difference(F.col("x1"), F.col("y1")), "turn"))


@query("select class_id, split_part(class_id, '_', 1) short, n from (select class_id, count(*) n from detections group by 1)", "detections")
def f14_short_name(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n")).select("class_id", rp.short_name(F.col("class_id")).alias("short"), "n")


@query("select image_id, 'Panel ' || image_id || ': ' || n || ' devices, ' || k || ' classes' line from (select image_id, count(*) n, count(distinct class_id) k from detections group by 1)", "detections")
def f25_sentences(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "detections").groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("k"))
    return n.select("image_id", rp.panel_sentence("image_id", "n", "k").alias("line"))


@query("with b(target, per_class) as (values (0.3, 50), (0.5, 150), (0.7, 300), (0.85, 800)) select p_brand, per_class from (select p_brand, per_class, row_number() over (partition by p_brand order by abs(target - s), target) r from (select p_brand, avg(p_size) / 50 s from part group by 1) cross join b) where r = 1")
def f27_requirement_band(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 50).alias("s"))
    return s.select("p_brand", rp.requirement_band(F.col("s")).alias("per_class"))


@query(
    "with b(target, lo, hi) as (values (0.5, 150, 300), (0.7, 300, 600), (0.85, 700, 1200), (0.92, 1500, 2500)), p as (select p_brand, avg(p_size) / 50 s, count(distinct p_type) n from part group by 1), "
    "c as (select * from (select *, row_number() over (partition by p_brand order by round(abs(target - s), 9), target) r from p cross join b) where r = 1) "
    "select p_brand, lo class_low, hi class_high, lo * n instances_low, hi * n instances_high, round(lo * n / (48.0 / n))::bigint images_low, round(hi * n / (48.0 / n))::bigint images_high from c"
)
def f27_requirement_estimate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 50).alias("s"), F.count_distinct("p_type").alias("n"))
    return p.select("p_brand", rp.requirement_estimate(F.col("n"), F.col("s")).alias("e")).select("p_brand", "e.*")


@query("select det_id, case when gap <= 0.05 then 'small' when gap >= 0.5 then 'meaningless' else 'substantial' end verdict from (select det_id, score - 0.3 gap from detections)", "detections")
def f28_gap_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").select(F.col("det_id").alias("label"), F.col("score").alias("map_50"))
    return sel.domain_gap(rows, rows.withColumn("map_50", F.lit(0.3))).select(F.col("label").alias("det_id"), "verdict")


@query(f"with {FACES} select status, count(*) n from rec group by 1", "detections", "vectors")
def r12_recognition(spark: SparkSession, d: str) -> DataFrame:
    return d27_recognise(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("select image_id, '[' || string_agg('{\"det_id\":' || det_id || ',\"class_id\":\"' || class_id || '\"}', ',' order by det_id) || ']' manifest from detections group by 1", "detections")
def s21_manifest(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest(view(spark, d, "detections").select("image_id", "det_id", "class_id"))


@query("select d.image_id, (n + row_number() over (partition by d.image_id order by det_id) - 1)::int box_index, det_id box from detections d join (select image_id, count(*) n from ground_truth group by 1) g using (image_id) where det_id % 4 = 0", "detections", "ground_truth")
def s22_sidecar(spark: SparkSession, d: str) -> DataFrame:
    side = view(spark, d, "detections").where("det_id % 4 = 0").groupBy("image_id").agg(F.array_sort(F.collect_list("det_id")).alias("boxes"))
    return files.sidecar_boxes(view(spark, d, "ground_truth"), side)


@query("select page_id, case page_id % 4 when 0 then 'train' when 1 then 'val' when 2 then 'test' end split from pages")
def s23_split_of_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    p = F.when(k == 0, "/d/images/train/a.jpg").when(k == 1, "/d/valid/images/a.jpg").when(k == 2, "/d/Test/a.jpg").otherwise("/d/other/a.jpg")
    return table(spark, d, "pages").select("page_id", files.split_of(p).alias("split"))


@query(None)
def g7_merge_segments(spark: SparkSession, d: str) -> DataFrame:
    from sightline.operators.wires import merge_segments

    w = view(spark, d, "ground_truth").select(F.col("image_id").alias("panel_id"), F.col("gt_id").alias("wire_id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), (F.col("x1") + 165).alias("ex"), F.col("y1").alias("ey"), F.lit(165.0).alias("length"), F.when(F.col("gt_id") % 2 == 0, "red").otherwise("blue").alias("color"))
    return merge_segments(w, 20.0).select("panel_id", "wire_id", "length", "parts")
