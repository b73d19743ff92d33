"""Comparisons, graphs, text and model selection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import text as tx
from sightline.operators import compare as cp
from sightline.queries.gate import contain_sql, iou_sql
from sightline.registry import query
from sightline.views import table, view

R = lambda c, n=None: F.round(c, 6).alias(n or c)
REFS = "refs as (select image_id panel_id, gt_id ref_id, class_id comp_type, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy, cast(gt_id % 180 as double) rotation from ground_truth)"
OBS = "obs as (select image_id panel_id, det_id obs_id, class_id comp_type, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy, cast((det_id * 7) % 180 as double) rotation from detections where det_id % 7 <> 3)"


def assign_sql(pairs: str, refs: str = "refs", panel: str = "panel_id") -> str:
    """Recursive CTEs: references in order take the cheapest free partner."""
    return f"""op as (select {panel}, ref_id, list({{'o': obs_id, 'c': c}} order by c, obs_id) opts from ({pairs}) group by 1, 2),
rk as (select r.{panel}, r.ref_id, coalesce(opts, []) opts, row_number() over (partition by r.{panel} order by r.ref_id) n from {refs} r left join op using ({panel}, ref_id)),
walk as (
  select distinct {panel}, 0::bigint n, []::bigint[] used, null::bigint ref_id, null::bigint obs_id, null::double c from rk
  union all
  select w.{panel}, r.n, case when len(list_filter(r.opts, lambda x: not list_contains(w.used, x.o))) > 0 then list_append(w.used, list_filter(r.opts, lambda x: not list_contains(w.used, x.o))[1].o) else w.used end, r.ref_id,
    list_filter(r.opts, lambda x: not list_contains(w.used, x.o))[1].o, list_filter(r.opts, lambda x: not list_contains(w.used, x.o))[1].c
  from walk w join rk r on r.{panel} = w.{panel} and r.n = w.n + 1),
m as (select {panel}, ref_id, obs_id, c from walk where n > 0)"""


NEAR = "select r.panel_id, r.ref_id, o.obs_id, sqrt(power(r.cx - o.cx, 2) + power(r.cy - o.cy, 2)) c from refs r join obs o using (panel_id) where sqrt(power(r.cx - o.cx, 2) + power(r.cy - o.cy, 2)) < 60"
TURN = "least(abs(r.rotation - o.rotation) % 180, 180 - abs(r.rotation - o.rotation) % 180)"
COMPONENTS = f"""{REFS}, {OBS}, {assign_sql(NEAR)}, j as (select m.*, r.comp_type t, o.comp_type ot, {TURN} turn from m join refs r using (panel_id, ref_id) left join obs o on o.panel_id = m.panel_id and o.obs_id = m.obs_id),
err as (select panel_id, ref_id, obs_id, 'missing_component' type, 'error' severity from j where obs_id is null union all select panel_id, ref_id, obs_id, 'wrong_component', 'error' from j where t <> ot
  union all select panel_id, ref_id, obs_id, 'moved_component', 'warning' from j where t = ot and c > 25 union all select panel_id, ref_id, obs_id, 'wrong_rotation', 'warning' from j where t = ot and turn > 20
  union all select panel_id, null, obs_id, 'extra_component', 'error' from obs where (panel_id, obs_id) not in (select (panel_id, obs_id) from m where obs_id is not null))"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = g.centre(g.box())
    return view(spark, d, "ground_truth").select(F.col("image_id").alias("panel_id"), F.col("gt_id").alias("ref_id"), F.col("class_id").alias("comp_type"), cx.alias("cx"), cy.alias("cy"), (F.col("gt_id") % 180).cast("double").alias("rotation"))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = g.centre(g.box())
    return view(spark, d, "detections").where("det_id % 7 <> 3").select(F.col("image_id").alias("panel_id"), F.col("det_id").alias("obs_id"), F.col("class_id").alias("comp_type"), cx.alias("cx"), cy.alias("cy"), (F.col("det_id") * 7 % 180).cast("double").alias("rotation"))


@query(f"with {COMPONENTS} select * from err", "detections", "ground_truth")
def j16_component_diff(spark: SparkSession, d: str) -> DataFrame:
    return cp.component_diff(_refs(spark, d), _obs(spark, d))


@query(f"with {COMPONENTS} select panel_id, n_err, n_warn, round(greatest(0.0, 1 - (n_err + 0.4 * n_warn) / n), 6)::double score, case when n_err > 0 then 'fail' when n_warn > 0 then 'warning' else 'pass' end status from (select p.panel_id, p.n, count(*) filter (where severity = 'error') n_err, count(*) filter (where severity = 'warning') n_warn from (select panel_id, count(*) n from refs group by 1) p left join err using (panel_id) group by 1, 2)", "detections", "ground_truth")
def a39_inspection_score(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return cp.inspection_score(cp.component_diff(refs, _obs(spark, d)), refs.groupBy("panel_id").agg(F.count("*").alias("n_elements"))).select("panel_id", "n_err", "n_warn", R("score"), "status")


WREFS = "refs as (select image_id panel_id, gt_id ref_id, x1 sx, y1 sy, x2 ex, y2 ey, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) length, case when gt_id % 3 = 0 then 'red' else 'blue' end color from ground_truth)"
WOBS = "obs as (select image_id panel_id, det_id obs_id, case when det_id % 2 = 0 then x2 else x1 end sx, case when det_id % 2 = 0 then y2 else y1 end sy, case when det_id % 2 = 0 then x1 else x2 end ex, case when det_id % 2 = 0 then y1 else y2 end ey, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) * case when det_id % 11 = 0 then 0.3 else 1 end length, case when det_id % 4 = 0 then 'unknown' when det_id % 5 = 0 then 'red' else 'blue' end color from detections where det_id % 7 <> 3)"


def seg_sql(p: str, q: str) -> str:
    """Distance of point (p, q) from the reference segment r."""
    t = f"greatest(0.0, least(1.0, coalesce((({p} - r.sx) * (r.ex - r.sx) + ({q} - r.sy) * (r.ey - r.sy)) / nullif(power(r.ex - r.sx, 2) + power(r.ey - r.sy, 2), 0), 0.0)))"
    return f"sqrt(power({p} - r.sx - {t} * (r.ex - r.sx), 2) + power({q} - r.sy - {t} * (r.ey - r.sy), 2))"


DIST = lambda a, b, c, e: f"sqrt(power({a} - {c}, 2) + power({b} - {e}, 2))"
ENDS = f"least({DIST('r.sx', 'r.sy', 'o.sx', 'o.sy')} + {DIST('r.ex', 'r.ey', 'o.ex', 'o.ey')}, {DIST('r.sx', 'r.sy', 'o.ex', 'o.ey')} + {DIST('r.ex', 'r.ey', 'o.sx', 'o.sy')})"
ANG = "abs(degrees(atan2(r.ey - r.sy, r.ex - r.sx)) - degrees(atan2(o.ey - o.sy, o.ex - o.sx)))"
COST = f"case when least({ANG} % 180, 180 - {ANG} % 180) < 30 then least({ENDS}, 2 * greatest({seg_sql('(o.sx + o.ex) / 2', '(o.sy + o.ey) / 2')}, 0.5 * {seg_sql('o.sx', 'o.sy')}, 0.5 * {seg_sql('o.ex', 'o.ey')})) else {ENDS} end"
WIRES = f"{WREFS}, {WOBS}, {assign_sql(f'select * from (select r.panel_id, r.ref_id, o.obs_id, round({COST}, 6) c from refs r join obs o using (panel_id)) where c < 90')}, j as (select m.*, r.length l, o.length ol, r.color k, o.color ok from m join refs r using (panel_id, ref_id) left join obs o on o.panel_id = m.panel_id and o.obs_id = m.obs_id)"


@query(
    f"with {WIRES} select panel_id, ref_id, obs_id, 'missing_wire' type from j where obs_id is null union all select panel_id, ref_id, obs_id, 'broken_wire' from j where ol / l < 0.6 union all select panel_id, ref_id, obs_id, 'wrong_wire_color' from j where k <> ok and k <> 'unknown' and ok <> 'unknown' union all select panel_id, null, obs_id, 'extra_wire' from obs where (panel_id, obs_id) not in (select (panel_id, obs_id) from m where obs_id is not null)",
    "detections",
    "ground_truth",
)
def j17_wire_diff(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "ground_truth")
    refs = t.select(F.col("image_id").alias("panel_id"), F.col("gt_id").alias("ref_id"), F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"), g.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("length"), F.when(F.col("gt_id") % 3 == 0, "red").otherwise("blue").alias("color"))
    i = F.col("det_id")
    flip = lambda a, b, n: F.when(i % 2 == 0, F.col(a)).otherwise(F.col(b)).alias(n)
    obs = view(spark, d, "detections").where("det_id % 7 <> 3").select(F.col("image_id").alias("panel_id"), i.alias("obs_id"), flip("x2", "x1", "sx"), flip("y2", "y1", "sy"), flip("x1", "x2", "ex"), flip("y1", "y2", "ey"), (g.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]) * F.when(i % 11 == 0, 0.3).otherwise(1.0)).alias("length"), F.when(i % 4 == 0, "unknown").when(i % 5 == 0, "red").otherwise("blue").alias("color"))
    return cp.wire_diff(refs, obs)


OREFS = "refs as (select image_id, gt_id ref_id, class_id label, x1, y1, x2, y2 from ground_truth), obs as (select image_id, det_id obs_id, class_id label, x1, y1, x2, y2 from detections where det_id % 7 <> 3)"
OPAIRS = f"select * from (select r.image_id, r.ref_id, o.obs_id, -{iou_sql('r', 'o')} c from refs r join obs o using (image_id)) where c < -0.25"


@query(
    f"with {OREFS}, {assign_sql(OPAIRS, panel='image_id')}, j as (select m.image_id, m.ref_id, m.obs_id, r.label l, o.label ol, sqrt(power((r.x1 + r.x2 - o.x1 - o.x2) / 2, 2) + power((r.y1 + r.y2 - o.y1 - o.y2) / 2, 2)) s from m join refs r using (image_id, ref_id) left join obs o on o.image_id = m.image_id and o.obs_id = m.obs_id) "
    "select * from (select image_id, ref_id, obs_id, case when obs_id is null then 'missing_object' when l <> ol then 'changed_object' when s > 20 then 'moved_object' end type from j) where type is not null union all select image_id, null, obs_id, 'new_object' from obs where (image_id, obs_id) not in (select (image_id, obs_id) from m where obs_id is not null)",
    "detections",
    "ground_truth",
)
def j18_object_diff(spark: SparkSession, d: str) -> DataFrame:
    refs = view(spark, d, "ground_truth").select("image_id", F.col("gt_id").alias("ref_id"), F.col("class_id").alias("label"), "x1", "y1", "x2", "y2")
    cur = view(spark, d, "detections").where("det_id % 7 <> 3").select("image_id", F.col("det_id").alias("obs_id"), F.col("class_id").alias("label"), "x1", "y1", "x2", "y2")
    return cp.object_diff(refs, cur)


COUNTS = "e as (select case when o_orderpriority like '%URGENT' then 'wire' else 'component' end kind, o_orderpriority || o_custkey % 40 \"name\", count(*) n from orders where o_orderkey % 2 = 0 group by all), o as (select case when o_orderpriority like '%URGENT' then 'wire' else 'component' end kind, o_orderpriority || o_custkey % 40 \"name\", count(*) n from orders where o_orderkey % 2 = 1 group by all)"
DIFF = f"""{COUNTS}, b as (select coalesce(e.kind, o.kind) kind, coalesce(e.name, o.name) "name", coalesce(e.n, 0) expected, coalesce(o.n, 0) found from e full join o on e.kind = o.kind and e.name = o.name),
df as (select *, case when expected > 0 and found = 0 then case kind when 'component' then 'missing_component' else 'missing_wire_color' end when found > 0 and expected = 0 then case kind when 'component' then 'extra_component' else 'unexpected_wire_color' end when kind = 'component' and expected <> found then 'wrong_count' end type from b)"""


def _counts(spark: SparkSession, d: str, odd: int) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == odd)
    return o.groupBy(F.when(F.col("o_orderpriority").endswith("URGENT"), "wire").otherwise("component").alias("kind"), F.concat("o_orderpriority", F.col("o_custkey") % 40).alias("name")).agg(F.count("*").alias("n"))


@query(f"with {DIFF} select kind, \"name\", expected, found, type from df where type is not null")
def j8_count_diff(spark: SparkSession, d: str) -> DataFrame:
    return cp.count_diff(_counts(spark, d, 0), _counts(spark, d, 1))


@query(f"with {DIFF} select count(*) n, case when count(*) filter (where type in ('missing_component', 'extra_component', 'wrong_count')) > 0 then 'fail' when count(*) > 0 then 'warning' else 'pass' end status from df where type is not null")
def d21_count_inspection(spark: SparkSession, d: str) -> DataFrame:
    return cp.count_status(cp.count_diff(_counts(spark, d, 0), _counts(spark, d, 1)))


@query(f"with t as (select image_id, gt_id item_id, x1 + 30 x1, y1 + 20 y1, x1 + 90 x2, y1 + 40 y2 from ground_truth) select image_id, item_id, det_id from (select t.image_id, item_id, det_id, row_number() over (partition by t.image_id, item_id order by {contain_sql('d', 't')} desc, det_id desc) r from t join detections d using (image_id) where {contain_sql('d', 't')} >= 0.6) where r = 1", "detections", "ground_truth")
def j13_text_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "ground_truth").select("image_id", F.col("gt_id").alias("item_id"), (F.col("x1") + 30).alias("x1"), (F.col("y1") + 20).alias("y1"), (F.col("x1") + 90).alias("x2"), (F.col("y1") + 40).alias("y2"))
    return cp.text_in_boxes(items, view(spark, d, "detections"))


@query("select image_id, det_id, gt_id from (select d.image_id, det_id, gt_id, row_number() over (partition by det_id order by sqrt(power(d.x1 - g.x1, 2) + power(d.y1 - g.y1, 2)), gt_id) r from detections d join ground_truth g using (image_id) where sqrt(power(d.x1 - g.x1, 2) + power(d.y1 - g.y1, 2)) < 18) where r = 1", "detections", "ground_truth")
def j15_nearest_within(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "detections").select("image_id", "det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    t = view(spark, d, "ground_truth").select("image_id", "gt_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return cp.nearest_within(p, t, "image_id", "det_id", "gt_id", 18.0)


@query("with e as (select distinct 's' || l_suppkey src, 'p' || l_partkey dst from lineitem), b as (select src node, dst other from e union select dst, src from e), n as (select 's' || s_suppkey node from supplier union select 'p' || p_partkey from part) select node, coalesce(string_agg(other, ',' order by other), '') neighbours, count(other) degree from n left join b using (node) group by 1")
def g3_adjacency(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).union(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    return cp.adjacency(nodes, edges).select("node", F.array_join("neighbours", ",").alias("neighbours"), F.col("degree").cast("long").alias("degree"))


@query("select image_id, det_id, coalesce(case when det_id % 3 = 0 then 'T' || det_id % 10 end, 'C' || det_id % 10) src, coalesce(case when det_id % 4 = 0 then 'T' || det_id % 7 end, 'C' || det_id % 7) dst from detections", "detections")
def g1_wire_graph(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("det_id")
    none = spark.createDataFrame([], "ref_id string, comp_type string, kind string")
    wires = view(spark, d, "detections").select(F.concat_ws("/", "image_id", i).alias("wire_uid"), F.when(i % 3 == 0, F.concat(F.lit("T"), i % 10)).alias("from_terminal"), F.concat(F.lit("C"), i % 10).alias("from_component"), F.when(i % 4 == 0, F.concat(F.lit("T"), i % 7)).alias("to_terminal"), F.concat(F.lit("C"), i % 7).alias("to_component"), F.lit("red").alias("color"))
    edges = cp.wire_graph(none, none, wires)[1]
    return edges.select(F.split_part("edge", F.lit("/"), F.lit(1)).cast("long").alias("image_id"), F.split_part("edge", F.lit("/"), F.lit(2)).cast("long").alias("det_id"), "src", "dst")


DEVICE_TEXT = "concat('Q', doc_id % 9 + 1, ' feeds KM', doc_id % 7 + 1, ' via -X1:', doc_id % 5 + 1, '; w', doc_id % 11, ' wire ', doc_id % 3 + 1, ' and Q', doc_id % 9 + 1, ' -> KM', doc_id % 7 + 1, '. ', n_chars)"


def _devices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(DEVICE_TEXT).alias("text"))


@query(
    f"with t as (select doc_id, {DEVICE_TEXT} text from documents) select doc_id, 'Q' || (doc_id % 9 + 1) tag, 'component' kind, 'circuit_breaker' type from t union select doc_id, 'KM' || (doc_id % 7 + 1), 'component', 'contactor' from t union select doc_id, 'X1', 'component', 'terminal_block' from t union select doc_id, 'X1:' || (doc_id % 5 + 1), 'terminal', null from t union select doc_id, 'W' || doc_id % 11, 'wire', null from t union select doc_id, 'WIRE' || (doc_id % 3 + 1), 'wire', null from t"
)
def f16_document_tags(spark: SparkSession, d: str) -> DataFrame:
    return tx.document_tags(_devices(spark, d), "doc_id")


@query("select doc_id, 'Q' || (doc_id % 9 + 1) src, 'KM' || (doc_id % 7 + 1) dst from documents")
def g4_expected_graph(spark: SparkSession, d: str) -> DataFrame:
    t = _devices(spark, d)
    edges = cp.expected_graph(tx.document_tags(t, "doc_id"), tx.document_links(t, "doc_id"), "doc_id")[1]
    return edges.select("doc_id", "src", "dst")


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') norm from part")
def f13_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.normalise(F.concat_ws(" - ", "p_name", "p_type")).alias("norm"))


ALIASES = (("mcb", "mcb", 0), ("circuit_breaker", "circuit_breaker", 1), ("miniature_circuit_breaker", "mcb", 2), ("relay", "relay", 3), ("overload_relay", "overload_relay", 4), ("contactor", "contactor", 5))
LABELS = "case doc_id % 8 when 0 then 'MCB' when 1 then 'MCBs' when 2 then 'Schneider LC1D Contactor' when 3 then 'Thermal overload-relay' when 4 then 'circuit breaker' when 5 then 'Siemens Miniature Circuit Breaker 3P' when 6 then 'relays' else 'gizmo' end"


@query(f"select doc_id, case doc_id % 8 when 0 then 'mcb' when 1 then 'mcb' when 2 then 'contactor' when 3 then 'overload_relay' when 4 then 'circuit_breaker' when 5 then 'mcb' when 6 then 'relay' end class_id from (select doc_id, {LABELS} from documents)")
def j10_resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "documents").select("doc_id", F.expr(LABELS).alias("label"))
    return tx.resolve(labels, spark.createDataFrame(list(ALIASES), "alias string, class_id string, ordinal int")).select("doc_id", "class_id")


@query("with s(pattern, maker, family, specificity, ordinal) as (values ('the', 'A', 'x', 1, 0), ('the th', 'B', 'y', 3, 1), ('ing', 'C', 'z', 3, 2), ('ción', 'D', 'w', 2, 3)) select doc_id, maker, family, specificity from (select doc_id, s.*, row_number() over (partition by doc_id order by specificity desc, ordinal) r from documents join s on regexp_matches(text, pattern)) where r = 1")
def j25_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("the", "A", "x", 1, 0), ("the th", "B", "y", 3, 1), ("ing", "C", "z", 3, 2), ("ción", "D", "w", 2, 3)], "pattern string, maker string, family string, specificity int, ordinal int")
    return tx.signature_match(table(spark, d, "documents").select("doc_id", "text"), s, "doc_id")


TOKENS = r"list_distinct(list_transform(list_filter(list_transform(string_split(trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,:;|]+|[.,:;|]+$', '', 'g')), lambda w: length(w) >= 2), lambda w: lower(w)))"


@query(f"with p as (select a.conv_id, a.turn, {TOKENS.format(t='a.text')} x, {TOKENS.format(t='b.text')} y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1) select conv_id, turn, len(list_filter(x, lambda w: not list_contains(y, w))) removed, len(list_filter(y, lambda w: not list_contains(x, w))) added from p")
def u2_token_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("x"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("x", "y")).cast("long").alias("removed"), F.size(F.array_except("y", "x")).cast("long").alias("added"))


@query(r"select page_id, regexp_replace(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/@:]*):[^/@]+@', '\1:***@') redacted from (select page_id, case when page_id % 3 = 0 then 'rtsp://user:secret' || page_id || '@cam/stream' when page_id % 3 = 1 then 'rtsp://cam:554/a' else url end u from pages)")
def p22_redact(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("rtsp://user:secret"), "page_id", F.lit("@cam/stream"))).when(F.col("page_id") % 3 == 1, F.lit("rtsp://cam:554/a")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.redact_password(u).alias("redacted"))


@query("select page_id, case page_id % 6 when 0 then 'numeric_device_index' when 1 then 'local_file_or_path' when 2 then null when 3 then 'missing_host' when 4 then 'empty' else 'unsupported_scheme' end problem from pages")
def p23_source_address(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    u = F.when(k == 0, "0").when(k == 1, "/dev/video0").when(k == 2, "rtsp://user:pw@10.0.0.5:554/live").when(k == 3, "rtsp:///live").when(k == 4, "  ").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.source_problem(u).alias("problem"))


@query("select image_id, det_id, round(0.5 * score + 0.2 * (1 - score) + 0.15 * score * score + 0.15, 6) likeness, case when 0.5 * score + 0.2 * (1 - score) + 0.15 * score * score + 0.15 >= 0.6 then 'minor' else 'major' end status from detections", "detections")
def a41_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    v = cp.similarity(s, 1 - s, s * s, F.lit(1.0))
    return view(spark, d, "detections").select("image_id", "det_id", F.round(v, 6).alias("likeness"), F.when(v >= 0.6, "minor").otherwise("major").alias("status"))


@query("select image_id, count(*) filter (score < 0.2 and det_id % 5 = 0) n_diffs, case when count(*) filter (score < 0.2 and det_id % 5 = 0) = 0 then 'identical' when count(*) filter (score < 0.1 and det_id % 5 = 0) > 0 then 'major' else 'minor' end status from detections group by 1", "detections")
def a41_pair_status(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections")
    diffs = rows.where((F.col("score") < 0.2) & (F.col("det_id") % 5 == 0)).select("image_id", F.when(F.col("score") < 0.1, "major").otherwise("minor").alias("severity"))
    return cp.pair_status(rows.select("image_id").distinct(), diffs, "image_id")


@query(f"with p as (select a.det_id, {iou_sql('a', 'b')} v, {contain_sql('b', 'a')} c from detections a join detections b on a.image_id = b.image_id and b.det_id = a.det_id + 10) select det_id, round(v, 6) iou, round(c, 6) inside from p", "detections")
def f1_iou(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "detections")
    b = a.select("image_id", (F.col("det_id") - 10).alias("det_id"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, ["image_id", "det_id"]).select("det_id", F.round(g.iou(g.box(), g.box("o")), 6).alias("iou"), F.round(g.containment(g.box(), g.box("o")), 6).alias("inside"))


@query("select det_id, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) dist, round(degrees(atan2(y2 - y1, x2 - x1)), 6) angle, round(least(abs(det_id % 360 - 45.0) % 180, 180 - abs(det_id % 360 - 45.0) % 180), 6)::double turn from detections", "detections")
def f6_points(spark: SparkSession, d: str) -> DataFrame:
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return view(spark, d, "detections").select("det_id", R(g.distance(*p), "dist"), R(g.angle(*p), "angle"), R(g.axis_difference((F.col("det_id") % 360).cast("double"), F.lit(45.0)), "turn"))


@query("select det_id, round((1.1 * x1 + 0.05 * y1 + 3) / (0.0001 * x1 + 0.0002 * y1 + 1), 6) wx, round((-0.02 * x1 + 0.95 * y1 - 4) / (0.0001 * x1 + 0.0002 * y1 + 1), 6) wy from detections", "detections")
def f8_warp(spark: SparkSession, d: str) -> DataFrame:
    h = F.array(*[F.array(*map(F.lit, r)) for r in ((1.1, 0.05, 3.0), (-0.02, 0.95, -4.0), (0.0001, 0.0002, 1.0))])
    x, y = g.warp(h, F.col("x1"), F.col("y1"))
    return view(spark, d, "detections").select("det_id", R(x, "wx"), R(y, "wy"))


@query("select det_id, round((x2 - x1) + (y2 - y1), 6) length from detections", "detections")
def f9_polyline(spark: SparkSession, d: str) -> DataFrame:
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return view(spark, d, "detections").select("det_id", R(g.polyline_length(F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2"))), "length"))


@query("select det_id, round((x1 + x2) / 2 / 1024, 6) cx, round((y1 + y2) / 2 / 768, 6) cy, round((x2 - x1) / 1024, 6) w, round((y2 - y1) / 768, 6) h, round(greatest(0.0, x1), 6) px from detections", "detections")
def f5_normalise_boxes(spark: SparkSession, d: str) -> DataFrame:
    cx, cy, w, h = g.normalised(g.box(), 1024, 768)
    rows = view(spark, d, "detections").select("det_id", cx.alias("a"), cy.alias("b"), w.alias("c"), h.alias("e"))
    px = g.to_pixels(F.col("a"), F.col("b"), F.col("c"), F.col("e"), 1024, 768)[0]
    return rows.select("det_id", R("a", "cx"), R("b", "cy"), R("c", "w"), R("e", "h"), R(px, "px"))
