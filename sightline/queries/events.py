"""Event, attendance and telemetry tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators import events as ev
from sightline.operators import reports as rp
from sightline.registry import query
from sightline.views import table, view

R = lambda c, name: F.round(c, 6).alias(name)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, count(*) n, sum(user_id)::bigint users from events where value >= 10 group by event_type")
def s1_parametrised_scan(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select event_type, count(*) n, sum(user_id) users from {events} where value >= :least group by event_type", {"least": 10}, events=_events(spark, d))


@query("select event_id, event_type, user_id from events where event_id = 77")
def s2_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id = 77").select("event_id", "event_type", "user_id")


@query("select event_id, value from events union all select event_id + 1000000, value * 2 from events where event_type = 'error'")
def s3_append(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "events").select("event_id", "value")
    new = table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") + 1_000_000).alias("event_id"), (F.col("value") * 2).alias("value"))
    return old.unionByName(new)


@query("select key, value, seq from (select *, row_number() over (partition by key order by seq desc, isnew desc) r from (select user_id key, event_type value, event_id seq, 0 isnew from events where event_id % 2 = 0 union all select user_id, event_type || '!', event_id, 1 from events where event_id % 3 = 0)) where r = 1")
def s4_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return ev.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 3 = 0").withColumn("value", F.concat("value", F.lit("!"))), ["key"], ["seq"])


@query("select 'orders' t, count(*) n, sum(o_orderkey)::bigint keys from orders where o_orderstatus <> 'F' union all select 'lineitem', count(*), sum(l_orderkey)::bigint from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def s5_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    parents, kids = ev.delete_cascade(table(spark, d, "orders"), {"lineitem": (table(spark, d, "lineitem"), "l_orderkey")}, "o_orderkey", F.col("o_orderstatus") == "F")
    count = lambda df, t, k: df.agg(F.count("*").alias("n"), F.sum(k).alias("keys")).select(F.lit(t).alias("t"), "n", "keys")
    return count(parents, "orders", "o_orderkey").unionByName(count(kids["lineitem"], "lineitem", "l_orderkey"))


@query("select event_id, event_type, null::varchar note, user_id from events where event_id % 2 = 0 union all select event_id, event_type, 'n' || user_id, null from events where event_id % 2 = 1")
def s7_schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 0").select("event_id", "event_type", "user_id")
    new = e.where("event_id % 2 = 1").select("event_id", "event_type", F.concat(F.lit("n"), "user_id").alias("note"))
    return old.unionByName(new, allowMissingColumns=True)


@query("select doc_id, sha256(text) sha from documents")
def s11_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("select event_id, user_id from events where event_type = 'error' and user_id = 3")
def p1_equal_filters(spark: SparkSession, d: str) -> DataFrame:
    return ev.filter_equal(table(spark, d, "events"), {"event_type": "error", "user_id": 3, "props": None}).select("event_id", "user_id")


@query("select event_id, event_type from events where event_type in ('error', 'signup') order by ts desc, event_id desc limit 100")
def p2_in_list_recent(spark: SparkSession, d: str) -> DataFrame:
    return ev.recent(table(spark, d, "events").where(F.col("event_type").isin("error", "signup")), "ts", "event_id", 100).select("event_id", "event_type")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def p3_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select event_id, case when event_id % 5 = 0 then null else cast(props ->> '$.k' as bigint) end k, case when event_id % 5 = 0 then substr(props, 2) end kept_text from events")
def p4_tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    parsed, raw = ev.parse_tolerant(text, "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), raw.alias("kept_text"))


@query("select det_id, score from detections where score >= 0.8", "detections")
def p5_post_gate_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").where("score >= 0.8").select("det_id", "score")


@query("select count(*) n from events where event_type = 'click'")
def a1_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").agg(F.count("*").alias("n"))


@query("select event_type, count(*) n from events group by 1")
def a2_events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("select class_id, count(*) n, round(avg(score), 6) mean_score from detections group by 1", "detections")
def a3_component_summary(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").groupBy("class_id").agg(F.count("*").alias("n"), R(F.avg("score"), "mean_score"))


@query("select o_orderpriority kind, count(*) n from orders group by 1")
def a4_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("select cast(ts as date) \"day\", count(distinct user_id) present, count(*) records from events group by 1 order by 1 desc limit 14")
def a5_attendance_by_day(spark: SparkSession, d: str) -> DataFrame:
    return ev.presence(_events(spark, d), F.to_date("ts"), "user_id", 14)


@query("select (select count(distinct user_id) from events where cast(ts as date) = (select max(cast(ts as date)) from events)) present, (select count(*) from customer) heads")
def a6_present_today(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", F.to_date("ts").alias("day"))
    today = e.agg(F.max("day").alias("day"))
    return e.join(F.broadcast(today), "day").agg(F.count_distinct("user_id").alias("present")).join(table(spark, d, "customer").agg(F.count("*").alias("heads")))


@query("select (select count(*) from events) events, (select count(*) from events where event_type = 'error') errors, (select count(*) from events where event_type = 'signup') signups, (select count(*) from orders where o_orderstatus = 'O') open_orders, (select count(*) from customer) customers")
def a7_dashboard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    o = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
    return e.join(o).join(table(spark, d, "customer").agg(F.count("*").alias("customers")))


@query("select event_id, user_id from events order by ts desc, event_id desc limit 50 offset 100")
def t1_recent_page(spark: SparkSession, d: str) -> DataFrame:
    return ev.recent(table(spark, d, "events"), "ts", "event_id", 50, 100).select("event_id", "user_id")


@query("select c_custkey, c_name from customer order by c_name, c_custkey limit 20")
def t2_by_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(20)


WALK = """o as (select *, row_number() over (partition by {key} order by t, event_id) n from sightings),
walk as (
  select distinct {key}, 0::bigint n, null::bigint last, null::bigint "day", false fire, null::bigint event_id from o
  union all
  select w.{key}, o.n, case when w.last is null or o.t - w.last >= {s} then o.t else w.last end,
    case when (w.last is null or o.t - w.last >= {s}) and {daily} then o.t // 86400 else w."day" end,
    (w.last is null or o.t - w.last >= {s}) and {daily}, o.event_id
  from walk w join o on o.{key} = w.{key} and o.n = w.n + 1)"""


@query(f"with {WALK.format(key='event_type', s=600, daily='true')} select event_type, event_id from walk where fire", "sightings")
def r2_event_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ev.rate_limit(view(spark, d, "sightings"), ["event_type"], "t", "event_id", 600)


@query(f"with {WALK.format(key='user_id', s=28800, daily='true')} select user_id, event_id from walk where fire", "sightings")
def r3_attendance(spark: SparkSession, d: str) -> DataFrame:
    return ev.attendance(view(spark, d, "sightings"), "user_id", "t", "event_id", 28_800)


@query(f"""with {WALK.format(key='user_id', s=43200, daily='(w."day" is null or w."day" <> o.t // 86400)')} select user_id, event_id from walk where fire""", "sightings")
def r3_attendance_daily(spark: SparkSession, d: str) -> DataFrame:
    return ev.attendance(view(spark, d, "sightings"), "user_id", "t", "event_id", 43_200)


@query("select event_id, n_changes::bigint n_changes from (select *, sum(case when changed then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) n_changes from (select *, coalesce(lag(up) over (partition by user_id order by t, event_id) <> up, false) changed from (select *, value >= 10 up from sightings))) where changed", "sightings")
def w12_state_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings")
    return ev.state_changes(rows, ["user_id"], "t", "event_id", F.col("value") >= 10).select("event_id", "n_changes")


@query("select event_id, n, span, round(mean, 9) mean from (select event_id, count(*) over w n, max(t) over w - min(t) over w span, avg(value) over w mean from sightings window w as (partition by user_id order by t, event_id rows between 59 preceding and current row))", "sightings")
def w8_rolling_rates(spark: SparkSession, d: str) -> DataFrame:
    return ev.rolling_rates(view(spark, d, "sightings"), ["user_id"], "t", "event_id", "value").select("event_id", "n", "span", F.round("mean", 9).alias("mean"))


@query("select event_type, count(*) n, round(case when max(event_id) > min(event_id) then (count(*) - 1) / (max(event_id) - min(event_id)) else 0 end, 6) fps, round(max_by(value, event_id), 6) last_latency, round(avg(value), 6) mean_latency, round(max(value), 6) max_latency from events group by 1")
def a43_frame_rates(spark: SparkSession, d: str) -> DataFrame:
    out = ev.frame_rates(table(spark, d, "events"), ["event_type"], "event_id", "value")
    return out.select("event_type", "n", *[R(c, c) for c in ("fps", "last_latency", "mean_latency", "max_latency")])


@query("select count(*) cameras, count(*) filter (where up) connected, round(sum(fps), 6) fps, round(avg(lat), 6) mean_latency from (select user_id, max_by(value, event_id) >= 10 up, count(*) / 3600 fps, case when user_id % 3 = 0 then null else avg(value) end lat from events group by 1)")
def a42_fleet(spark: SparkSession, d: str) -> DataFrame:
    cams = table(spark, d, "events").groupBy("user_id").agg((F.max_by("value", "event_id") >= 10).alias("up"), (F.count("*") / 3600).alias("fps"), F.avg("value").alias("latency"))
    out = rp.fleet(cams.withColumn("latency", F.when(F.col("user_id") % 3 != 0, F.col("latency"))))
    return out.select("cameras", "connected", R("fps", "fps"), R("mean_latency", "mean_latency"))


@query("select 'camera' kind, user_id::varchar name, count(*) n, round(avg(value), 6) mean from events group by 2 union all select 'task', event_type, count(*), round(avg(value), 6) from events group by 2")
def a51_consolidated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    part = lambda kind, col: e.groupBy(F.col(col).cast("string").alias("name")).agg(F.count("*").alias("n"), R(F.avg("value"), "mean")).select(F.lit(kind).alias("kind"), "name", "n", "mean")
    return part("camera", "user_id").unionByName(part("task", "event_type"))


@query("select event_type, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99, round(avg(value), 6) mean, min(value) least, max(value) most, round(stddev_samp(value), 6) sd, round(1000 / avg(value), 6) fps, coalesce(stddev_samp(value) / avg(value) > 0.35, false) unsteady from events group by 1")
def a29_latency_profile(spark: SparkSession, d: str) -> DataFrame:
    out = rp.latency_profile(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "p50", "p95", "p99", R("mean", "mean"), "least", "most", R("sd", "sd"), R("fps", "fps"), rp.unsteady(F.col("sd"), F.col("mean")).alias("unsteady"))


@query("select image_id, count(*) n from detections where class_id = 'plc' group by 1", "detections")
def a46_crowd_count(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").where("class_id = 'plc'").groupBy("image_id").agg(F.count("*").alias("n"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def w4_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id", "m.value")


@query("select e.event_id, (select p.event_id from sightings p where p.user_id = e.user_id and p.event_type = 'signup' and (p.t < e.t or (p.t = e.t and p.event_id < e.event_id)) order by p.t desc, p.event_id desc limit 1) last_signup from sightings e", "sightings")
def j24_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings")
    return rp.as_of(rows, "user_id", "t", "event_id", F.col("event_type") == "signup", "event_id").select("event_id", F.col("as_of").alias("last_signup"))


@query("select event_id, user_id % 4 = 0 or value < 3 unhealthy from events")
def p16_camera_health(spark: SparkSession, d: str) -> DataFrame:
    healthy = rp.camera_healthy(F.col("user_id") % 4 != 0, F.when(F.col("value") < 3, 9_000).otherwise(100))
    return table(spark, d, "events").select("event_id", (~healthy).alias("unhealthy"))


@query("select c_custkey, c_name, n_orders, n_lines from customer left join (select o_custkey, count(*) n_orders from orders group by 1) o on o_custkey = c_custkey left join (select o_custkey k, count(*) n_lines from orders join lineitem on l_orderkey = o_orderkey group by 1) l on k = c_custkey".replace("n_orders, n_lines from", "coalesce(n_orders, 0) n_orders, coalesce(n_lines, 0) n_lines from"))
def j2_parent_child_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k")).join(o, "o_orderkey").groupBy("c_custkey").agg(F.sum("k").alias("n_lines"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(n, "c_custkey", "left").join(m, "c_custkey", "left").fillna(0, ["n_orders", "n_lines"])


@query("select vec_id, label, n_name from embeddings join nation on n_nationkey = label")
def j1_inner_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("label"), "n_name")
    return table(spark, d, "embeddings").select("vec_id", "label").join(n, "label")


@query("select o_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey} order by l_linenumber, l_partkey)::varchar lines from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by 1".replace("::varchar lines", " lines").replace("list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey} order by l_linenumber, l_partkey) lines", "string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) lines"))
def j3_assembly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kids = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("k"))
    return kids.select("o_orderkey", F.concat_ws(",", F.transform("k", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))).alias("lines"))
