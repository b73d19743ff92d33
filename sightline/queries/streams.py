"""Batch twins of the stateful rules, over the given tables, and streams over them that run to their end."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import events as ev
from sightline.operators import tracking
from sightline.plans.lineage import materialize, scratch_path
from sightline.queries.events import WALK
from sightline.queries.jobs import FACES, d27_recognise
from sightline.registry import query
from sightline.streaming import logs, rules
from sightline.views import table, view


@query(f"with {WALK.format(key='user_id', s=7200, daily='true')} select s.user_id, s.event_id from sightings s join (select w.user_id, o.t from walk w join sightings o using (event_id) where fire) k on k.user_id = s.user_id and k.t = s.t", "sightings")
def r4_component_throttle(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings")
    frames = rows.groupBy("user_id", "t").agg(F.min("event_id").alias("event_id"))
    kept = ev.rate_limit(frames, ["user_id"], "t", "event_id", 7_200).join(frames, ["user_id", "event_id"]).select("user_id", "t")
    return rows.join(kept, ["user_id", "t"], "left_semi").select("user_id", "event_id")


@query(f"with {WALK.format(key='user_id', s=7200, daily='true')}, f as (select user_id, event_id, value, t from walk join sightings using (event_id, user_id) where fire) select s.event_id, (select f.event_id from f where f.user_id = s.user_id and (f.t < s.t or (f.t = s.t and f.event_id <= s.event_id)) order by f.t desc, f.event_id desc limit 1) result_of from sightings s", "sightings")
def r5_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return ev.carry_forward(view(spark, d, "sightings"), ["user_id"], "t", "event_id", 7_200).select("event_id", "result_of")


@query(None)
def r6_tracks(spark: SparkSession, d: str) -> DataFrame:
    frames = view(spark, d, "detections").select(F.concat(F.lit("cam"), F.col("image_id") % 4).alias("camera_id"), F.col("class_id").alias("label"), F.col("image_id").alias("frame_no"), "det_id", "score", "x1", "y1", "x2", "y2")
    return tracking.track(frames)


@query("select user_id, t // 3600 * 3600 start, count(*) n, round(avg(value), 6) mean_latency, max(value) max_latency from sightings group by 1, 2", "sightings")
def r7_windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    out = rules.windowed_rates(view(spark, d, "sightings").withColumn("ts", F.timestamp_seconds("t")), "user_id", "ts", "value", "1 hour")
    return out.select("user_id", F.unix_seconds("start").alias("start"), "n", F.round("mean_latency", 6).alias("mean_latency"), "max_latency")


@query("select user_id, t, event_id from (select *, row_number() over (partition by user_id order by t desc, event_id desc) r from sightings) where r = 1", "sightings")
def r8_latest(spark: SparkSession, d: str) -> DataFrame:
    return rules.latest(view(spark, d, "sightings"), "user_id", "t", "event_id").select("user_id", "t", "event_id")


@query("select user_id, max(n_changes)::bigint reconnects from (select user_id, sum(case when changed and up then 1 else 0 end) over (partition by user_id) n_changes from (select *, coalesce(lag(up) over (partition by user_id order by t, event_id) <> up, false) changed from (select *, event_type <> 'error' up from sightings))) group by 1 having max(n_changes) > 0", "sightings")
def r9_reconnects(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings")
    changes = ev.state_changes(rows, ["user_id"], "t", "event_id", F.col("event_type") != "error")
    return changes.where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("reconnects"))


ALERT = "case event_type when 'error' then 'fire_detected' when 'signup' then 'ppe_violation' when 'purchase' then 'fall_detected' end"


@query(f"with a as (select user_id % 5 cam, {ALERT} alert, event_id, t from sightings where {ALERT} is not null), o as (select *, row_number() over (partition by cam, alert order by t, event_id) n from a), walk as (select distinct cam, alert, 0::bigint n, null::bigint last, false fire, null::bigint event_id from o union all select w.cam, w.alert, o.n, case when w.last is null or o.t - w.last >= 3600 then o.t else w.last end, w.last is null or o.t - w.last >= 3600, o.event_id from walk w join o on o.cam = w.cam and o.alert = w.alert and o.n = w.n + 1) select cam, alert, event_id from walk where fire", "sightings")
def r10_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    task = F.when(e == "error", "fire").when(e == "signup", "ppe").when(e == "purchase", "fall").otherwise("other")
    label = F.when(e == "error", "Fire").when(e == "signup", "NO-helmet").otherwise("person")
    rows = view(spark, d, "sightings").select((F.col("user_id") % 5).alias("cam"), rules.alert_label(task, label).alias("alert"), "event_id", "t").where("alert is not null")
    return ev.rate_limit(rows, ["cam", "alert"], "t", "event_id", 3_600)


@query("select cam, start, max(people) people from (select image_id % 4 cam, image_id // 10 start, image_id, count(*) people from detections where class_id = 'plc' group by 1, 2, 3) group by 1, 2", "detections")
def r11_crowd(spark: SparkSession, d: str) -> DataFrame:
    frames = view(spark, d, "detections").where("class_id = 'plc'").groupBy("image_id").agg(F.count("*").alias("people"))
    timed = frames.select((F.col("image_id") % 4).alias("cam"), F.timestamp_seconds("image_id").alias("ts"), "people")
    out = rules.crowd(timed, "cam", "ts", "10 seconds")
    return out.select("cam", (F.unix_seconds("start") / 10).cast("long").alias("start"), "people")


@query("select det_id, case when score >= 0.5 then 'no_helmet' end alert from detections where class_id = 'mcb' and score >= 0.5", "detections")
def p15_alert_routing(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("score") >= 0.5, "no_helmet").otherwise("helmet")
    rows = view(spark, d, "detections").where("class_id = 'mcb'").withColumn("label", label).withColumn("a", rules.alert_label(F.lit("ppe"), F.col("label")))
    return rows.where("a is not null").select("det_id", F.col("label").alias("alert"))


@query("select user_id, cast(max(ts) as date) \"day\" from events group by 1")
def f24_local_day(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.groupBy("user_id").agg(F.to_date(F.timestamp_seconds(F.max("t"))).alias("day"))


def _stream(df: DataFrame, name: str) -> DataFrame:
    """A table as a stream: it is written once, and its files are read as they would come."""
    df.write.parquet(folder := scratch_path(df.sparkSession, name))
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _checkpoint(spark: SparkSession) -> str:
    return scratch_path(spark, "stream")


@query("select user_id, event_id, t from (select *, row_number() over (partition by user_id order by t desc, event_id desc) r from sightings where event_type = 'purchase') where r = 1", "sightings")
def s25_publish_subscribe(spark: SparkSession, d: str) -> DataFrame:
    """All sightings are published; a subscriber to one type keeps the last of each user."""
    rows = view(spark, d, "sightings").select("user_id", "event_type", "event_id", "t")
    log = logs.EventLog(spark, scratch_path(spark, "log"), rows.schema)
    logs.start(_stream(rows, "sightings"), log.sink("cameras"), _checkpoint(spark)).awaitTermination()
    table_ = logs.KeptTable(spark, scratch_path(spark, "kept"), rows.schema, ["user_id"], ["t", "event_id"])
    logs.start(log.subscribe(event_type="purchase"), table_.sink("purchases"), _checkpoint(spark)).awaitTermination()
    table_.compact()
    return table_.current().select("user_id", "event_id", "t")


@query("select user_id % 50 camera_id, count(*) events, max(t) last_seen, round(avg(value), 6) mean_latency, arg_max(event_type <> 'error', t * 100000000 + event_id) connected from sightings group by 1", "sightings")
def s26_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings").select((F.col("user_id") % 50).alias("camera_id"), "t", (F.col("t") * 100_000_000 + F.col("event_id")).alias("at"), "value", (F.col("event_type") != "error").alias("up"))
    log = logs.EventLog(spark, scratch_path(spark, "log"), "camera_id long, events long, last_seen long, mean_latency double, connected boolean")
    logs.heartbeat(_stream(rows, "status"), log, _checkpoint(spark), "camera_id", "at", "value", "up", every=None).awaitTermination()
    newest = logs.newest_frames(log.read(), "camera_id", "events", "last_seen")
    return newest.withColumns({"last_seen": F.floor(F.col("last_seen") / 100_000_000), "mean_latency": F.round("mean_latency", 6)})


@query("select user_id % 50 camera_id, arg_max(event_id, t * 100000000 + event_id) event_id, arg_max(value >= 10, t * 100000000 + event_id) alarm from sightings group by 1", "sightings")
def r1_worker(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "sightings").select((F.col("user_id") % 50).alias("camera_id"), "t", "event_id", "value")
    log = logs.EventLog(spark, scratch_path(spark, "log"), "camera_id long, event_id long, alarm boolean")
    step = lambda frames: frames.withColumn("alarm", F.col("value") >= 10)
    logs.worker(_stream(rows, "frames"), step, log, "worker", _checkpoint(spark), "camera_id", "t", "event_id", every=None).awaitTermination()
    return log.read()


FACE_EVENTS = f"""{FACES}, k as (select image_id % 4 camera, image_id t, det_id, case when status = 'known' then 'face_recognized' else 'unknown_person' end event, case when status = 'known' then \"identity\"::varchar else 'Unknown' end who from rec where status in ('known', 'unknown')),
o as (select *, row_number() over (partition by camera, event, who order by t, det_id) n from k),
walk as (select distinct camera, event, who, 0::bigint n, null::bigint last, false fire, null::bigint det_id from o union all select w.camera, w.event, w.who, o.n, case when w.last is null or o.t - w.last >= 30 then o.t else w.last end, w.last is null or o.t - w.last >= 30, o.det_id from walk w join o on o.camera = w.camera and o.event = w.event and o.who = w.who and o.n = w.n + 1)"""


@query(f"with {FACE_EVENTS} select camera, event, who, det_id from walk where fire", "detections", "vectors")
def r12_recognition_events(spark: SparkSession, d: str) -> DataFrame:
    """Faces that are recognised batch by batch, and a second stream that lets an event of a person through once in 30 seconds."""
    faces = materialize(d27_recognise(spark, d).select((F.col("image_id") % 4).alias("camera"), F.col("image_id").alias("t"), "det_id", "status", "identity"), "faces")
    log = logs.EventLog(spark, scratch_path(spark, "log"), faces.schema)
    logs.start(_stream(faces, "faces"), log.sink("recognition"), _checkpoint(spark)).awaitTermination()
    out = logs.EventLog(spark, scratch_path(spark, "log"), "camera long, event string, who string, det_id long")
    logs.start(rules.recognition_events(log.subscribe(), "camera", "t", "det_id", 30), out.sink("events"), _checkpoint(spark)).awaitTermination()
    return out.read()
