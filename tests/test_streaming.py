"""The streams keep what their batch twins keep, over several micro-batches and a restart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import events as batch
from sightline.operators import scorers, tracking
from sightline.streaming import rules
from sightline.views import view


@pytest.fixture(scope="module")
def sightings(spark, sf_dir):
    return view(spark, sf_dir, "sightings").select("user_id", "event_type", "event_id", "t", "value").where("user_id < 6")


def stream(spark, df, tmp_path, build, parts=3, order="t"):
    """Rows in time order in ``parts`` files, one micro-batch each; the query is stopped and started again after the first."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = df.toPandas().sort_values(order).reset_index(drop=True)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(src)
        if k in (0, parts - 1):
            source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
            q = build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
    return spark.read.parquet(out)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rate_limit(spark, sightings, tmp_path):
    got = stream(spark, sightings, tmp_path, lambda s: rules.rate_limit(s, ["event_type"], "t", "event_id", 7_200))
    assert rows(got, "event_type", "event_id") == rows(batch.rate_limit(sightings, ["event_type"], "t", "event_id", 7_200), "event_type", "event_id")


@pytest.mark.parametrize("timeout", [28_800, 43_200])
def test_attendance(spark, sightings, tmp_path, timeout):
    got = stream(spark, sightings, tmp_path, lambda s: rules.attendance(s, "user_id", "t", "event_id", timeout))
    assert rows(got, "user_id", "event_id") == rows(batch.attendance(sightings, "user_id", "t", "event_id", timeout), "user_id", "event_id")


def test_state_changes(spark, sightings, tmp_path):
    named = sightings.withColumn("state", F.when(F.col("value") >= 10, "up").otherwise("down"))
    got = stream(spark, named, tmp_path, lambda s: rules.state_changes(s, "user_id", "t", "event_id", "state"))
    assert rows(got, "event_id") == rows(batch.state_changes(named, ["user_id"], "t", "event_id", F.col("state")), "event_id")


def moving(spark, n=30):
    data = []
    for f in range(n):
        data += [("c1", "person", f, f * 10, 0.9, 10.0 + 5 * f, 10.0, 60.0 + 5 * f, 110.0), ("c1", "person", f, f * 10 + 1, 0.9 if f % 4 else 0.3, 500.0 - 5 * f, 10.0, 550.0 - 5 * f, 110.0), ("c2", "person", f, f * 10 + 2, 0.8, 10.0, 10.0, 60.0, 110.0)]
    return spark.createDataFrame(pd.DataFrame(data, columns=["camera_id", "label", "frame_no", "det_id", "score", "x1", "y1", "x2", "y2"]))


def test_tracks_keep_their_ids(spark, tmp_path):
    frames = moving(spark)
    out = tracking.track(frames).collect()
    ids = {(r["camera_id"], r["track_id"]) for r in out}
    assert ids == {("c1", 1), ("c1", 2), ("c2", 1)}
    left = [r for r in out if r["camera_id"] == "c1" and r["track_id"] == 1]
    assert [r["x1"] for r in sorted(left, key=lambda r: r["frame_no"])][:3] == [20.0, 25.0, 30.0]
    got = stream(spark, frames, tmp_path, rules.track, order="frame_no")
    cols = ["camera_id", "frame_no", "track_id", "x1"]
    assert rows(got, *cols) == sorted(tuple(r[c] for c in cols) for r in out)


def test_windows_and_latest(spark, sightings, tmp_path):
    timed = sightings.withColumn("ts", F.timestamp_seconds("t"))
    got = stream(spark, timed, tmp_path, lambda s: rules.windowed_rates(s, "user_id", "ts", "value", "1 hour", "1 hour"))
    want = timed.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    assert got.count() > 0 and set(rows(got, "user_id", "start", "n")) <= set(rows(want, "user_id", "start", "n"))
    last = {r["user_id"]: r["event_id"] for r in rules.latest(timed, "user_id", "ts", "event_id").collect()}
    rows_of = timed.toPandas()
    assert all(rows_of[(rows_of.user_id == u) & (rows_of.ts == rows_of[rows_of.user_id == u].ts.max())].event_id.max() == e for u, e in last.items())


def test_alert_labels(spark):
    data = [("ppe", "no_helmet"), ("ppe", "helmet"), ("fire", "Smoke"), ("fall", "person"), ("face", "x")]
    df = spark.createDataFrame(data, "task string, label string").withColumn("a", rules.alert_label(F.col("task"), F.col("label")))
    assert [r["a"] for r in df.collect()] == ["ppe_violation", None, "smoke_detected", "fall_detected", None]


def test_scorers(spark):
    def batch_fn(rows):
        if (rows["v"] < 0).any():
            raise ValueError("bad row")
        return pd.DataFrame({"id": rows["id"], "s": rows["v"] * 2.0})

    scorers.register_scorer("demo", "double", scorers.one_by_one_on_failure(batch_fn, "id", pd.DataFrame({"id": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})), "id long, s double")
    df = spark.createDataFrame([(1, 1), (2, -1), (3, 5)], "id long, v long").coalesce(1)
    assert rows(scorers.score(df, "demo", "double"), "id", "s") == [(1, 2.0), (3, 10.0)]
    assert scorers.scorers("demo") == [("demo", "double")]
    with pytest.raises(KeyError):
        scorers.score(df, "demo", "other")
    vec = df.select(scorers.embed(F.col("v"), lambda s: s.map(lambda x: [float(x), 1.0])).alias("e"))
    assert vec.first()["e"] == [1.0, 1.0]
