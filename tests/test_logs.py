"""Publishing, subscribing, kept tables and chained streams, over failures and restarts."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import events as ev
from sightline.streaming import logs, rules

SCHEMA = "cam long, kind string, t long, n long"


@pytest.fixture
def source(spark, tmp_path):
    """A folder to which rows are added, a file each time."""
    folder = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    return add


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def parts(n=4, each=25):
    return [[(k % 3, "ab"[k % 2], 10 * k, k) for k in range(p * each, (p + 1) * each)] for p in range(n)]


def test_a_failed_batch_leaves_no_double_row(spark, source, tmp_path):
    log = logs.EventLog(spark, str(tmp_path / "log"), SCHEMA)
    data, failed = parts(), []

    def failing(rows, batch):
        log.publish(rows, "cams", batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise OSError("lost after the batch was written, before that was noted")

    for part in data:
        stream = source(part)
    query = logs.start(stream, failing, str(tmp_path / "ck"))
    with pytest.raises(Exception, match="lost after"):
        query.awaitTermination(120)
    assert failed and len(log.batches()) == 2
    logs.start(stream, failing, str(tmp_path / "ck")).awaitTermination(120)
    assert rows_of(log.read()) == sorted(r for p in data for r in p)
    # a subscriber that begins late still gets all, and one that goes on gets what is new
    seen = []
    take = lambda rows, batch: seen.extend(map(tuple, rows.collect()))
    logs.start(log.subscribe(per_trigger=1, kind="a"), take, str(tmp_path / "sub")).awaitTermination(120)
    assert sorted(seen) == sorted(r for p in data for r in p if r[1] == "a")
    seen.clear()
    more = [(7, "a", 5_000, 900), (7, "b", 5_001, 901)]
    logs.start(source(more), failing, str(tmp_path / "ck")).awaitTermination(120)
    logs.start(log.subscribe(per_trigger=1, kind="a"), take, str(tmp_path / "sub")).awaitTermination(120)
    assert seen == more[:1]


def test_a_half_written_batch_is_not_seen(spark, tmp_path):
    log = logs.EventLog(spark, str(tmp_path / "log"), SCHEMA)
    log.publish(spark.createDataFrame([(1, "a", 2, 3)], SCHEMA), "x", 0)
    spark.createDataFrame([(9, "z", 9, 9)], SCHEMA).write.parquet(str(tmp_path / "log/_staged/x-000000000001"))
    assert rows_of(log.read()) == [(1, "a", 2, 3)] and log.batches() == ["x-000000000000"]
    log.publish(spark.createDataFrame([(5, "b", 5, 5)], SCHEMA), "x", 1)
    log.publish(spark.createDataFrame([(6, "b", 6, 6)], SCHEMA), "x", 1)  # comes again: not written again
    assert rows_of(log.read()) == [(1, "a", 2, 3), (5, "b", 5, 5)]


def test_kept_table_equals_upserts_whatever_is_replayed_or_compacted(spark, tmp_path):
    table = logs.KeptTable(spark, str(tmp_path / "kept"), SCHEMA, ["cam"], ["t"])
    sink, want = table.sink("cams"), spark.createDataFrame([], SCHEMA)
    batches = [[(k % 7, "abc"[n % 3], 100 - 10 * n if k == 3 else 10 * n + k % 2, 100 * n + k) for k in range(n, n + 4)] for n in range(6)]
    batches[4].append((2, "tie", max(r[2] for b in batches[:4] for r in b if r[0] == 2), -1))  # of equal order the later batch stays
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        sink(df, n)
        sink(df, n)
        want = spark.createDataFrame(ev.upsert(want, df, ["cam"], ["t"]).collect(), SCHEMA)
        if n in (1, 4):
            table.compact()
            sink(df, n)  # its folder has gone into the base: written again, it changes nothing
        assert rows_of(table.current()) == rows_of(want)
    table.compact()
    assert rows_of(table.current()) == rows_of(want) and len(table.log.batches()) == 1


def test_worker_takes_the_newest_frame_of_each_camera(spark, source, tmp_path):
    log = logs.EventLog(spark, str(tmp_path / "log"), "cam long, n long, twice long")
    data = parts(3)
    for part in data:
        stream = source(part)
    logs.worker(stream, lambda f: f.withColumn("twice", 2 * F.col("n")), log, "worker", str(tmp_path / "ck"), "cam", "t", "n", every=None).awaitTermination(120)
    want = [max((r for r in p if r[0] == c), key=lambda r: r[2]) for p in data for c in range(3)]
    assert rows_of(log.read()) == sorted((r[0], r[3], 2 * r[3]) for r in want)


def test_worker_and_heartbeat_run_on_their_clock(spark, source, tmp_path):
    stream = source(parts(1)[0])
    log = logs.EventLog(spark, str(tmp_path / "log"), "cam long, events long, last_seen long, mean_latency double, connected boolean")
    query = logs.heartbeat(stream.withColumn("up", F.col("kind") == "a"), log, str(tmp_path / "ck"), "cam", "t", "n", "up", every=0.25)
    query.processAllAvailable()
    source([(0, "b", 9_999, 50)])
    query.processAllAvailable()
    query.stop()
    out = {r["events"]: r for r in log.read().where("cam = 0").collect()}
    first = [r for r in parts(1)[0] if r[0] == 0]
    assert set(out) == {len(first), len(first) + 1}
    assert out[len(first) + 1]["last_seen"] == 9_999 and not out[len(first) + 1]["connected"]
    assert log.read().where("cam = 1").count() == 1  # no news, no event


def faces(n=300):
    return [(k % 3, ["known", "unknown", "low_quality"][k // 3 % 3], 1_000 + 4 * k + k % 3, k) for k in range(n)]


def test_recognition_events_equal_the_batch_rule_and_forget(spark, tmp_path):
    folder, log = str(tmp_path / "in"), logs.EventLog(spark, str(tmp_path / "log"), "cam long, event string, who string, t long, n long")
    rows = [(*f, f"p{f[3] % 4 if f[3] < 150 else 9}") for f in faces()]
    schema = "cam long, status string, t long, n long, identity string"
    gallery = spark.createDataFrame([("p0", "anna"), ("p1", "ben"), ("p2", "cleo"), ("p3", "dov"), ("p9", "eve")], "identity string, name string")
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        matched = stream.join(F.broadcast(gallery), "identity").drop("identity").withColumnRenamed("name", "identity")
        query = logs.start(rules.recognition_events(matched, "cam", "t", "n", 60, "10 seconds"), log.sink("faces"), str(tmp_path / "ck"))
        query.awaitTermination(120)
    named = spark.createDataFrame(rows, schema).join(gallery, "identity").withColumn("who", F.when(F.col("status") == "known", F.col("name")).when(F.col("status") == "unknown", "Unknown")).where("who is not null")
    want = ev.rate_limit(named, ["cam", "who"], "t", "n", 60)
    got = log.read()
    assert rows_of(got.select("cam", "who", "n")) == rows_of(want.select("cam", "who", "n")) and got.count() > 20
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert state <= 6 < got.select("cam", "event", "who").distinct().count()  # two keys a camera are left


def test_carry_forward_equals_the_rule(spark, source, tmp_path):
    log = logs.EventLog(spark, str(tmp_path / "log"), "cam long, t long, n long, result_of long")
    data = parts(3)
    for part in data:
        stream = source(part)
    logs.start(rules.carry_forward(stream, "cam", "t", "n", 70), log.sink("x"), str(tmp_path / "ck")).awaitTermination(120)
    want, last = [], {}
    for cam, _, t, n in sorted((r for p in data for r in p), key=lambda r: r[2]):
        if cam not in last or t - last[cam][0] >= 70:
            last[cam] = (t, n)
        want.append((cam, t, n, last[cam][1]))
    assert rows_of(log.read()) == sorted(want)
