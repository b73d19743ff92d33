import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import events, tracking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute(rows, seconds, by_day):
    out, state = [], {}
    for key, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        last, day = state.get(key, (None, None))
        if last is None or t - last >= seconds:
            fire = not by_day or day != t // 86_400
            state[key] = (t, t // 86_400 if fire else day)
            out += [(key, i)] if fire else []
    return out


@pytest.mark.parametrize(("seconds", "by_day"), [(600, False), (43_200, True)])
def test_dense_keys_are_walked_in_batches(spark, small_batches, seconds, by_day):
    rng = np.random.default_rng(1)
    rows = [((None, "a", "b")[k % 3], k, int(t)) for k, t in enumerate(np.cumsum(rng.integers(0, 90 if not by_day else 9_000, 900)))]
    df = spark.createDataFrame(rows, "who string, i long, t long")
    out = events.attendance(df, "who", "t", "i", seconds) if by_day else events.rate_limit(df, ["who"], "t", "i", seconds)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rows, seconds, by_day), key=str)
    assert "collect_list" not in plan(out)


@pytest.mark.parametrize(("seconds", "by_day"), [(600, False), (43_200, True)])
def test_light_keys_are_walked_whole_and_busy_ones_in_pieces(spark, small_batches, monkeypatch, seconds, by_day):
    rng = np.random.default_rng(2)
    rows = [((None, "a", "b", "c")[3 if k % 31 == 0 else k % 3], k, int(t)) for k, t in enumerate(np.cumsum(rng.integers(0, 90 if not by_day else 9_000, 900)))]
    df = spark.createDataFrame(rows, "who string, i long, t long")
    walk = lambda: events.attendance(df, "who", "t", "i", seconds) if by_day else events.rate_limit(df, ["who"], "t", "i", seconds)
    want = sorted(brute(rows, seconds, by_day), key=str)
    out = walk()
    assert plan(out).count("MapInArrow") == 1 and sorted(map(tuple, out.collect()), key=str) == want
    monkeypatch.setattr(events, "BUSY", 100)
    monkeypatch.setattr(events, "POOLED", 5)
    out = walk()
    assert plan(out).count("MapInArrow") > 1 and sorted(map(tuple, out.collect()), key=str) == want


def test_tracks_are_carried_over_batches(spark, small_batches):
    rows = [(c, lab, f, 10 * f + d, 0.3 + 0.1 * (f % 6), 40.0 * d + f, 5.0, 40.0 * d + f + 30, 45.0) for c in ("x", "y") for lab in ("p", None) for f in range(25) if f % 9 for d in range(3)]
    names = ["camera_id", "label", "frame_no", "det_id", "score", "x1", "y1", "x2", "y2"]
    out = tracking.track(spark.createDataFrame(rows, "camera_id string, label string, frame_no long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"))
    want = []
    for key in {r[:2] for r in rows}:
        own = pd.DataFrame([r for r in rows if r[:2] == key], columns=names).sort_values(["frame_no", "det_id"])
        want += [(*key, *r) for r in tracking.Tracker().run(own).itertuples(index=False, name=None)]
    assert len(want) > 100 and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in plan(out)


@pytest.fixture
def small_pieces(monkeypatch):
    """A key's history in many pieces, some of one row."""
    from sightline.plans import pieces

    cut = pieces.cut
    monkeypatch.setattr(pieces, "cut", lambda rows, keys, order, n=None: cut(rows, keys, order, 23))
    return pieces


def history(n=400):
    rng = np.random.default_rng(3)
    return [(("a", "a", "a", None, "b")[k % 5], k, int(t) if k % 50 else None, float(rng.integers(0, 9)), ("up", "down", None)[rng.integers(0, 3)]) for k, t in enumerate(np.cumsum(rng.integers(0, 40, n)))]


def of_key(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))


def test_running_values_cross_pieces(spark, small_pieces):
    from pyspark.sql import functions as F

    from sightline.operators import reports

    rows = history()
    df = spark.createDataFrame(rows, "who string, i long, t long, v double, s string")
    changes, as_of, rolling = [], [], []
    for key in ("a", "b", None):
        own, n, last = of_key(rows, key), 0, None
        for k, r in enumerate(own):
            before = own[k - 1][4] if k else None
            if before is not None and r[4] is not None and before != r[4]:
                n += 1
                changes.append((r[1], n))
            as_of.append((r[1], last))
            last = r[1] if r[4] == "up" else last
            some = own[max(0, k - 6) : k + 1]
            times = [x[2] for x in some if x[2] is not None]
            rolling.append((r[1], len(some), max(times) - min(times) if times else None, round(sum(x[3] for x in some) / len(some), 9)))
    got = lambda out, *cols: sorted(map(tuple, out.select(*cols).collect()), key=str)
    assert got(events.state_changes(df, ["who"], "t", "i", F.col("s")), "i", "n_changes") == sorted(changes, key=str)
    assert got(reports.as_of(df, "who", "t", "i", F.col("s") == "up", "i"), "i", "as_of") == sorted(as_of, key=str)
    assert got(events.rolling_rates(df, ["who"], "t", "i", "v", 7), "i", "n", "span", F.round("mean", 9)) == sorted(rolling, key=str)
    assert small_pieces.cut(df, ["who"], ["t", "i"]).where("who = 'a'").select(small_pieces.PIECE).distinct().count() > 5


def test_carry_forward_crosses_pieces(spark, small_pieces):
    rows = [r for r in history() if r[0] and r[2] is not None]
    out = events.carry_forward(spark.createDataFrame(rows, "who string, i long, t long, v double, s string"), ["who"], "t", "i", 100)
    want = []
    for key in ("a", "b"):
        last = None
        for r in of_key(rows, key):
            if last is None or r[2] - last[2] >= 100:
                last = r
            want.append((key, r[1], last[1]))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_rows_dealt_by_panel_are_joined_where_they_lie(spark):
    """A join by panel and part deals nothing anew, and the setting is as before after it."""
    from sightline.plans.skew import joined_where_they_lie

    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before, rows = spark.conf.get(name), spark.range(1_000).selectExpr("id % 50 panel", "id")
    with joined_where_they_lie(spark):
        held = rows.repartition("panel").groupBy("panel", "id").agg(F.count("*").alias("n"))
        both = held.join(rows.repartition("panel").withColumn("m", F.col("id") + 1).hint("merge"), ["panel", "id"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(panel") == plan.count("Exchange ") == 2 and both.count() == 1_000
    assert spark.conf.get(name) == before
