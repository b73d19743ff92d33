import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import line_dedup
from tests.llm.conftest import EDGE, passage

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least, least_chars=1):
    held = {}
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(n)
    gone = {k for k, docs in held.items() if len(k) >= least_chars and len(docs) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    pool = [passage(k, 6) for k in range(12)] + ["", "  ", "É ", "é ", "Licence  MIT", "licence  mit ", "\tLICENCE  MIT\r", "x"]
    return [(rng.choice([n, n, None]), "\n".join(rng.choice(pool[: 1 + rng.randrange(20)]) for _ in range(rng.randrange(0, 9)))) for n in range(n)]


def got(df):
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("least", "least_chars", "batches"), [(1, 1, 1), (2, 1, 3), (5, 2, 8), (9, 0, 5)])
def test_equals_plain(frame, least, least_chars, batches):
    rows = texts(least, 60) + EDGE + [(1, None)] * 3 + [(2, passage(5, 6))] * 3
    df = frame(rows).repartition(7)
    assert got(line_dedup.drop_repeated(df, least, least_chars, batches, fanout=2)) == plain(rows, least, least_chars)


def test_empty_table(none):
    assert got(line_dedup.drop_repeated(none)) == []


def test_one_long_text_of_one_line_repeated(frame):
    rows = [(k, "\n".join(["Same line"] * 30_000 + [f"own {k}"])) for k in range(3)]
    assert got(line_dedup.drop_repeated(frame(rows), 3)) == plain(rows, 3)
    assert got(line_dedup.drop_repeated(frame(rows), 4)) == plain(rows, 4)


def test_runs_hold_counts_in_levels_and_open_again(spark, frame, tmp_path):
    """Batches come one by one; the store is opened anew after each, a batch that it holds is skipped, and runs are merged."""
    rows = texts(3, 90)
    lines = line_dedup.line_keys(frame(rows))
    batch = F.pmod("r1", F.lit(9))
    for k in range(9):
        runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), least=4, fanout=3, buckets=4)
        runs.add(lines.where(batch == k), k)
        runs.add(lines.where(batch == k), k)
        runs.close()
    assert runs.runs == [(0, 8)]
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), least=4, fanout=3)
    assert runs.buckets == 4
    want = lines.where("first").groupBy("h1", "h2").count().where("count >= 4")
    assert sorted(runs.repeated().collect()) == sorted(want.select("h1", "h2").collect())
    runs.close()


def test_a_run_holds_new_keys_only_where_one_document_settles_them(spark, frame, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), least=1, buckets=4)
    runs.add(line_dedup.line_keys(frame([(1, "a\nb"), (2, "b\nc")])))
    runs.add(line_dedup.line_keys(frame([(3, "c\nd\nd"), (4, "A ")])))
    assert [runs._table(r).count() for r in runs.runs] == [3, 1]
    plan = runs.unsettled(line_dedup.line_keys(frame([(5, "e")])).groupBy("h1", "h2").agg(F.count("*").alias("docs")))._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1  # of counting the batch: no run moves
