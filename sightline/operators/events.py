"""Event, attendance and telemetry analytics on tables, and the greedy time rules that the streams share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.plans import pieces
from sightline.plans.lineage import materialize


def filter_equal(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that equal every value given; a null value sets no condition. Pushed down to the scan."""
    conds = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def recent(df: DataFrame, by: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first; ties by key, largest first."""
    return df.orderBy(F.desc(by), F.desc(key)).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both tables with one row for each key, the last by ``order``; a new row wins over an old one of equal order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__new")


def delete_cascade(parents: DataFrame, children: Mapping[str, tuple[DataFrame, str]], key: str, doomed: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the doomed rows, and each child table without rows of doomed parents."""
    gone = parents.where(doomed).select(F.col(key).alias("__k")).distinct()
    kept = {name: df.join(gone, df[fk] == F.col("__k"), "left_anti") for name, (df, fk) in children.items()}
    return parents.where(~F.coalesce(doomed, F.lit(False))), kept


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that only the partitions it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


#: Seconds in a piece of a key's history, at least so many times the interval.
PIECE, INTERVALS = 86_400, 16
#: Rows of a key from which on its history is cut into pieces; a task walks those of lighter keys whole.
BUSY = 65_536
#: Rows that go out of a task at a time.
POOLED = 10_000


def _chain(times: np.ndarray, seconds: int, at: int) -> list[int]:
    """Positions that count, from ``at`` on: each the first that is ``seconds`` or more after the one before."""
    out = []
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + seconds))
    return out


def _ends(times: np.ndarray, seconds: int) -> np.ndarray:
    """Time of the last that counts if each time in turn is the first that does."""
    after, out = np.searchsorted(times, times + seconds), times.copy()
    for k in range(len(times) - 1, -1, -1):
        if after[k] < len(times):
            out[k] = out[after[k]]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[pa.RecordBatch]]]:
    """(values of the first ``n`` columns, slices of rows) of each run of rows with equal values there."""
    key, held = None, []
    for part in batches:
        cols = [part.column(k).to_pylist() for k in range(n)]
        start = 0
        for at, own in enumerate(map(list, zip(*cols, strict=True))):
            if own != key:
                if held or at > start:
                    yield key, [*held, part.slice(start, at - start)]
                key, held, start = own, [], at
        held.append(part.slice(start))
    if held:
        yield key, held


def _pooled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: one for each key costs more than its rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= POOLED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _counted(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: int) -> DataFrame:
    """keys, __t, row_id: first row of every second of a key that counts under the interval.

    Keys of up to BUSY rows are walked whole, after one shuffle. The history of others is cut into pieces, so that a busy
    key is many tasks.
    """
    own = materialize(rows.where(F.col(time).isNotNull()).select(*keys, F.floor(F.col(time)).cast("long").alias("__t"), row_id), "times")
    busy = materialize(own.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > BUSY).select(*[F.col(c).alias(f"__b{k}") for k, c in enumerate(keys)]), "busy")
    if busy.isEmpty():
        return _walked_whole(own, keys, row_id, seconds)
    on = [own[c].eqNullSafe(busy[f"__b{k}"]) for k, c in enumerate(keys)]
    light = _walked_whole(own.join(busy, on, "left_anti"), keys, row_id, seconds)
    return light.unionByName(_walked_in_pieces(own.join(busy, on, "left_semi"), keys, row_id, seconds))


def _walked_whole(own: DataFrame, keys: Sequence[str], row_id: str, seconds: int) -> DataFrame:
    """``_counted`` of rows (keys, __t, row_id), a key at a time."""
    n = len(keys)
    dealt = own.repartition(*keys).sortWithinPartitions(*keys, "__t", F.asc_nulls_last(row_id))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches, n):
            whole = pa.concat_batches(parts)
            yield whole.take(pa.array(_chain(whole.column(n).to_numpy(), seconds, 0)))

    return dealt.mapInArrow(lambda batches: _pooled(each(batches)), own.schema)


def _walked_in_pieces(own: DataFrame, keys: Sequence[str], row_id: str, seconds: int) -> DataFrame:
    """``_counted`` of rows (keys, __t, row_id), each key's in pieces.

    Only distinct seconds matter, which bounds a piece. First each piece tells, for every second that may be its first to
    count, which is then its last; so the pieces of a key are chained with a row for each; then each piece is walked from
    where it is entered.
    """
    length, n = max(PIECE, INTERVALS * seconds), len(keys)
    fields = [own.schema[c] for c in [*keys, "__t", row_id]]
    own = own.groupBy(*keys, "__t").agg(F.min(row_id).alias(row_id))
    piece = F.floor(F.col("__t") / length).cast("long").alias("__p")
    times = materialize(own.select(*keys, piece, "__t", row_id), "times")
    by_piece = times.repartition(*keys, "__p").sortWithinPartitions(*keys, "__p", "__t")
    entries = T.StructType([*fields[:n], T.StructField("__p", T.LongType()), T.StructField("__from", T.LongType()), T.StructField("__to", T.LongType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _grouped(batches, n + 1):
            at = np.concatenate([p.column(n + 1).to_numpy() for p in parts])
            may = int(np.searchsorted(at, key[n] * length + seconds)) + 1  # the piece before holds it up no longer
            last = _ends(at, seconds)[:may]
            new = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))  # of those that end alike, the first and last
            keep = np.unique(np.concatenate([new, new[1:] - 1, [len(last) - 1]]))
            first = parts[0].slice(0, 1)
            same = [pa.concat_arrays([first.column(k)] * len(keep)) for k in range(n + 1)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at[keep]), pa.array(last[keep])], names=entries.names)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for key, parts in _grouped(batches, n + 1):
            if key[:n] != now:
                now, last = key[:n], None
            start = np.concatenate([p.column(n + 1).to_numpy() for p in parts])
            end = np.concatenate([p.column(n + 2).to_numpy() for p in parts])
            first = parts[0].slice(0, 1)
            least = None if last is None else last + seconds
            yield pa.RecordBatch.from_arrays([*(first.column(k) for k in range(n + 1)), pa.array([least], pa.int64())], names=[*entries.names[: n + 1], "__least"])
            at = 0 if least is None else int(np.searchsorted(start, least))
            if at < len(start):
                last = int(end[at])

    found = by_piece.mapInArrow(lambda batches: _pooled(ends(batches)), entries)
    chained = found.repartition(*keys).sortWithinPartitions(*keys, "__p", "__from")
    entered = chained.mapInArrow(lambda batches: _pooled(enter(batches)), T.StructType([*entries.fields[: n + 1], T.StructField("__least", T.LongType())]))
    entered = entered.select(*[F.col(c).alias(f"__e{k}") for k, c in enumerate(entries.names[: n + 1])], "__least")
    on = [times[c].eqNullSafe(entered[f"__e{k}"]) for k, c in enumerate([*keys, "__p"])]
    known = times.join(entered, on).select(*keys, "__p", "__t", row_id, "__least")
    walked = known.repartition(*keys, "__p").sortWithinPartitions(*keys, "__p", "__t")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches, n + 1):
            whole = pa.concat_batches(parts)
            at, least = whole.column(n + 1).to_numpy(), whole.column(n + 3)[0].as_py()
            kept = _chain(at, seconds, 0 if least is None else int(np.searchsorted(at, least)))
            if kept:
                yield whole.select([*range(n), n + 1, n + 2]).take(pa.array(kept))

    return walked.mapInArrow(lambda batches: _pooled(walk(batches)), T.StructType(fields))


def _greedy(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: float, by_day: bool) -> DataFrame:
    """keys and row_id of the rows that fire; rows without a time all do."""
    keys = list(keys)
    counted = _counted(rows, keys, time, row_id, int(seconds))
    if by_day:  # of what counts, the first of a day
        day = F.floor(F.col("__t") / 86_400).alias("__d")
        counted = counted.groupBy(*keys, day).agg(F.min_by(row_id, "__t").alias(row_id))
    return counted.select(*keys, row_id).unionByName(rows.where(F.col(time).isNull()).select(*keys, row_id))


def rate_limit(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: float) -> DataFrame:
    """keys and row_id of the rows that fire: the first of a key, then each at least ``seconds`` after the last that fired.

    Time is in whole seconds; an interval of 0 lets every row fire.
    """
    if seconds <= 0:
        return rows.select(*keys, row_id)
    return _greedy(rows, keys, time, row_id, seconds, False)


def attendance(rows: DataFrame, employee: str, time: str, row_id: str, timeout: int) -> DataFrame:
    """employee and row_id of sightings that are recorded: at most one per timeout, and per day (UTC) if that is 12 h or more.

    With timeout 0 every sighting is recorded. A sighting on a day already recorded restarts the interval.
    """
    if not timeout:
        return rows.select(employee, row_id)
    return _greedy(rows, [employee], time, row_id, timeout, timeout >= 43_200)


def state_changes(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, state: Column) -> DataFrame:
    """Rows where the state differs from the one before, with the running number of changes. A busy key is walked in pieces."""
    order = [time, row_id]
    own = pieces.cut(rows.withColumn("__s", F.struct(state.alias("s"))), keys, order)
    marked = pieces.running(own, keys, order, __p=pieces.last_known(F.col("__s"), order, before=True))
    changed = marked.withColumn("changed", F.coalesce(F.col("__p.s") != F.col("__s.s"), F.lit(False)))
    counted = pieces.running(changed, keys, order, n_changes=pieces.total(F.col("changed").cast("long")))
    return counted.where("changed").select(*rows.columns, "n_changes")


def carry_forward(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: float) -> DataFrame:
    """keys, row_id, result_of: the row whose result stands for each, itself if it is run: one is if the last that was is ``seconds`` older."""
    order = [time, row_id]
    fired = rate_limit(rows, keys, time, row_id, seconds).withColumn("__fired", F.lit(True))
    marked = pieces.cut(rows.join(fired, [*keys, row_id], "left").withColumn("__of", F.when(F.col("__fired"), F.col(row_id))), keys, order)
    return pieces.running(marked, keys, order, result_of=pieces.last_known(F.col("__of"), order)).select(*keys, row_id, "result_of")


def frame_rates(rows: DataFrame, keys: Sequence[str], time: str, latency: str) -> DataFrame:
    """keys, fps ((n - 1) / span), last, mean and greatest latency."""
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span"), F.max_by(latency, time).alias("last_latency"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency"))
    return agg.withColumn("fps", F.coalesce(F.try_divide(F.col("n") - 1, F.col("span")), F.lit(0.0))).drop("span")


def rolling_rates(rows: DataFrame, keys: Sequence[str], time: str, row_id: str, value: str, last: int = 60) -> DataFrame:
    """Adds n, span and mean of ``value`` over the last rows of each key. A busy key is cut into pieces that get the rows before them."""
    order = [time, row_id]
    both = pieces.with_rows_before(pieces.cut(rows, keys, order), keys, order, last - 1) if last > 1 else pieces.cut(rows, keys, order).withColumn("__own", F.lit(True))
    w = Window.partitionBy(*keys, pieces.PIECE).orderBy(*order).rowsBetween(1 - last, 0)
    both = both.withColumn("n", F.count("*").over(w)).withColumn("span", F.max(time).over(w) - F.min(time).over(w)).withColumn("mean", F.avg(value).over(w))
    return both.where("__own").select(*rows.columns, "n", "span", "mean")


def presence(rows: DataFrame, day: Column, who: str, days: int) -> DataFrame:
    """day, present (distinct), records of the latest days."""
    return rows.groupBy(day.alias("day")).agg(F.count_distinct(who).alias("present"), F.count("*").alias("records")).orderBy(F.desc("day")).limit(days)


def parse_tolerant(text: Column, schema: str) -> tuple[Column, Column]:
    """(parsed struct or null, the text where it can't be parsed): bad JSON never fails a query."""
    ok = text.rlike(r"^\s*[{\[].*[}\]]\s*$") & F.try_parse_json(text).isNotNull()
    return F.when(ok, F.from_json(text, schema)), F.when(~F.coalesce(ok, F.lit(False)), text)
