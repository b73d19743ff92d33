"""Running values of busy keys: a key's rows are cut into pieces in their order, so that no window spans a key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.plans.lineage import materialize

PIECE = "__piece"


class Running(NamedTuple):
    """A running value: of the rows of a piece up to one (or before it), of a whole piece, over the pieces before, and of both."""

    of_row: Column
    before: bool
    of_piece: Column
    over: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def total(value: Column) -> Running:
    """The sum up to a row, itself included."""
    return Running(F.sum(value), False, F.sum(value), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def last_known(value: Column, order: Sequence[str], before: bool = False) -> Running:
    """The last value that is not null, up to a row or before it."""
    last = lambda c: F.last(c, ignorenulls=True)
    place = F.when(value.isNotNull(), F.struct(*order))
    return Running(last(value), before, F.max_by(value, place), last, F.coalesce)


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of keys and order, with the range as their piece: a written table; ``n`` ranges, by default as many as Spark sees fit."""
    ranged = rows.repartitionByRange(n, *keys, *order) if n else rows.repartitionByRange(*keys, *order)
    return materialize(ranged.withColumn(PIECE, F.spark_partition_id()), "pieces")


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names])


def running(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Running) -> DataFrame:
    """``pieces`` (``cut``) with running values of each key in order; a task has a piece of a key, or a row for each of its pieces."""
    by = [*keys, PIECE]
    frames = {False: (Window.unboundedPreceding, 0), True: (Window.unboundedPreceding, -1)}
    inside = {b: Window.partitionBy(*by).orderBy(*order).rowsBetween(*f) for b, f in frames.items()}
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(*frames[True])
    whole = pieces.groupBy(*by).agg(*(v.of_piece.alias(f"__{n}") for n, v in values.items()))
    whole = whole.select(*by, *(v.over(F.col(f"__{n}")).over(before).alias(f"__{n}") for n, v in values.items()))
    own = pieces.withColumns({n: v.of_row.over(inside[v.before]) for n, v in values.items()})
    met = own.alias("own").join(whole.alias("whole"), _same("own", "whole", by))
    return met.select(*(F.col(f"own.{c}") for c in pieces.columns), *(v.both(F.col(f"own.{n}"), F.col(f"whole.__{n}")).alias(n) for n, v in values.items()))


def with_rows_before(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``pieces`` and, in each, copies of the ``n`` rows of its key before it, told by __own = false.

    They come from the piece before, or from several where pieces are small; each piece gives ``n`` rows at most.
    """
    by = [*keys, PIECE]
    counts = pieces.groupBy(*by).agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*keys).orderBy(PIECE)
    counts = counts.withColumn("__upto", F.sum("__n").over(along)).withColumn("__at", F.col("__upto") - F.col("__n")).withColumn("__nth", F.row_number().over(along))
    near = Window.partitionBy(*keys).orderBy("__at").rangeBetween(0, n - 1)
    counts = counts.withColumn("__far", F.max("__nth").over(near))  # the last piece that begins within n rows of this one's first
    counts = counts.withColumn("__next", F.lead("__far").over(along)).withColumn("__begins", F.lead("__at").over(along))
    places = counts.select(*keys, F.col("__nth").alias("__to"), F.col(PIECE).alias("__target"), F.col("__at").alias("__start"))
    gives = counts.where("__next is not null").select(*by, "__begins", F.explode(F.sequence(F.col("__nth") + 1, F.col("__next"))).alias("__to"))
    gives = gives.alias("g").join(places.alias("p"), _same("g", "p", [*keys, "__to"])).select(*(F.col(f"g.{c}") for c in by), F.col("p.__target").alias("__target"), (F.col("p.__start") - F.col("g.__begins")).alias("__between"))
    back = Window.partitionBy(*by).orderBy(*map(F.desc, order))
    tails = pieces.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n)
    copies = tails.alias("t").join(gives.alias("g"), _same("t", "g", by)).where(F.col("t.__back") + F.col("g.__between") <= n)
    copies = copies.select(*(F.col("g.__target").alias(PIECE) if c == PIECE else F.col(f"t.{c}") for c in pieces.columns), F.lit(False).alias("__own"))
    return pieces.withColumn("__own", F.lit(True)).unionByName(copies)
