"""Joins that no single key can hold up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it has this share of all rows: 1 / HOT. So at most HOT keys are.
HOT = 1_000


def join_counted(rows: DataFrame, of: DataFrame, key: str, total: int | None = None, hot: int = HOT) -> DataFrame:
    """``rows`` inner-joined to ``of`` (key, rows, ...), one row a key, where its column ``rows`` counts the key's rows.

    Hot keys, at most ``hot`` of them whatever the table's size, are broadcast; the others meet by a shuffle in which each
    has less than that share of all rows. ``total`` is the number of all rows, if it is known.
    """
    total = total if total is not None else of.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * hot >= total
    marked = rows.join(F.broadcast(of.where(often)), key, "left")
    others = marked.where("rows is null").select(*rows.columns).join(of.where(~often), key)
    return marked.where("rows is not null").select(*others.columns).union(others)


@contextmanager
def joined_where_they_lie(spark: SparkSession) -> Iterator[None]:
    """Jobs inside join rows that are dealt by a part of the join's keys, such as a panel of many, without dealing them anew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def draw(seed: int, row_id: str) -> Column:
    """A hash that orders rows by chance, the same in any engine with MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string")))


def running(rows: DataFrame, by: Sequence[str], seed: int, row_id: str, weight: str | None = None) -> DataFrame:
    """Adds before and total: the weights (1 if none is named) of the rows of the same ``by`` that ``draw`` puts before this one, and of all.

    Sums are taken within 4,096 ranges of the hash, and over the ranges, so no task orders all rows of a key. Rows
    whose ``by`` is null are one key.
    """
    keys = [f"__k{n}" for n in range(len(by))]
    own = rows.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, by, strict=True)})
    own = own.withColumn("__h", draw(seed, row_id)).withColumn("__r", F.substring("__h", 1, 3)).withColumn("__w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    sums = own.groupBy(*keys, "__r").agg(F.sum("__w").alias("__sum"))
    ranges = Window.partitionBy(*keys)
    upto = ranges.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__r", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__o"), F.sum("__sum").over(ranges).alias("total"))
    inside = Window.partitionBy(*keys, "__r").orderBy("__h", row_id).rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumn("__i", F.coalesce(F.sum("__w").over(inside), F.lit(0))).join(sums, [*keys, "__r"])
    return out.select(*rows.columns, (F.col("__o") + F.col("__i")).alias("before"), "total")
