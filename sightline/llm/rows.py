"""Shared row handling: texts come in as Arrow batches, results go out as Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their texts, handled at once inside a task; bounds a worker's memory whatever the Arrow batch size is.
SLICE, SLICE_BYTES = 1024, 1 << 20

Batches = Iterator[pa.RecordBatch]


def text_input(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id long, text string without nulls, more...): every other column is pruned, so clashing names do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


#: Bits of a map that tells which rows a join may find something for; it has 16 MB at most.
MAP_BITS = 27


def may_match(rows: DataFrame, of: DataFrame, h: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where no row of ``of`` has the same long ``h``.

    A map of MAP_BITS bits is broadcast; where ``of`` has very many rows it lets more pass, and loses none.
    """
    at = F.pmod(h, F.lit(1 << MAP_BITS)) + 1
    marks = of.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    told = rows.withColumn("__word", F.bitmap_bucket_number(at)).withColumn("__bit", F.bitmap_bit_position(at).cast("int")).join(F.broadcast(marks), "__word", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("__bit").bitwiseAND(7)).bitwiseAND(1)
    return told.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__word", "__bit", "__bits")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Batches) -> Batches:
    """At most SLICE rows at a time, and at most SLICE_BYTES of their texts but where one row has more."""
    for batch in batches:
        upto = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, at + 1), at + SLICE, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send texts to Python in batches of at most SLICE rows and 8 MB: an executor holds each batch on both sides, for every task."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": SLICE, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
    before = {name: spark.conf.get(name) for name in names}
    for name, most in names.items():
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def release() -> None:
    """Give freed memory back to the system: workers go on to tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def ending(run: Callable[[Batches], Batches], done: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow; at a task's end ``done`` forgets what the task has remembered, and memory goes back."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        if done:
            done()
        release()

    return whole


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow where ``fn`` turns a slice of rows into a dict of column name to list or array; ``done`` runs at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Batches) -> Batches:
        for part in slices(batches):
            if part.num_rows:
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(ending(run, done), schema)
