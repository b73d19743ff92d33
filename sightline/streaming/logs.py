"""Event logs that streams publish to and subscribe from, tables that streams keep, and the loops that run them.

A stream may stop at any point and start again from its checkpoint, when it hands its last batch over once more. So
batches are written once: under a name that tells the stream and the batch, in one step, and not again if they are there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sightline.operators.events import filter_equal

Sink = Callable[[DataFrame, int], None]


class EventLog:
    """Events in a folder that all executors share, a sub-folder for each batch of each publisher.

    Subscribers are streams of their own: each reads all events from the beginning, or goes on from its checkpoint, at its own pace.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def batches(self) -> list[str]:
        """Names of the batches that are complete."""
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))) if not n.startswith("_"))

    def publish(self, events: DataFrame, publisher: str, batch: int) -> None:
        """Write a batch, unless it is there; it shows at once and whole, by a rename (which is one step on file systems, not on object stores)."""
        name = f"{publisher}-{batch:012d}"
        if self._fs.exists(self._path(f"{self.folder}/{name}")):
            return
        staged = f"{self.folder}/_staged/{name}"
        events.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.mode("overwrite").parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(f"{self.folder}/{name}")):
            raise OSError(f"{staged} can't be renamed")

    def sink(self, publisher: str) -> Sink:
        return lambda events, batch: self.publish(events, publisher, batch)

    def read(self) -> DataFrame:
        """All events, as a table."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.folder)

    def subscribe(self, per_trigger: int | None = None, **wanted: object) -> DataFrame:
        """A stream of the events that equal the values given; at most so many files in a micro-batch."""
        source = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true")
        source = source.option("maxFilesPerTrigger", per_trigger) if per_trigger else source
        return filter_equal(source.parquet(self.folder), wanted)


class KeptTable:
    """The newest row of each key, of all that streams hand over: a log of changes on top of a base.

    ``keys`` name a row; ``order`` tells which is newer, of rows of equal order that of the later batch stays. A batch that
    comes again changes nothing, whether it is still in the log or already in the base.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], order: Sequence[str]):
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns, self.keys, self.order = given.names, list(keys), list(order)
        self.log = EventLog(spark, folder, T.StructType([*given.fields, T.StructField("__batch", T.LongType())]))

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = Window.partitionBy(*self.keys).orderBy(*map(F.desc, self.order), F.desc("__batch"))
        return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")

    def sink(self, publisher: str) -> Sink:
        return lambda rows, batch: self.log.publish(self._newest(rows.withColumn("__batch", F.lit(batch))), publisher, batch)

    def current(self) -> DataFrame:
        return self._newest(self.log.read()).select(*self.columns)

    def compact(self) -> None:
        """Merge all batches into a new base, then delete them: what a crash in between leaves twice counts once."""
        old = self.log.batches()
        n = 1 + max((int(name.rpartition("-")[2]) for name in old if name.startswith("base-")), default=-1)
        self.log.publish(self._newest(self.log.read()), "base", n)
        for name in old:
            self.log._fs.delete(self.log._path(f"{self.log.folder}/{name}"), True)


def start(stream: DataFrame, sink: Sink, checkpoint: str, every: float | None = None, mode: str = "append") -> StreamingQuery:
    """Hand the stream's micro-batches to ``sink``: every so many seconds, or, if that is not given, all that is there, and end."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{round(every * 1000)} milliseconds")).start()


def newest_frames(frames: DataFrame, camera: str, time: str, row_id: str) -> DataFrame:
    """The newest row of each camera."""
    rest = [c for c in frames.columns if c != camera]
    return frames.groupBy(camera).agg(F.max_by(F.struct(*rest), F.struct(time, row_id)).alias("__f")).select(camera, "__f.*")


def worker(frames: DataFrame, step: Callable[[DataFrame], DataFrame], log: EventLog, name: str, checkpoint: str, camera: str, time: str, row_id: str, every: float | None = 0.25) -> StreamingQuery:
    """Run ``step`` on the newest frame of each camera in turn, and publish what it finds; frames that came in between are passed over."""
    publish = log.sink(name)
    return start(frames, lambda batch, n: publish(step(newest_frames(batch, camera, time, row_id)), n), checkpoint, every)


def telemetry(status: DataFrame, camera: str, time: str, latency: str, up: str) -> DataFrame:
    """camera, events, last_seen, mean_latency, connected (as last seen): a stats event of each camera that has news; for update mode."""
    last = F.max_by(F.col(up), F.col(time))
    return status.groupBy(camera).agg(F.count("*").alias("events"), F.max(time).alias("last_seen"), F.avg(latency).alias("mean_latency"), last.alias("connected"))


def heartbeat(status: DataFrame, log: EventLog, checkpoint: str, camera: str, time: str, latency: str, up: str, every: float | None = 5.0) -> StreamingQuery:
    """Publish ``telemetry`` every so many seconds."""
    return start(telemetry(status, camera, time, latency, up), log.sink("stats"), checkpoint, every, "update")
