"""Lines that many documents hold, found with levelled sorted runs of line hashes and dropped everywhere.

A run is a table of hashes (h1, h2, docs), dealt into buckets by hash and sorted within: runs of one store meet, and meet
a new batch, by merge joins in which no run moves. A batch anti-joins the runs for the keys that they already hold in
enough documents, and adds the others as a run of its own; as soon as ``fanout`` runs of one level have gathered they are
compacted into one of the next level. Everything is written with DataFrame functions.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.rows import may_match, text_input
from sightline.plans.lineage import materialize, scratch_path

#: ASCII white space, and letters that are lower-cased.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY, ROW = ["h1", "h2"], ["r1", "r2"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and 128 bits (r1, r2) of both; equal rows have equal bits and lose the same lines."""
    rows = text_input(docs, id_col, text_col)
    return rows.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "doc_id", "text")})


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """r1, r2, pos, h1, h2, first: a row for each line whose key has ``least_chars`` code points or more.

    (h1, h2) are 128 bits of the key: the line without ASCII white space at its ends, A-Z lower-cased. ``first`` marks one
    line of each key in a document.
    """
    keys = F.transform(_split(F.translate("text", UPPER, UPPER.lower())), lambda x: F.trim(x, F.lit(SPACE)))
    keyed = F.transform(keys, lambda k, at: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), at.alias("pos"), F.length(k).alias("n")))
    rows = _rows(docs, id_col, text_col).select(*ROW, F.sort_array(F.filter(keyed, lambda s: s["n"] >= least_chars)).alias("keyed"))
    new = lambda s, before: F.coalesce((s["h1"] != before["h1"]) | (s["h2"] != before["h2"]), F.lit(True))
    flagged = F.transform("keyed", lambda s, at: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), s["pos"].alias("pos"), new(s, F.get("keyed", at - 1)).alias("first")))
    return rows.select(*ROW, F.inline(flagged))


class LineRuns:
    """Levelled sorted runs in a folder that all executors share.

    A run covers the batches from one number to another, which its name tells: ``run-<first>-<last>``. Of runs that
    overlap the longest counts, so a store may be opened again after a failure at any point, and a batch that it holds is
    not added twice. ``least`` is the number of documents from which a key is settled: later batches leave it out, so its
    count may stay lower than the truth, but never falls below ``least``. With ``least`` 1 a run holds new keys only.
    """

    def __init__(self, spark: SparkSession, folder: str, least: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.folder, self.least, self.fanout = spark, folder.rstrip("/"), least, fanout
        self.names: dict[tuple[int, int], str] = {}
        held = self._stored()
        self.buckets = next(iter(held.values()), None) or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (first, last) batch of each live run, in order.
        self.runs = [r for r in sorted(held) if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in held)]

    def _stored(self) -> dict[tuple[int, int], int]:
        """Complete runs in the folder, and their number of buckets."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = {}
        for status in fs.listStatus(at) if fs.exists(at) else []:
            found = re.fullmatch(r"run-(\d+)-(\d+)-of-(\d+)", status.getPath().getName())
            if found and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[int(found[1]), int(found[2])] = int(found[3])
        return out

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{run[0]}-{run[1]}-of-{self.buckets}"

    def _table(self, run: tuple[int, int]) -> DataFrame:
        if run not in self.names:  # of an earlier session
            self.names[run] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self.names[run]} (h1 bigint, h2 bigint, docs bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self._path(run)}'")
        return self.spark.table(self.names[run])

    def _write(self, run: tuple[int, int], keys: DataFrame) -> None:
        self.names[run] = f"line_run_{uuid.uuid4().hex}"
        keys.select(*KEY, "docs").write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self._path(run)).saveAsTable(self.names[run])

    def _merge(self, run: tuple[int, int], other: tuple[int, int]) -> tuple[int, int]:
        """One run of two neighbours: a merge join adds up their counts where they lie."""
        a, b = self._table(run).alias("a"), self._table(other).alias("b").hint("merge")
        either = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY]
        docs = F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))
        both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        self._write((run[0], other[1]), both.select(*either, docs.alias("docs")))
        return run[0], other[1]

    def _merge_last(self, n: int) -> None:
        while n > 1:
            self.runs[-n : 2 - n or None] = [self._merge(*self.runs[-n : 2 - n or None])]
            n -= 1

    def repeated(self) -> DataFrame:
        """h1, h2: the keys that ``least`` documents or more hold; merges all runs into one."""
        self._merge_last(len(self.runs))
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._table(self.runs[0]).where(F.col("docs") >= self.least).select(*KEY)

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """The rows of ``counted`` (h1, h2, docs) whose keys no run holds in ``least`` documents: merge anti-joins of the runs."""
        for run in self.runs:
            known = self._table(run).where(F.col("docs") >= self.least).select(*KEY, F.lit(True).alias("known"))
            # an outer join, as Spark would do an anti-join before keys are counted
            counted = counted.join(known.hint("merge"), KEY, "left").where("known is null").drop("known")
        return counted

    def add(self, lines: DataFrame, batch: int | None = None) -> None:
        """Add the lines (``line_keys``) of a batch as a run, without the settled keys; a batch that is held is skipped."""
        last = self.runs[-1][1] if self.runs else -1
        batch = last + 1 if batch is None else batch
        if batch <= last:
            return
        counted = lines.where("first").groupBy(*KEY).agg(F.count("*").alias("docs"))
        bucket = F.pmod(F.hash(*KEY), F.lit(self.buckets))
        self._write((last + 1, batch), self.unsettled(counted).repartitionById(self.buckets, bucket))
        self.runs.append((last + 1, batch))
        self._compact()

    def _compact(self) -> None:
        """Merge the last runs while ``fanout`` of them cover equally many batches."""
        while len(self.runs) >= self.fanout and len({last - first for first, last in self.runs[-self.fanout :]}) == 1:
            self._merge_last(self.fanout)

    def close(self) -> None:
        """Forget the tables' names; the runs stay in their folder."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        self.names.clear()


def without(docs: DataFrame, lines: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: the documents without the lines whose keys are in ``repeated`` (h1, h2).

    ``lines`` are the documents' ``line_keys``. Only their hashes meet the keys; only the texts of documents that lose a
    line are shuffled, as a map of bounded size tells apart.
    """
    gone = materialize(lines.join(repeated, KEY).groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    told = may_match(_rows(docs, id_col, text_col), gone, "r1", "loses")
    whole = told.where("not loses").select("doc_id", F.size(_split(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    met = told.where("loses").select("doc_id", "text", *ROW).join(gone, ROW, "left")
    met = met.select("doc_id", _split(F.col("text")).alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    ends = met.withColumn("ends", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("all"))))
    # the stretches between dropped lines, joined again
    stretch = lambda k: F.slice("all", F.get("ends", k) + 2, F.get("ends", k + 1) - F.get("ends", k) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), stretch)), "\n")
    cut = ends.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))
    return whole.unionByName(cut)


def drop_repeated(docs: DataFrame, least: int = 10, least_chars: int = 1, batches: int = 8, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept (the text without its repeated lines); one row per input row.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code points or
    more that ``least`` documents or more hold lose all their lines in every document; the others are joined by line
    feeds. The table's partitions are dealt to ``batches`` that are added to the runs in turn; results don't depend on
    how.

    A null or empty text is one empty line. Rows count as documents whatever their id: repeated rows count each and lose
    the same lines, null ids stay; texts of any length are read whole, other columns are not read, an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    lines = line_keys(docs, least_chars, id_col, text_col).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches)))
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, scratch_path(spark, "runs"), least, fanout)
    for row in lines.select("batch").distinct().orderBy("batch").collect():  # at most ``batches`` of them
        runs.add(lines.where(F.col("batch") == row["batch"]))
    repeated = materialize(runs.repeated(), "repeated")
    runs.close()
    return without(docs, lines, repeated, id_col, text_col)
