"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.rows import arrow_map, ending, fresh, row_key, slices, small_batches, text_input
from sightline.plans.lineage import materialize

#: Hash buckets of the two generative models: their size is fixed, whatever the corpus has.
BUCKETS = 1 << 16
WORD = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def forget() -> None:
    """Workers go on to other tasks, and other operators; they keep no words."""
    _words.clear()


def buckets(text: str) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words; words are runs of word or of other characters, lower-cased."""
    own = WORD.findall(text.lower())
    h = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    pairs = (h[:-1] * _ODD + h[1:]) * _ODD
    return (np.concatenate([h, pairs]) >> np.uint64(48)).astype(np.int64)


@dataclass(frozen=True)
class Ratio:
    """Log ratio of target to raw probability by bucket."""

    log_ratio: np.ndarray

    def weight(self, text: str) -> float:
        """Log importance weight: the sum of the log ratios of the text's n-grams."""
        return float(self.log_ratio[buckets(text)].sum())


def _counts(docs: DataFrame, flags: dict[str, F.Column], id_col: str, text_col: str) -> dict[str, np.ndarray]:
    """Bucket counts of all rows, and of those where each flag holds; summed in each task, then by bucket."""
    names = ["raw", *flags]
    rows = text_input(docs, id_col, text_col, *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), dtype=np.int64)
        for part in slices(batches):
            on = [part.column(k).to_pylist() for k in names[1:]]
            for i, text in enumerate(part.column("text")):
                own = np.bincount(buckets(text.as_py()), minlength=BUCKETS)
                total[0] += own
                for k, flag in enumerate(on):
                    if flag[i]:
                        total[k + 1] += own
        for k, name in enumerate(names):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[k][at])], names=["model", "bucket", "n"])

    summed = rows.mapInArrow(ending(run, forget), "model string, bucket long, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(BUCKETS, dtype=np.int64) for k in names}
    for r in summed.toLocalIterator():  # at most BUCKETS rows for each model
        out[r["model"]][r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, is_target: F.Column, id_col: str = "doc_id", text_col: str = "text", smooth: float = 1.0) -> Ratio:
    """Models of target texts (where ``is_target`` holds) and of all texts; counts cover every row. Without target text nothing is told apart."""
    n = _counts(docs, {"target": is_target}, id_col, text_col)
    if not n["target"].sum():
        return Ratio(np.zeros(BUCKETS))
    p = {k: np.log((v + smooth) / (v.sum() + smooth * BUCKETS)) for k, v in n.items()}
    return Ratio(p["target"] - p["raw"])


def weights(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text", *more: F.Column) -> DataFrame:
    """doc_id, log_weight, and the given columns; a text without n-grams weighs 0."""
    rows = text_input(docs, id_col, text_col, *more)
    schema = ", ".join(["doc_id long", "log_weight double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])])
    kept = rows.columns[2:]
    shared = docs.sparkSession.sparkContext.broadcast(ratio.log_ratio)

    def run(part: pa.RecordBatch) -> dict:
        weight = [float(shared.value[buckets(t.as_py())].sum()) for t in part.column("text")]
        return {"doc_id": part.column("doc_id"), "log_weight": weight, **{k: part.column(k) for k in kept}}

    return arrow_map(rows, schema, run, forget)


def gumbel(key: F.Column, seed: int) -> F.Column:
    """A Gumbel draw that only depends on the row's key and the seed."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(scored: DataFrame, column: str, k: int, bins: int = 4_096) -> float | None:
    """The k-th largest value, exactly; None if there are fewer. At most ``bins`` counts come to the driver at a time.

    Counts by equal bins of the range tell which bin holds the value; that bin is cut again until it holds one value.
    """
    low, high = scored.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    value = F.col(column)
    own = scored.where(value.isNotNull())
    while True:
        if low == high:
            return low if own.where((value >= low) & (value <= high)).count() >= k else None
        within = own.where((value >= low) & (value <= high))
        at = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        seen = sorted(within.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["at"])
        for r in seen:
            if r["n"] >= k:
                if len(seen) == 1 and (low, high) == (r["low"], r["high"]):  # neighbours in floating point
                    return high if within.where(value == high).count() >= k else low
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
        else:
            return None


def _drawn(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` ids of the least hash (of equal hashes all), all if there are no more: a rerun draws the same."""
    drawn = ids.withColumn("draw", -F.pmod(F.xxhash64("good", F.lit(seed)), F.lit(1 << 52)).cast("double"))
    least = kth_largest(drawn, "draw", most)
    return (drawn if least is None else drawn.where(F.col("draw") >= least)).select("good")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_target: float = 0.999, target_rows: int = 50_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of id and text), log_weight, gumbel_key, selected: Gumbel top-k of all rows by log weight.

    Target text is that of rows whose label has quality 1: its model is fitted on at most ``target_rows`` of their ids,
    a bound small enough to send to all executors, so that texts are not shuffled. The model of raw text counts all rows.
    ``gumbel_key`` is the log weight plus a Gumbel draw that depends on id and seed; the ``k`` largest are selected (ties
    with the k-th too). Without ``k``, k is as many rows as reach the key that the share ``keep_target`` of all labelled
    target rows reaches; so k is then a result, not a given number. If no label has quality 1, all rows are selected. A null text counts as empty; a row without an
    id has no label; labels that repeat an id count as target if one of them does. Repeated rows share their key and are
    selected together; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    good = materialize(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("good")).where("good is not null").distinct(), "good")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = materialize(_drawn(good, target_rows, seed), "target")
    marked = own.join(F.broadcast(drawn), F.col("doc_id") == F.col("good"), "left")
    ratio = fit(marked, F.col("good").isNotNull())
    scored = weights(own, ratio, "doc_id", "text", row_key("doc_id", "text").alias("key"))
    scored = materialize(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.coalesce("doc_id", "key"), seed)), "weights")
    if k is None:
        targets = scored.join(good, F.col("doc_id") == F.col("good"), "left_semi")
        least = kth_largest(targets, "gumbel_key", max(1, math.ceil(keep_target * targets.count())))
    else:
        least = kth_largest(scored, "gumbel_key", k) if k > 0 else math.inf
    chosen = F.lit(True) if least is None else F.col("gumbel_key") >= least
    return scored.select("doc_id", "key", "log_weight", "gumbel_key", chosen.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, with all columns, without the rows that resampling rejects.

    Rows of equal id and text go or stay together, rows without an id are judged by their text, null texts as empty
    ones; an empty table stays empty, and columns of any name are kept.
    """
    with small_batches(docs.sparkSession):
        gone = resample(docs, labels, id_col=id_col, text_col=text_col, **options).where("not selected")
    key = fresh(docs, "key")
    return docs.join(gone.select(F.col("key").alias(key)).distinct().hint("merge"), row_key(id_col, text_col) == F.col(key), "left_anti")
