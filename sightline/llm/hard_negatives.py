"""Hard negatives by slot-decomposed selection.

An anchor's positives give windows of scores, which overlap. Their upper limits cut the scores into disjoint slots, so a
negative belongs to one slot only: each task keeps the best few of each slot, these are merged for the anchor, and as
slots are ranges of scores, the best of a window are the first of a suffix of the anchor's merged list. Anchors are a
stated set of queries: they go out in blocks of bounded size, each against all rows where these lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.rows import Batches, ending
from sightline.plans.lineage import materialize, scratch_path

#: Anchors in a block, and bytes of their vectors, at most (about: blocks are dealt by hash).
ANCHORS, BLOCK_BYTES = 4_096, 32 << 20
#: Scores that a task holds at once.
SCORES = 2_000_000
#: Candidates that wait in a task before they are cut to the best of each group.
WAITING = 500_000
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer inner products (rows x anchors) of whole numbers in doubles; beyond 64 bits they stay at the range's end."""
    bound = rows.shape[1] * np.abs(rows).max(initial=0.0) * np.abs(anchors).max(initial=0.0)
    if bound < 2.0**53:
        return (rows @ anchors.T).astype(np.int64)
    most = np.finfo(np.float64).max
    whole = [np.array([[int(x) for x in v] for v in np.clip(m, -most, most)], dtype=object).reshape(m.shape) for m in (rows, anchors)]
    return np.clip(whole[0] @ whole[1].T, LOWEST, HIGHEST).astype(np.int64)


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


class Best:
    """The ``k`` best of each group, by score, ties by smaller id, of candidates that come in parts."""

    def __init__(self, groups: int, k: int):
        self.k, self.kth = k, np.full(groups, LOWEST)
        self.held = [np.zeros(0, np.int64)] * 3
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def put(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.kth[group]
        self.parts.append((group[may], score[may], ids[may]))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > WAITING:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """group, score, id of the best so far, in order."""
        group, score, ids = (np.concatenate(x) for x in zip(self.held, *self.parts, strict=True))
        at = np.lexsort((ids, ~score, group))
        group, score, ids = group[at], score[at], ids[at]
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        rank = np.arange(len(group)) - starts[np.cumsum(new) - 1] if len(group) else np.zeros(0, int)
        full = rank == self.k - 1
        self.kth[group[full]] = score[full]
        self.held, self.parts, self.waiting = [x[rank < self.k] for x in (group, score, ids)], [], 0
        return self.held


class Block:
    """Anchors of one length: row, id, label, vectors; and, for negatives, their slots."""

    def __init__(self, rows: list[dict], low: int, high: int):
        self.row, self.id, self.label = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("row", "id", "label"))
        self.vec = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        windows = [[limits(s, low, high) for s in r.get("scores") or []] for r in rows]
        windows = [[tuple(max(LOWEST, min(x, HIGHEST)) for x in w) for w in own if w[0] <= w[1]] for own in windows]
        self.least = np.array([min((a for a, _ in own), default=HIGHEST) for own in windows])
        uppers = [sorted({b for _, b in own}, reverse=True) for own in windows]
        self.uppers = np.full((len(rows), max(map(len, uppers), default=0) or 1), LOWEST)
        for at, own in zip(self.uppers, uppers, strict=True):
            at[: len(own)] = own


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector in a batch."""
    col = batch.column("vec")
    offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)].reshape(len(rows), d)


def _search(rows: DataFrame, blocks: dict[int, Block], k: int, pick: Callable, names: list[str]) -> DataFrame:
    """Rows of ``names`` (long): the ``k`` best of each group that ``pick`` makes, for each task over ``rows``.

    ``pick`` tells of a block's scores which are candidates, as (group, score, position of the row), and what a group is.
    """
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Batches) -> Batches:
        best: dict[int, Best] = {}
        for batch in batches:
            ids, tags, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "label"))
            for at, vectors in _vectors(batch):
                block = shared.value.get(vectors.shape[1])
                if block is None:
                    continue
                own = best.setdefault(vectors.shape[1], Best(len(block.row) * block.uppers.shape[1], k))
                step = max(1, SCORES // len(block.row))
                for s in range(0, len(at), step):
                    part = at[s : s + step]
                    scores = inner_products(vectors[s : s + step], block.vec)
                    group, score, r = pick(block, scores, labels[part], tags[part])
                    own.put(group, score, ids[part][r])
        for d, own in best.items():
            group, score, ids = own.cut()
            block = shared.value[d]
            anchor, slot = np.divmod(group, block.uppers.shape[1])
            cols = {"anchor": block.row[anchor], "anchor_id": block.id[anchor], "upper": block.uppers[anchor, slot], "score": score, "id": ids}
            yield pa.RecordBatch.from_arrays([pa.array(cols[n]) for n in names], names=names)

    return rows.mapInArrow(ending(run), ", ".join(f"{n} long" for n in names))


def _same_label(block: Block, scores: np.ndarray, labels: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    r, a = np.nonzero((labels[:, None] == block.label) & (tags[:, None] != block.row))
    return a * block.uppers.shape[1], scores[r, a], r


def _in_slots(block: Block, scores: np.ndarray, labels: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    r, a = np.nonzero((labels[:, None] != block.label) & (scores <= block.uppers[:, 0]) & (scores >= block.least))
    score = scores[r, a]
    slot = (block.uppers[a] >= score[:, None]).sum(axis=1) - 1  # the last whose upper limit it does not exceed
    return a * block.uppers.shape[1] + slot, score, r


def _blocks(anchors: DataFrame, n_blocks: int, low: int, high: int) -> Iterator[tuple[int, dict[int, Block]]]:
    for k in range(n_blocks):
        by: dict[int, list[dict]] = {}
        for r in anchors.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k).toArrow().to_pylist():  # ANCHORS or so
            by.setdefault(len(r["vec"]), []).append(r)
        if by:
            yield k, {d: Block(own, low, high) for d, own in by.items()}


def _best(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are multiplied by ``scale`` and rounded down. Scores are integer inner products with the anchor, higher ones
    first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of another label are returned whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null label, a null vector or a null or non-finite component take no part; a null id comes after all others and a row whose
    vector has another length is no partner. A score beyond 64 bits counts as the last number within. Repeated rows and ids are rows of their own: an anchor that repeats is
    answered each time, and its copy is another row. No anchor, or an empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    fit = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    down = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # beyond, doubles are whole numbers
    scaled = F.transform(vec_col, lambda x: down(x.cast("double") * scale))
    taken = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(HIGHEST)).alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), fit.alias("fit"))
    rows = materialize(taken.where("label is not null and fit").drop("fit").withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where("is_anchor").select("row", "id", "label", "vec")
    n, longest = anchors.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_blocks = max(-(-n // ANCHORS), -(-n * (longest or 0) * 8 // BLOCK_BYTES))

    found = scratch_path(spark, "positives")
    names = ["anchor", "anchor_id", "score", "id"]
    for k, blocks in _blocks(anchors, n_blocks, low, high):
        _search(rows, blocks, positives, _same_label, names).write.parquet(f"{found}/block={k}")
    if not n:
        return spark.createDataFrame([], RESULT)
    own = materialize(_best(spark.read.schema(", ".join(f"{c} long" for c in names)).parquet(found), ["anchor", "anchor_id"], positives), "positives")

    scored = anchors.join(own.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("scores")), "row")
    slots, names = scratch_path(spark, "slots"), ["anchor", "upper", "score", "id"]
    some = False
    for k, blocks in _blocks(scored, n_blocks, low, high):
        _search(rows, blocks, negatives, _in_slots, names).write.parquet(f"{slots}/block={k}")
        some = True
    if not some:  # no anchor has a positive
        return spark.createDataFrame([], RESULT)
    of_slot = _best(spark.read.schema(", ".join(f"{c} long" for c in names)).parquet(slots), ["anchor", "upper"], negatives)
    entry = F.struct((-F.col("score")).alias("order"), "id", "score", "upper")
    merged = of_slot.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # positives * negatives at most
    wide = F.col("positive_score").cast("decimal(20,0)")
    lowest, highest = F.ceil(wide * low / 100), F.floor(wide * high / 100)
    windows = own.select("anchor", "anchor_id", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).withColumns({"lowest": lowest, "highest": highest})
    suffix = F.filter("entries", lambda e: (e["upper"] <= F.col("highest")) & (e["score"] >= F.col("lowest")))
    each = windows.join(merged, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "e"))
    named = lambda c: F.when(c != HIGHEST, c)
    return each.select(named(F.col("anchor_id")).alias("anchor_id"), named(F.col("positive_id")).alias("positive_id"), (F.col("at") + 1).alias("rank"), named(F.col("e.id")).alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))
