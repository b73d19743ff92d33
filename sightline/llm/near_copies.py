"""Near copies by the exact Jaccard similarity of five-word shingles.

SimHash fingerprints of the shingles are linked as in ``simhash``: in buckets of equal bits, in tiles, by exclusive-or and
bit count. That radius misses most pairs that are less alike, so MinHash bands deal texts into buckets, too, where every
pair is compared by its fingerprints; exact similarity decides on what all these propose. Groups are what links connect,
so comparing in three steps, each within what the step before has not connected, saves most pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import minhash, simhash
from sightline.llm.rows import Batches, arrow_map, ending, row_key, small_batches, text_input
from sightline.llm.simhash import TILE, first_of_groups, keep_first
from sightline.operators.graph import connected_components
from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted

#: A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS: 1.3e-7 at 0.8, less above.
BANDS, ROWS = 40, 5
#: Bits of the map that tells which texts to read again.
MAP_BITS = 24
#: Pairs in a batch.
PAIRS = 65_536
#: Fingerprints of sets of similarity 0.8 differ in 9.7 of 64 bits on average; more than RADIUS by chance of 1e-6.
RADIUS = 24
#: Majorities of few shingles turn more easily: 12 bits on average where 4 shingles face 5. Sets of under SMALL shingles may differ in WIDE.
SMALL, WIDE = 64, 36
#: Least hashes of a set that stand for it where all that is left is compared: whole for smaller sets.
LEAST_HASHES = 256
#: Nearest members of other components that a text is compared with in the second step.
NEAREST = 4
#: Least similarity that bands, radius and sift are made for.
LEAST = 0.8
#: Rows of a band that a task compares; of a larger band those meet that share a second band, too, and a third.
BUCKET, DEEPEST = 16_384, 3
#: Pairs of one set that meet it in one task.
MANY = 4_096


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted."""
    return np.unique(minhash.shingle_hashes(text))


def node(hashes: np.ndarray) -> int:
    """One number for each set of shingles."""
    x = xxhash.xxh64_intdigest(hashes.tobytes())
    return x - (1 << 64) if x >= 1 << 63 else x


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers, each of ROWS bins of the MinHash sketch; none without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    bins, out = minhash.sketch(hashes)[: BANDS * ROWS].reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = minhash._mix(out * minhash._SPREAD + bins[:, k])
    return out.view(np.int64)


def simhash_of(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if it is so in over half the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    mixed = minhash._mix(hashes * minhash._SPREAD)
    for at in range(0, len(mixed), 65_536):
        votes += np.unpackbits(mixed[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(mixed)).view(np.int64)[0])


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, node, size (distinct shingles), fp (SimHash), bands; one row per input row."""

    def run(part: pa.RecordBatch) -> dict:
        sets = [shingles(t.as_py()) for t in part.column("text")]
        return {"key": part.column("key"), "doc_id": part.column("doc_id"), "node": [node(s) for s in sets], "size": [len(s) for s in sets], "fp": [simhash_of(s) for s in sets], "bands": [bands(s) for s in sets]}

    return arrow_map(text_input(docs, id_col, text_col, row_key(id_col, text_col).alias("key")), "key long, doc_id long, node long, size int, fp long, bands array<long>", run, minhash._words.clear)


def _buckets(of_band: DataFrame, pairs_of: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """a, b (a < b), distinct: what ``pairs_of`` proposes for each band, given its rows (node, component, size, fp) and their least hashes, if there are any."""
    names = ["band", "node", "component", "size", "fp"]
    lows = "low" in of_band.columns
    dealt = of_band.select(*names, *["low"] * lows).repartition("band").sortWithinPartitions("band", "component", "node")

    def run(batches: Batches) -> Batches:
        out, waiting = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, waiting
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out, waiting = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def close(rows: list[np.ndarray], low: list[list[bytes]]) -> Batches:
            nonlocal waiting
            for a, b in pairs_of(np.concatenate(rows, axis=1)[1:], _filled([x for part in low for x in part])):
                if len(a):
                    out.append((a, b))
                    waiting += len(a)
                    if waiting >= PAIRS:
                        yield flush()

        held, held_low = [], []
        for part in batches:
            if not part.num_rows:
                continue
            rows = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(names))])
            low = part.column(len(names)).to_pylist() if lows else []
            if held and held[0][0, 0] != rows[0, 0]:
                yield from close(held, held_low)
                held, held_low = [], []
            starts = [0, *(np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1).tolist(), rows.shape[1]]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                held.append(rows[:, s:e])
                held_low.append(low[s:e])
                if e < rows.shape[1]:
                    yield from close(held, held_low)
                    held, held_low = [], []
        if held:
            yield from close(held, held_low)
        if out:
            yield flush()

    return dealt.mapInArrow(ending(run), "a long, b long").distinct()


def _bounded(rows: DataFrame, bands: DataFrame, bound: int) -> DataFrame:
    """``rows`` (band, node, component, ...) where bands of over ``bound`` rows are dealt anew by a second band of their nodes, then a third.

    Two texts of similarity LEAST that share a band share none of the 39 others with probability 1.9e-7, so hardly more
    is missed than by bands alone, however many texts have a band in common. Bands within one component are left out.
    """
    out = None
    for _ in range(DEEPEST - 1):
        sized = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        few = rows.join(sized.where(F.col("n") <= bound).select("band"), "band", "left_semi")
        out = few if out is None else out.unionByName(few)
        large = materialize(rows.join(sized.where(F.col("n") > bound).select("band"), "band", "left_semi"), "large")
        if large.isEmpty():
            return out
        other = bands.select("node", F.col("band").alias("other"))
        dealt = large.join(other, "node").where("band <> other").withColumn("band", F.xxhash64("band", "other")).select(*rows.columns)
        rows = materialize(dealt, "dealt")
    return out.unionByName(rows)


_FILL = np.uint32(0xFFFFFFFF)


def _filled(low: list[bytes]) -> np.ndarray:
    """Rows of LEAST_HASHES numbers, shorter ones filled up with the greatest."""
    out = np.full((len(low), LEAST_HASHES), _FILL, dtype=np.uint32)
    for row, raw in zip(out, low, strict=True):
        row[: len(raw) // 4] = np.frombuffer(raw, "<u4")
    return out


def _tiles(own: np.ndarray, least: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a tile, order of the others, their distances, whether the pair may be near) by tiles of bit count.

    Distances are of SimHash fingerprints; members of one component, and sizes too far apart, are no pair.
    """
    _, parts, sizes, fps = own
    ones = np.bitwise_count(fps.view(np.uint64)).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    parts, sizes, fps, ones = parts[order], sizes[order], fps[order].view(np.uint64), ones[order]
    for at in range(0, len(order), TILE):
        tile = slice(at, at + TILE)
        reach = WIDE if sizes.min() < SMALL else RADIUS
        low, high = np.searchsorted(ones, [ones[tile][0] - reach, ones[tile][-1] + reach + 1])
        others = slice(int(low), int(high))
        off = np.bitwise_count(fps[tile, None] ^ fps[None, others])
        small, large = np.minimum(sizes[tile, None], sizes[None, others]), np.maximum(sizes[tile, None], sizes[None, others])
        may = (parts[tile, None] != parts[None, others]) & (off <= np.where(small < SMALL, WIDE, RADIUS)) & (small >= least * large - 1e-9)
        yield order[tile], order[others], off, may


def _nearest(own: np.ndarray, _: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member with the NEAREST of other components."""
    for mine, others, off, may in _tiles(own, least):
        far = np.where(may, off, 255)
        k = min(NEAREST, far.shape[1])
        best = np.argpartition(far, k - 1, axis=1)[:, :k]
        a, n = np.nonzero(np.take_along_axis(far, best, axis=1) < 255)
        yield own[0][mine[a]], own[0][others[best[a, n]]]


def _across(own: np.ndarray, low: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of members of different components that may be near, by their least hashes too."""
    for mine, others, _, may in _tiles(own, least):
        for a, row in zip(mine.tolist(), may, strict=True):
            b = others[row & (own[0][others] > own[0][a])]  # each pair once
            if len(b):
                b = b[_near_by_least(low, a, b, least)]
                yield np.full(len(b), own[0][a]), own[0][b]


def _read(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, schema: str, of: Callable[[np.ndarray], object], id_col: str, text_col: str) -> DataFrame:
    """node and what ``of`` makes of its set, for the nodes of ``wanted``, as a written table.

    One text of each node is read again where it lies: a map of bounded size tells which, so no text is shuffled.
    """
    at = wanted.join(nodes, "node").select(F.col("first.key").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    found, bits = words.toArrow(), np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared, name = docs.sparkSession.sparkContext.broadcast(bits), schema.split()[0]

    def run(part: pa.RecordBatch) -> dict:
        at = part.column("key").to_numpy(zero_copy_only=False) & ((1 << MAP_BITS) - 1)
        asked = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
        sets = [shingles(part.column("text")[int(k)].as_py()) for k in np.flatnonzero(asked)]
        return {"node": [node(s) for s in sets], name: [of(s) for s in sets]}

    read = arrow_map(text_input(docs, id_col, text_col, row_key(id_col, text_col).alias("key")), f"node long, {schema}", run, minhash._words.clear)
    with small_batches(docs.sparkSession):
        return materialize(read.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``least``, as a written table."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _read(docs, ends, nodes, "set array<long>", lambda s: s.view(np.int64), id_col, text_col)
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # a set that many pairs have goes to several tasks, a part of its pairs to each
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / MANY).cast("int").alias("tasks")).where("tasks > 1")
    salted = pairs.join(often, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    left = left.join(often, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    near = salted.join(right, "b").join(left, ["a", "salt"]).where(both / (F.size("x") + F.size("y") - both) >= least)
    return materialize(near.select("a", "b"), "near")


def least_hashes(hashes: np.ndarray) -> bytes:
    """The LEAST_HASHES least of the set's hashes, of 32 bits each, sorted."""
    return np.unique((minhash._mix(hashes) >> np.uint64(32)).astype("<u4"))[:LEAST_HASHES].tobytes()


def _near_by_least(low: np.ndarray, a: int, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` may be as near as ``least`` to row ``a`` of ``low`` (least hashes, filled up with the greatest number).

    Up to the lesser of their last hashes two rows show all of both sets, which makes the similarity there a sample of
    the whole one; rows that are whole sets show it exactly. A pair goes if it falls short by over 4.5 deviations.
    """
    full = low[:, -1] < _FILL
    upto = np.where(full, low[:, -1], _FILL - np.uint32(1))
    own, rest = low[a], low[others]
    t = np.minimum(upto[a], upto[others])
    shown = rest <= t[:, None]
    at = np.searchsorted(own, rest)
    hit = (own[np.minimum(at, len(own) - 1)] == rest) & shown
    n = np.searchsorted(own, t, side="right") + shown.sum(axis=1)
    m = hit.sum(axis=1)
    slack = np.where(full[a] | full[others], 4.5 * np.sqrt(least * (1 - least) / np.maximum(n - m, 1)), 1e-3)
    return m >= (least - slack) * (n - m)


def _alike(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (node, fp) that ``simhash.links`` connects; of one fingerprint, the least node stands for all."""
    of = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("rows")), "fps")
    same = join_counted(nodes.select("fp", "node"), of.where("rows > 1"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = simhash.links(of.select("fp")).distinct().toDF("x", "y")
    ends = ends.join(of.select(F.col("fp").alias("x"), F.col("least").alias("a")), "x").join(of.select(F.col("fp").alias("y"), F.col("least").alias("b")), "y")
    return same.union(ends.select("a", "b"))


def first_rows(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, node, first (of the row's group); one row per input row.

    Nodes are the distinct sets of shingles; groups are what pairs of at least ``least`` connect. First fingerprints are
    linked whatever their bands, and in each band all nodes are compared with the least. Then, in each band, each is
    compared with those of other components whose fingerprints are nearest, and at last all that are still in different
    components with each other.
    Texts without words are one group.

    ``least`` is LEAST or more: bands and sift are made for that, and would miss pairs of less.
    """
    if not LEAST <= least <= 1:
        raise ValueError(f"a similarity from {LEAST} to 1, not {least}: bands would miss others")
    with small_batches(docs.sparkSession):
        rows = materialize(_sketched(docs, id_col, text_col), "sketched")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first"), F.max("size").alias("size"), F.max("fp").alias("fp")), "nodes")
    alone = rows.join(nodes.select("node", F.col("first.key").alias("key")), ["node", "key"]).select("node", "size", "fp", "bands").dropDuplicates(["node"])
    met = materialize(alone.select("node", "size", "fp", F.explode("bands").alias("band")), "bands")
    hubs = met.groupBy("band").agg(F.min(F.struct("node", "size", "fp")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    shared = materialize(met.join(hubs, "band"), "shared")
    small = F.least("size", "hub.size")
    near_size = small >= least * F.greatest("size", "hub.size") - 1e-9
    near_fp = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= F.when(small < SMALL, WIDE).otherwise(RADIUS)
    first = shared.where((F.col("node") != F.col("hub.node")) & near_size & near_fp).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    # both kinds of pairs in one pass over the texts, and their components at once
    links = _verified(docs, materialize(_alike(nodes).union(first).distinct(), "pairs"), nodes, least, id_col, text_col)
    parts = materialize(connected_components(links, "a", "b").select("node", F.col("component").alias("part")), "parts")
    for step in (_nearest, _across):
        of_band = shared.join(parts, "node", "left").select("band", "node", "size", "fp", F.coalesce("part", "node").alias("component"))
        several = of_band.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
        left = materialize(_bounded(materialize(of_band.join(several, "band", "left_semi"), "open"), met, BUCKET), "open")
        if step is _across:  # what is left after the others is compared by more than a fingerprint
            left = left.join(_read(docs, left.select("node").distinct(), nodes, "low binary", least_hashes, id_col, text_col), "node")
        pairs = materialize(_buckets(left, partial(step, least=least)), "pairs")
        if pairs.isEmpty():
            break
        more = _verified(docs, pairs, nodes, least, id_col, text_col)
        parts = materialize(_joined(parts, more).select("node", F.col("component").alias("part")), "parts")
    return first_of_groups(rows.select("key", "doc_id", "node"), parts.withColumnRenamed("part", "component"))


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """node, component: ``parts`` (node, part) whose components further links (a, b) connect."""
    ends = more.join(parts.select(F.col("node").alias("a"), F.col("part").alias("x")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("part").alias("y")), "b", "left")
    over = connected_components(ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "x", "y")
    every = parts.unionByName(more.select(F.col("a").alias("node"), F.col("a").alias("part")).union(more.select("b", "b"))).groupBy("node").agg(F.min("part").alias("part"))
    return every.join(over.select(F.col("node").alias("part"), "component"), "part", "left").select("node", F.coalesce("component", "part").alias("component"))


def drop_near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, with one row of each group of near copies: that of the least id, null ids last.

    Of equal rows one stays, and an id that repeats loses only the texts that are copies. Texts without words are one
    group, an empty table stays empty, texts of any length are read whole.
    """
    return keep_first(docs, first_rows(docs, least, id_col, text_col), id_col, text_col)
