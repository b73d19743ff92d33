"""Joins of 64-bit hashes by differing bits, in buckets and tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.plans.lineage import materialize

#: Hashes that a task compares in one bucket; a larger bucket is dealt anew by more of its bits.
BUCKET = 8_192
#: Hashes in a tile.
TILE = 512
#: Hashes of a group whose largest distance one task seeks alone, and about as many are in a tile of a larger group.
GROUP, GROUP_TILE = 8_192, 1_024

Batches = Iterator[pa.RecordBatch]


def _bits(x: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _without(x: Column, start: int, width: int) -> Column:
    """``x`` with the bits from ``start`` taken out, those above moved down."""
    above = F.shiftleft(F.shiftrightunsigned(x, start + width), start) if start + width < 64 else F.lit(0).cast("long")
    return above.bitwiseOR(_bits(x, 0, start)) if start else above


def slices(x: Column, width: int = 16) -> Column:
    """Array of (n, v, rest): each slice of ``width`` bits, and the bits beside it."""
    return F.array(*(F.struct(F.lit(k).cast("long").alias("n"), _bits(x, k, width).alias("v"), _without(x, k, width).alias("rest")) for k in range(0, 64, width)))


def lane_pairs(x: Column, bits: int, differing: int) -> Column:
    """Array of (n, v, rest) for each pair of ``differing`` + 2 lanes of a number of ``bits`` bits, and the bits beside them.

    At most ``differing`` lanes hold differing bits, so two numbers as near as that share a pair.
    """
    lanes = differing + 2
    width = -(-bits // lanes)
    cut = [(k * width, max(0, min(width, bits - k * width))) for k in range(lanes)]
    out = []
    for a in range(lanes):
        for b in range(a + 1, lanes):
            v = _bits(x, *cut[a]) + (F.shiftleft(_bits(x, *cut[b]), width) if cut[b][1] else F.lit(0))
            rest = _without(_without(x, *cut[b]) if cut[b][1] else x, *cut[a])
            out.append(F.struct(F.lit(a * lanes + b).cast("long").alias("n"), v.alias("v"), rest.alias("rest")))
    return F.array(*out)


def _forest(near: np.ndarray, parts: np.ndarray, i: slice, j: slice) -> Iterator[tuple[int, int]]:
    """Pairs of ``near`` that connect different components; ``parts`` is kept up to date."""
    a, b = np.nonzero(near & (parts[i][:, None] != parts[j][None]))
    a, b = a + i.start, b + j.start
    _, first = np.unique(parts[a] * len(parts) + parts[b], return_index=True)  # one pair for two components is enough
    for k in first.tolist():
        x, y = parts[a[k]], parts[b[k]]
        if x != y:
            parts[parts == max(x, y)] = min(x, y)
            yield a[k], b[k]


def tiled_pairs(h: np.ndarray, o: np.ndarray, differing: int, other: int, forest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of pairs with at most ``differing`` bits of ``h`` and ``other`` bits of ``o`` between them.

    Hashes are sorted by bit count, and tiles compared whose counts are no farther apart than ``differing``. With
    ``forest`` only as many pairs as connect what is near.
    """
    ones = np.bitwise_count(h).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    h, o, ones = h[order], o[order], ones[order]
    parts = np.arange(len(h))
    for at in range(0, len(h), TILE):
        i = slice(at, min(at + TILE, len(h)))
        for then in range(at, len(h), TILE):
            j = slice(then, min(then + TILE, len(h)))
            if ones[j][0] - ones[i][-1] > differing:
                break
            near = np.bitwise_count(h[i, None] ^ h[None, j]) <= differing
            near &= np.bitwise_count(o[i, None] ^ o[None, j]) <= other
            if at == then:
                near = np.triu(near, 1)
            if forest:
                a, b = np.array([*_forest(near, parts, i, j)], dtype=np.int64).reshape(-1, 2).T
            else:
                a, b = np.nonzero(near)
                a, b = a + at, b + then
            if len(a):
                yield order[a], order[b]


def _compare(rows: DataFrame, keys: list[str], differing: int, other: int, forest: bool, bound: int | None) -> DataFrame:
    """a, b, again, h, o, rest and the keys: pairs in each bucket; the rows of a bucket of over ``bound`` come back as a, again."""
    kind = rows.schema["i"].dataType.simpleString()
    dealt = rows.select("i", "h", "o", "rest", *keys).repartition(*keys).sortWithinPartitions(*keys)
    names = ["a", "b", "again", "h", "o", "rest", *keys]

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        key, n, over = None, 0, False

        def emit(part: pa.RecordBatch, b: pa.Array, again: bool) -> pa.RecordBatch:
            cols = [part.column("i"), b, pa.array(np.full(part.num_rows, again)), *(part.column(c) for c in ("h", "o", "rest", *keys))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def close() -> Batches:
            if not held or (n < 2 and not over):
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if over:
                yield emit(whole, whole.column("i"), True)
                return
            h, o = (whole.column(c).to_numpy().view(np.uint64) for c in ("h", "o"))
            for a, b in tiled_pairs(h, o, differing, other, forest):
                yield emit(whole.take(pa.array(a)), whole.column("i").take(pa.array(b)), False)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if own[:, s].tolist() != key:
                    yield from close()
                    held, key, n, over = [], own[:, s].tolist(), 0, False
                held.append(batch.slice(s, e - s))
                n += e - s
                if bound and n > bound:
                    over = True
                    yield from close()
                    held = []
        yield from close()

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, again boolean, h long, o long, rest long, {', '.join(f'{k} long' for k in keys)}")


def near_pairs(nodes: DataFrame, differing: int = 5, other: int = 10, exact: bool = False, forest: bool = False, bound: int | None = None) -> DataFrame:
    """a, b: pairs of ``nodes`` (i, h, o; each (h, o) once) whose ``h`` differ in at most ``differing`` bits and ``o`` in at most ``other``.

    Only pairs that share a slice of 16 bits of ``h`` are seen, which all of up to 3 bits do; with ``exact`` rows meet by
    pairs of ``differing`` + 2 lanes, and none is missed. Buckets of over ``bound`` rows are dealt anew by lanes of the
    bits of ``h`` that the bucket leaves open, then of ``o``: no pair of the bucket is lost, and a slice that most rows
    share is no single task. Pairs may repeat. With ``forest`` only as many pairs come as connect what these connect.
    """
    bound = bound or BUCKET
    shared = 2 * -(-64 // (differing + 2)) if exact else 16
    rows = nodes.select("i", "h", "o", F.inline(lane_pairs(F.col("h"), 64, differing) if exact else slices(F.col("h"))))
    levels = [("n1", "v1", None), ("n2", "v2", lane_pairs(F.col("rest"), 64 - shared, differing)), ("n3", "v3", lane_pairs(F.col("o"), 64, other))]
    keys: list[str] = []
    out = None
    for n, v, anew in levels:
        if anew is not None:
            rows = rows.select("i", "h", "o", *keys, F.inline(anew))
        rows = rows.withColumnsRenamed({"n": n, "v": v})
        keys += [n, v]
        found = materialize(_compare(rows, keys, differing, other, forest, None if n == "n3" else bound), "pairs")
        pairs = found.where("not again").select("a", "b")
        out = pairs if out is None else out.union(pairs)
        rows = found.where("again").select(F.col("a").alias("i"), "h", "o", "rest", *keys)
        if rows.isEmpty():
            break
    return out


def _farthest(packed: DataFrame, group: str) -> DataFrame:
    """``group``, far: the largest distance between the hashes of arrays x and y, tile by tile."""
    kind = packed.schema[group].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            far = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                far.append(max(int(np.bitwise_count(x[at : at + TILE, None] ^ y[None]).max()) for at in range(0, len(x), TILE)))
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(far, pa.int32())], names=[group, "far"])

    return packed.select(group, "x", "y").mapInArrow(run, f"{group} {kind}, far int")


def diameters(members: DataFrame, group: str, h: str, bound: int | None = None) -> DataFrame:
    """``group``, max_distance: the most bits in which two hashes ``h`` of a group differ.

    No pair is listed. The hashes of a group of up to ``bound`` distinct ones are compared by one task in tiles. Larger
    groups are cut into tiles of equal bit count; pairs of tiles are dealt over the tasks, but for those whose bit counts
    keep them below what is known: the farthest from the hash that is farthest from the least one.
    """
    bound = bound or GROUP
    rows = materialize(members.select(group, F.col(h).alias("h")).distinct(), "hashes")
    sized = rows.groupBy(group).agg(F.count("*").alias("m"), F.min("h").alias("pivot"))
    small = rows.join(sized.where(F.col("m") <= bound), group).groupBy(group).agg(F.collect_list("h").alias("x"))
    out = _farthest(small.withColumn("y", F.col("x")), group)
    large = materialize(rows.join(sized.where(F.col("m") > bound), group).withColumn("ones", F.bit_count("h")), "large")
    if large.isEmpty():
        return out.withColumnRenamed("far", "max_distance")
    off = lambda other: F.bit_count(F.col("h").bitwiseXOR(F.col(other)))
    second = large.groupBy(group).agg(F.max_by("h", F.struct(off("pivot"), "h")).alias("second"))
    known = large.join(second, group).groupBy(group).agg(F.max(off("second")).alias("known"))
    counts = large.groupBy(group, "ones").agg(F.count("*").alias("n"))
    tile = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / GROUP_TILE)).alias("tile")
    tiles = materialize(large.join(counts, [group, "ones"]).select(group, "ones", tile, "h").groupBy(group, "ones", "tile").agg(F.collect_list("h").alias("hashes")), "tiles")
    names = tiles.select(group, "ones", "tile")
    a, b = names.withColumnsRenamed({"ones": "ones_a", "tile": "tile_a"}), names.withColumnsRenamed({"ones": "ones_b", "tile": "tile_b"})
    both = F.col("ones_a") + F.col("ones_b")
    may = (F.struct("ones_a", "tile_a") <= F.struct("ones_b", "tile_b")) & (F.least(both, 128 - both) > F.col("known"))
    pairs = a.join(known, group).join(b, group).where(may)
    hashes = lambda k, to: tiles.select(group, F.col("ones").alias(f"ones_{k}"), F.col("tile").alias(f"tile_{k}"), F.col("hashes").alias(to))
    met = pairs.join(hashes("a", "x"), [group, "ones_a", "tile_a"]).join(hashes("b", "y"), [group, "ones_b", "tile_b"])
    every = out.unionByName(_farthest(met, group)).unionByName(known.select(group, F.col("known").cast("int").alias("far")))
    return every.groupBy(group).agg(F.max("far").alias("max_distance"))
