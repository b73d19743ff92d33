"""SimHash fingerprints and their groups by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.rows import arrow_map, ending, fresh, row_key, text_input
from sightline.operators.graph import connected_components
from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted

#: Fingerprints of one bucket that a task compares at once; a larger bucket is dealt anew by more of its bits.
BUCKET = 16_384
#: Fingerprints in a tile.
TILE = 512


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if it is set in over half the XXH64 values of the word shingles, repeats included.

    Words are lower-cased (A-Z) runs without ASCII white space. Fewer words than a shingle has: their whole sequence is
    the one shingle. No word: 0.
    """
    own = text.encode().lower().split()
    if not own:
        return 0
    shingles = map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), if asked for the row's key; a null text counts as empty."""

    def run(part: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t.as_py(), words) for t in part.column("text")], dtype=np.uint64)
        return {"doc_id": part.column("doc_id"), "fp": pa.array(values.view(np.int64))} | ({"key": part.column("key")} if keyed else {})

    rows = text_input(docs, id_col, text_col, *([row_key(id_col, text_col).alias("key")] if keyed else []))
    return arrow_map(rows, "doc_id long, fp long" + ", key long" * keyed, run)


def tiled_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is within ``radius`` bits: positions (a, b) of a spanning forest.

    Fingerprints are sorted by population count and cut into tiles; every pair of tiles is compared exactly by
    exclusive-or and bit count, but for pairs whose population counts differ by more than the radius throughout.
    """
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order].astype(np.int64)
    parent = np.arange(len(fps))
    out_a, out_b = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(fps), TILE):
        left = fps[i : i + TILE]
        for j in range(i, len(fps), TILE):
            if ones[j] - ones[min(i + TILE, len(fps)) - 1] > radius:
                break
            near = np.bitwise_count(left[:, None] ^ fps[None, j : j + TILE]) <= radius
            for a, b in zip(*np.nonzero(near), strict=True):
                a, b = i + int(a), j + int(b)
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out_a.append(a)
                    out_b.append(b)
    return order[np.array(out_a, dtype=np.int64)], order[np.array(out_b, dtype=np.int64)]


def _bit_keys(fp: F.Column, start: int, width: int, prefix: list[F.Column]) -> F.Column:
    """Array of keys: ``width`` bits from ``start`` are cut into 4 lanes, each key has 2 of them.

    Of 4 lanes at most 2 hold differing bits if at most 2 bits differ, so two such fingerprints share a key.
    """
    lane = width // 4
    lanes = [F.shiftright(fp, start + k * lane).bitwiseAND(F.lit((1 << lane) - 1)) for k in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    return F.array(*(F.struct(*prefix, F.lit(n).alias("combo"), lanes[a].alias("x"), lanes[b].alias("y")) for n, (a, b) in enumerate(pairs)))


def _compare(rows: DataFrame, key: list[str], radius: int, bound: int | None) -> DataFrame:
    """a, b, again: links of each bucket; rows of a bucket of over ``bound`` come back with again = true, unlinked."""
    dealt = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, [], False

        def batch(a: np.ndarray, b: np.ndarray, again: bool) -> pa.RecordBatch:
            extra = [pa.array(np.full(len(a), v, dtype=np.int64)) for v in (held_key or (0,) * len(key))]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), again)), *extra], names=["a", "b", "again", *key])

        def close() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held) if held else np.zeros(0, np.int64)
            if over:
                yield batch(fps, fps, True)
            elif len(fps) > 1:
                a, b = tiled_links(fps.view(np.uint64), radius)
                if len(a):
                    yield batch(fps[a], fps[b], False)

        for part in batches:
            if not part.num_rows:
                continue
            keys = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in key])
            fps = part.column("fp").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(fps)]])
            sizes = np.diff(starts)
            sizes[[0, -1]] += 1  # groups at a batch's ends may go on in its neighbours; other single ones have no pair
            for n in np.flatnonzero(sizes > 1):
                s, e = starts[n], starts[n + 1]
                own = tuple(keys[:, s].tolist())
                if own != held_key:
                    yield from close()
                    held_key, held, over = own, [], False
                held.append(fps[s:e])
                if bound and sum(map(len, held)) > bound:
                    over = True
                if over:
                    yield from close()
                    held = []
        yield from close()

    names = ", ".join(f"{k} long" for k in key)
    return dealt.mapInArrow(ending(run), f"a long, b long, again boolean, {names}")


def links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links between fingerprints of at most ``radius`` (up to 2) differing bits, enough to connect each group.

    Fingerprints meet in buckets of 32 equal bits; none of the pairs within the radius is missed, and work follows the
    input. The rows of a bucket of over BUCKET members are dealt anew by 16 more equal bits, so that no bucket has more
    than 65,536 members, however many fingerprints are alike.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four lanes of which two are equal cover a radius of up to 2")
    first = distinct_fps.select("fp", F.explode(_bit_keys(F.col("fp"), 0, 64, [])).alias("k")).select("fp", F.col("k.combo").cast("long").alias("combo"), F.col("k.x").alias("x"), F.col("k.y").alias("y"))
    found = materialize(_compare(first, ["combo", "x", "y"], radius, BUCKET), "links")
    again = found.where("again").select(F.col("a").alias("fp"), "combo", "x", "y")
    rest = F.lit(None).cast("long")
    for n, (a, b) in enumerate([(p, q) for p in range(4) for q in range(p + 1, 4)]):
        c, d = (k for k in range(4) if k not in (a, b))
        lane = lambda k: F.shiftright(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))
        rest = F.when(F.col("combo") == n, lane(c) + F.shiftleft(lane(d), 16)).otherwise(rest)
    more = again.withColumn("rest", rest).select("fp", "combo", "x", "y", F.explode(_bit_keys(F.col("rest"), 0, 32, [])).alias("k"))
    more = more.select("fp", "combo", "x", "y", F.col("k.combo").cast("long").alias("combo2"), F.col("k.x").alias("x2"), F.col("k.y").alias("y2"))
    deep = _compare(more, ["combo", "x", "y", "combo2", "x2", "y2"], radius, None)
    return found.where("not again").select("a", "b").union(deep.select("a", "b"))


def near_groups(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable); one row per input row.

    Equal fingerprints are one node, so a group of copies of any size costs one comparison. Texts without words have
    fingerprint 0 and link like others. Null ids never name a component unless all its ids are null; repeated rows and ids
    repeat in the result, texts of any length are hashed whole, other columns are not read, an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "nodes")
    parts = connected_components(links(nodes.select("fp"), radius), "a", "b")
    least = parts.join(nodes, parts["node"] == nodes["fp"]).groupBy("component").agg(F.min("first").alias("least"))
    moved = materialize(parts.join(least, "component").select(F.col("node").alias("fp"), "least"), "moved")
    of = materialize(nodes.join(moved, "fp", "left").select("fp", "rows", F.coalesce("least", "first").alias("component_id")), "of")
    return join_counted(fps, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, node) with first (without, doc_id, key): the first row, by id, of all whose nodes have the same component in ``parts`` (node, component); null ids come last."""
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("own"), F.count("*").alias("rows")), "nodes")
    least = parts.join(nodes, "node").groupBy("component").agg(F.min("own").alias("least"))
    moved = materialize(parts.join(least, "component").select("node", "least"), "moved")
    of = materialize(nodes.join(moved, "node", "left").select("node", "rows", F.coalesce("least", "own").alias("first")), "of")
    return join_counted(rows, of, "node").select("key", "doc_id", "node", "first")


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group of ``grouped`` (key, first): of equal rows, too, one stays."""
    key, nth = fresh(docs, "key"), fresh(docs, "nth")
    gone = materialize(grouped.where("key <> first.key").select(F.col("key").alias(key)).distinct(), "gone")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(gone.hint("merge"), key, "left_anti")  # as many keys as the corpus has copies
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return kept.where(F.col(nth) == 1).select(*docs.columns)


def drop_near_copies(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, with one row of each group, that of the least id, null ids last.

    Rows are told apart by id and text: an id that repeats with another text loses only the text that is a copy, and of
    equal rows one stays. Texts without words are one group; an empty table stays empty.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, keyed=True).withColumnRenamed("fp", "node"), "fps")
    grouped = first_of_groups(fps, connected_components(links(fps.select(F.col("node").alias("fp")).distinct(), radius), "a", "b"))
    return keep_first(docs, grouped, id_col, text_col)
