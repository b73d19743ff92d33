"""A z-fast trie of conversations, kept as tables.

Of the trie only compacted nodes are stored: branching points and ends of conversations. A node covers the depths from
its parent's (``p``, exclusive) to its own (``d``); its handle is the prefix at the two-fattest depth in between. A batch
of conversations finds its exit nodes by fat binary search, a join with the handles for each step; what lies beyond the
exits is added, and edges that are left in the middle are cut. At last edges are expanded to a node for each depth.

A prefix is known by its depth and the exclusive-or of 128-bit hashes of its turns and their places, so prefixes of a
conversation of any length are running values, which are taken within pieces of it and over the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.rows import Batches, ending
from sightline.plans.lineage import materialize

NOTHING = hashlib.sha256(b"").hexdigest()
#: Characters of a piece of a list of ids.
PIECE = 65_536
NODE = ["d", "k1", "k2"]
EDGE = ["conv", "p", "d"]


class Running(NamedTuple):
    """A running value: of a row's predecessors in its piece, of a whole piece, over pieces, and of both together."""

    of_row: Column
    of_piece: Column
    over: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def _sum(value: Column) -> Running:
    return Running(F.sum(value), F.sum(value), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def _xor(value: Column) -> Running:
    return Running(F.bit_xor(value), F.bit_xor(value), F.bit_xor, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))))


def _nearest(value: Column, place: Column) -> Running:
    """The value that is not null at this row or, going backwards, at the last one before."""
    last = lambda c: F.last(c, ignorenulls=True)
    return Running(last(value), F.min_by(value, F.when(value.isNotNull(), place)), last, F.coalesce)


def running(rows: DataFrame, order: list[str], backwards: bool = False, **values: Running) -> DataFrame:
    """``rows`` (conv, piece, ...) with running values along each conversation; pieces are in its order, and no task has more than a piece."""
    turned = F.desc if backwards else F.asc
    inside = Window.partitionBy("conv", "piece").orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy(turned("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv", "piece").agg(*(v.of_piece.alias(f"_{n}") for n, v in values.items()))
    pieces = pieces.select("conv", "piece", *(v.over(F.col(f"_{n}")).over(before).alias(f"_{n}") for n, v in values.items()))
    own = rows.withColumns({n: v.of_row.over(inside) for n, v in values.items()}).join(pieces, ["conv", "piece"])
    return own.select(*rows.columns, *(v.both(F.col(n), F.col(f"_{n}")).alias(n) for n, v in values.items()))


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, piece, pos (from 1), t (a turn's role and text, as 128 bits), bytes; a written table.

    Turns stand by their number, null first; those of one number by role and by MD5 of the text. Rows without a
    conversation's id take no part. Rows are dealt by ranges of that order, so a long conversation is in several pieces.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("digest"), turn.alias("t"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["turn", "role", "digest"]
    pieces = materialize(rows.where("conv is not null").repartitionByRange("conv", *order).withColumn("piece", F.spark_partition_id()), "turns")
    return materialize(running(pieces, order, pos=_sum(F.lit(1).cast("long"))).select("conv", "piece", "pos", "t", "bytes"), "numbered")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv, piece, d, t, bytes: the turns of rebuilt conversations; conv: all of them, even if turnless).

    Conversation c begins with the first h turns of c - c % ``family`` (all if fewer, none if absent), and goes on with its own after its
    first h; h is the CRC-32 of its decimal id modulo ``most``.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    each = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    of_base = each.select(F.col("conv").alias("base"), F.col("n").alias("lent"))
    convs = each.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": h}).join(of_base, "base", "left")
    convs = materialize(convs.select("conv", "base", "h", (F.col("h") - F.least("h", F.coalesce("lent", F.lit(0)))).alias("short")), "convs")
    own = turns.where(F.col("pos") > h).join(convs.select("conv", "short"), "conv").select("conv", "piece", (F.col("pos") - F.col("short")).alias("d"), "t", "bytes")
    first = turns.where((F.col("conv") % family == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), "pos", "t", "bytes")
    lent = first.join(convs, "base").where("pos <= h").select("conv", F.lit(-1).alias("piece"), F.col("pos").alias("d"), "t", "bytes")
    return own.unionByName(lent), convs.select("conv")


def _fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that is divisible by the greatest power of two."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(a.bitwiseXOR(b))) - 1)
    return b - b % power


def _at(prefixes: DataFrame, depth: str, *names: str) -> DataFrame:
    """conv, ``depth`` and the two halves of the prefix there, under the given names."""
    return prefixes.select("conv", F.col("d").alias(depth), F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))


class Trie:
    """Compacted nodes over the prefixes (conv, piece, d, k1, k2, q1, q2, bytes, upto; q of the prefix one turn shorter) of distinct conversations.

    ``nodes``: conv (one that passes), p, d, k1, k2, the handle f, f1, f2, and c1, c2, the prefix at p + 1.
    """

    def __init__(self, prefixes: DataFrame, deepest: int):
        self.prefixes, self.steps = prefixes, deepest.bit_length()
        self.nodes: DataFrame | None = None

    def _hashed(self, edges: DataFrame) -> DataFrame:
        """Edges (conv, p, d) as nodes: their prefixes, handles and first prefixes are looked up together."""
        depths = {"k": F.col("d"), "f": _fattest(F.col("p"), F.col("d")), "c": F.col("p") + 1}
        asked = F.array(*(F.struct(F.lit(what).alias("what"), at.alias("at")) for what, at in depths.items()))
        met = edges.select(*EDGE, F.inline(asked)).join(_at(self.prefixes, "at", "x1", "x2"), ["conv", "at"])
        pick = lambda what, col: F.max(F.when(F.col("what") == what, F.col(col)))
        return met.groupBy(*EDGE).agg(pick("f", "at").alias("f"), *(pick(w, f"x{n}").alias(f"{w}{n}") for w in "kfc" for n in (1, 2)))

    def _exits(self, batch: DataFrame) -> DataFrame:
        """conv, n, lcp, xconv, xp, xd: how far each conversation is in the trie, and the edge that it leaves, or ends in, if any."""
        none = F.lit(None).cast("long")
        at = batch.select("conv", "n", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), *(none.alias(f"g{c}") for c in ("conv", "p", "d", "1", "2")))
        if self.nodes is None:
            return at.select("conv", "n", F.col("a").alias("lcp"), *(F.col(f"g{c}").alias(f"x{c}") for c in ("conv", "p", "d")))
        handles = self.nodes.select("f", "f1", "f2", *(F.col(c).alias(f"h{n}") for c, n in (("conv", "conv"), ("p", "p"), ("d", "d"), ("k1", "1"), ("k2", "2"))))
        for _ in range(self.steps):  # fat binary search between the depths a and b
            going, hit = F.col("a") < F.col("b"), F.col("hconv").isNotNull()
            at = at.withColumn("f", F.when(going, _fattest(F.col("a"), F.col("b"))).otherwise(-1)).join(_at(self.prefixes, "f", "f1", "f2"), ["conv", "f"], "left")
            at = at.withColumns({"f1": F.coalesce("f1", "conv"), "f2": F.coalesce("f2", F.lit(0))}).join(handles, ["f", "f1", "f2"], "left")
            found = (F.when(hit, F.col(f"h{c}")).otherwise(F.col(f"g{c}")).alias(f"g{c}") for c in ("conv", "p", "d", "1", "2"))
            at = at.select("conv", "n", F.when(hit, F.col("hd")).otherwise(F.col("a")).alias("a"), F.when(going & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"), *found)
        # past the node that was found, the next turn tells the edge; else the conversation leaves its own edge
        at = at.withColumn("at", F.coalesce("gd", F.lit(0))).withColumn("next", F.col("at") + 1)
        at = at.join(_at(self.prefixes, "at", "e1", "e2"), ["conv", "at"], "left").join(_at(self.prefixes, "next", "c1", "c2"), ["conv", "next"], "left")
        past = (F.col("at") == 0) | F.coalesce((F.col("e1") == F.col("g1")) & (F.col("e2") == F.col("g2")), F.lit(False))
        at = at.withColumn("past", past).withColumn("wp", F.when(F.col("past") & F.col("c1").isNotNull(), F.col("at")).otherwise(-1))
        at = at.withColumns({"c1": F.coalesce("c1", "conv"), "c2": F.coalesce("c2", F.lit(0))})
        children = self.nodes.select(F.col("p").alias("wp"), "c1", "c2", F.col("conv").alias("wconv"), F.col("d").alias("wd"))
        at = at.join(children, ["wp", "c1", "c2"], "left")
        edge = (F.when(F.col("past"), F.when(F.col("wconv").isNotNull(), F.col(f"w{c}"))).otherwise(F.col(f"g{c}")).alias(f"x{c}") for c in ("conv", "p", "d"))
        located = materialize(at.select("conv", "n", F.when(F.col("past"), F.col("at")).otherwise(F.col("gp")).alias("low"), *edge), "located")
        own = located.where("xconv is not null").join(self.prefixes.select("conv", *NODE), "conv").where("d > xp and d <= least(xd, n)")
        common = own.join(self.prefixes.select(F.col("conv").alias("xconv"), *NODE), ["xconv", *NODE]).groupBy("conv").agg(F.max("d").alias("common"))
        return materialize(located.join(common, "conv", "left").select("conv", "n", F.coalesce("common", "low").alias("lcp"), "xconv", "xp", "xd"), "exits")

    def insert(self, batch: DataFrame) -> None:
        """Add the conversations (conv, n turns) of a batch, none of which is in the trie as it ends."""
        exits = self._exits(batch)
        beyond = materialize(exits.where("n > lcp").select("conv", "n", "lcp").join(self.prefixes.select("conv", *NODE, "q1", "q2"), "conv").where("d > lcp"), "beyond")
        seen = materialize(beyond.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.bool_or(F.col("d") == F.col("n")).alias("ends"), F.min("q1").alias("q1"), F.min("q2").alias("q2")), "seen")
        forks = seen.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("ways")).where("ways > 1")
        compact = seen.join(forks, NODE, "left").where("ends or ways is not null").select(*NODE, "owner")
        parent = F.lag("d").over(Window.partitionBy("conv").orderBy("d"))
        changed = beyond.join(compact, NODE).withColumn("p", F.coalesce(parent, "lcp")).where("conv = owner").select(*EDGE)
        if self.nodes is None:
            self.nodes = materialize(self._hashed(changed), "trie")
            return
        cuts = exits.where("xconv is not null and lcp < xd").select(F.col("xconv").alias("conv"), F.col("xp").alias("p"), F.col("xd").alias("top"), F.col("lcp").alias("d")).distinct()
        whole = cuts.select("conv", "p", "top", F.col("top").alias("d")).distinct()
        above = F.lag("d").over(Window.partitionBy("conv", "top").orderBy("d"))
        parts = cuts.union(whole).select("conv", F.coalesce(above, "p").alias("p"), "d")
        kept = self.nodes.join(whole.select("conv", "d"), ["conv", "d"], "left_anti")
        self.nodes = materialize(kept.unionByName(self._hashed(parts.union(changed))), "trie")


def _subtrees(nodes: DataFrame, **sums: Callable[[Column], Column]) -> DataFrame:
    """``nodes`` (id, up, ...) with each of the named columns folded over the node and all below it.

    Pointers double: after each round a node has the values of twice as many levels below, and points twice as far up.
    """
    folded = {n: {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.min: F.least}[f] for n, f in sums.items()}
    rest = [c for c in nodes.columns if c not in sums and c != "id"]
    now = materialize(nodes.select("id", F.col("up").alias("jump"), *sums), "sums")
    while not now.where("jump is not null").isEmpty():
        below = now.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(*(f(F.col(n)).alias(f"_{n}") for n, f in sums.items()))
        further = now.select(F.col("id").alias("jump"), F.col("jump").alias("then"))
        now = materialize(now.join(below, "id", "left").join(further, "jump", "left").select("id", F.col("then").alias("jump"), *(folded[n](F.col(n), F.col(f"_{n}")).alias(n) for n in sums)), "sums")
    return nodes.select("id", *rest).join(now.drop("jump"), "id")


def id_lists(ends: DataFrame) -> DataFrame:
    """d, k1, k2, sha: SHA-256 of the ids of the conversations (conv) that end there, ascending, comma-joined.

    Ids are joined to pieces where ranges of them lie; the pieces of a node are then hashed one after the other, so memory
    is bounded however many conversations are alike.
    """

    def pieces(batches: Batches) -> Batches:
        key, ids = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_pylist([dict(zip(NODE, key, strict=True), first=ids[0], ids=",".join(map(str, ids)))], schema=pa.schema([*((c, pa.int64()) for c in [*NODE, "first"]), ("ids", pa.string())]))

        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv"]), strict=True):
                if own != key or len(ids) * 8 >= PIECE:
                    yield from flush()
                    key, ids = own, []
                ids.append(conv)
        yield from flush()

    def hashed(batches: Batches) -> Batches:
        key, digest = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if key:
                yield pa.RecordBatch.from_pylist([dict(zip(NODE, key, strict=True), sha=digest.hexdigest())], schema=pa.schema([*((c, pa.int64()) for c in NODE), ("sha", pa.string())]))

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if own != key:
                    yield from flush()
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        yield from flush()

    ranges = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    joined = ranges.mapInArrow(ending(pieces), "d long, k1 long, k2 long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(ending(hashed), "d long, k1 long, k2 long, sha string")


def trie_nodes(turns: DataFrame, convs: DataFrame, batches: int = 2) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct sequence of first turns.

    ``turns``: conv, piece, d (from 1), t, bytes; ``convs``: conv, all conversations, turnless ones are members of the
    root. Equal conversations are one in the trie; the distinct ones are inserted in ``batches``. conv_id is the smallest
    member; saved_tokens sums, over a node's subtree, the bytes of each node's last turn for each member but one;
    ends_sha256 is of the ids of members that end at the node. No conversation: no rows.
    """
    spark = turns.sparkSession
    own = turns.withColumns({"x1": F.xxhash64("d", "t"), "x2": F.xxhash64(F.lit(1), "d", "t")})
    along = running(own, ["d"], k1=_xor(F.col("x1")), k2=_xor(F.col("x2")), upto=_sum(F.col("bytes")))
    every = materialize(along.select("conv", "piece", *NODE, F.col("k1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("q2"), "bytes", "upto"), "prefixes")
    last = every.groupBy("conv").agg(F.max_by(F.struct(*NODE), "d").alias("e"))
    ends = materialize(convs.join(last, "conv", "left").select("conv", *(F.coalesce(f"e.{c}", F.lit(0).cast("long")).alias(c) for c in NODE)), "ends")
    paths = materialize(ends.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n")), "paths")
    total, least, deepest = paths.agg(F.sum("n"), F.min("conv"), F.max("d")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not total:
        return spark.createDataFrame([], schema)
    lists = materialize(id_lists(ends), "lists")
    distinct = paths.where("d > 0").select("conv", F.col("d").alias("n"))
    prefixes = materialize(every.join(distinct.select("conv"), "conv", "left_semi"), "distinct")
    trie = Trie(prefixes, deepest)
    for k in range(batches):
        trie.insert(distinct.where(F.pmod(F.xxhash64("conv"), F.lit(batches)) == k))

    # values of compacted nodes; the root is apart
    one = lambda *c: F.struct(*(F.col(x).alias(n) for x, n in zip(c, NODE, strict=True)))
    edges = trie.nodes.select(*EDGE, "k1", "k2").join(_at(prefixes, "p", "u1", "u2"), ["conv", "p"], "left")
    edges = edges.join(prefixes.select("conv", "d", "upto"), ["conv", "d"]).join(prefixes.select("conv", F.col("d").alias("p"), F.col("upto").alias("before")), ["conv", "p"], "left")
    edges = edges.select(*EDGE, one(*NODE).alias("id"), F.when(F.col("p") > 0, one("p", "u1", "u2")).alias("up"), F.coalesce("before", F.lit(0)).alias("before"), "upto")
    edges = materialize(edges, "edges")
    children = edges.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("children"))
    members = paths.select(one(*NODE).alias("id"), F.col("n").alias("own"), F.col("conv").alias("first"))
    valued = edges.join(children, "id", "left").join(members, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    valued = valued.withColumns({"n": F.coalesce("own", F.lit(0)), "least": F.col("first"), "leaves": (F.col("children") == 0).cast("long")})
    counted = materialize(_subtrees(valued.drop("own", "first"), n=F.sum, least=F.min, leaves=F.sum), "counted")
    weighed = counted.withColumn("edge", (F.col("n") - 1) * (F.col("upto") - F.col("before"))).withColumn("saved", F.col("edge"))
    saved = _subtrees(weighed, saved=F.sum)
    above = counted.select(F.col("id").alias("up"), F.col("least").alias("above"))
    hashes = lists.select(one(*NODE).alias("id"), "sha")
    stats = materialize(saved.join(above, "up", "left").join(hashes, "id", "left"), "stats")

    # edges expanded: each prefix of a node's own conversation belongs to the node that comes next on it, if it is in its edge
    node = F.struct("p", "d", "n", "least", "children", "leaves", (F.col("saved") - F.col("edge")).alias("below"), "upto", F.coalesce("above", F.lit(least)).alias("above"), F.coalesce("sha", F.lit(NOTHING)).alias("sha"))
    marked = prefixes.select("conv", "piece", "d", "bytes", "upto").join(stats.select("conv", "d", node.alias("node")), ["conv", "d"], "left")
    spread = running(marked, ["d"], backwards=True, of=_nearest(F.col("node"), F.col("d"))).where("of.p < d")
    top, end = F.col("d") == F.col("of.p") + 1, F.col("d") == F.col("of.d")
    out = spread.select(
        F.col("of.least").alias("conv_id"), F.col("d").alias("depth"), F.when(top, F.col("of.above")).otherwise(F.col("of.least")).alias("parent_conv_id"), F.col("of.n").alias("n_convs"),
        F.when(end, F.col("of.children")).otherwise(1).alias("n_children"), F.col("of.leaves").alias("n_leaves"),
        (F.col("of.below") + (F.col("of.n") - 1) * (F.col("of.upto") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"), F.when(end, F.col("of.sha")).otherwise(NOTHING).alias("ends_sha256"),
    )
    root = stats.where("p = 0").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    turnless = lists.where("d = 0").agg(F.coalesce(F.max("sha"), F.lit(NOTHING)).alias("ends_sha256")).first()[0]
    root = root.select(F.lit(least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(turnless).alias("ends_sha256"))
    return out.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in root.columns)).unionByName(root)


def prefix_trie(conversations: DataFrame, batches: int = 2) -> DataFrame:
    """``trie_nodes`` of the rebuilt conversations (conv_id, turn, role, text).

    A null role or text counts as empty; turns without a number come first, turns of one number stand by role and MD5 of
    the text, repeated rows are turns of their own; rows without a conv_id take no part; texts of any length count whole,
    other columns are not read, an empty table gives no rows.
    """
    turns, convs = rebuilt(numbered(conversations))
    return trie_nodes(turns, convs, batches)
