"""Matching of vectors to known identities, and open-set evaluation of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sightline.plans.lineage import materialize

UNKNOWN = "__unknown__"
#: Galleries of up to so many bytes go to every executor; a larger one is dealt in blocks.
BROADCAST_BYTES = 64 << 20
BLOCK = 4_096
#: Rows that a task compares with a block at a time.
STRIP = 256
#: By how much a product of matrices may misjudge a cosine, at most; pairs whose cosine is summed anew at a time.
SLACK, EXACT = 1e-9, 65_536
#: Up to so many digits a task has a counter for each score.
COUNTED_DIGITS = 5

#: Ids of some rows and of a block's, which of them are pairs, which of one identity, and their cosines.
Tiles = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector scaled to length 1; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has the right length and is not zero."""
    v = F.col(vec)
    return df.where((F.size(v) == dim) & (dot(v, v) > 0))


def centroids(gallery: DataFrame, identity: str, vec: str) -> DataFrame:
    """identity, vec: mean of the unit vectors of each identity, at length 1. Sums are kept by position, never vectors."""
    parts = gallery.where(F.col(identity).isNotNull()).select(F.col(identity).alias("__i"), F.posexplode(unit(F.col(vec))))
    means = parts.groupBy("__i", "pos").agg(F.avg("col").alias("m"))
    whole = means.groupBy("__i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))
    return whole.select(F.col("__i").alias(identity), unit(F.col("v")).alias(vec))


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    if not len(m):
        return m.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _ordered(identities: pd.Series, numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distinct identities in the order of their type, nulls last, position among them of each row)."""
    at, names = pd.factorize(identities, use_na_sentinel=False)
    keys = [(v is None, (int(v) if numbers else v) if v is not None else 0) for v in names]
    order = np.array(sorted(range(len(names)), key=keys.__getitem__), dtype=np.int64)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return np.asarray(names, dtype=object)[order], place[at]


def best_of_block(probes: pd.DataFrame, block: pd.DataFrame, k: int, numbers: bool) -> Iterator[pd.DataFrame]:
    """probe, identity, score: the k best identities of a block of vectors (identity, gvec) for each probe (probe, pvec), STRIP probes at a time.

    A matrix product finds who may be among them. Their scores are then summed vector by vector, always in one order:
    equal vectors tie whatever block they are in.
    """
    if not len(probes) or not len(block):
        return
    names, at = _ordered(block["identity"], numbers)
    order = np.argsort(at, kind="stable")
    at, g = at[order], _matrix(block["gvec"])[order]
    starts, least = np.searchsorted(at, np.arange(len(names))), min(k, len(names))
    for n in range(0, len(probes), STRIP):
        own = probes.iloc[n : n + STRIP]
        p = _matrix(own["pvec"])
        sims = p @ g.T
        sims[np.isnan(sims)] = -2.0
        most = np.maximum.reduceat(sims, starts, axis=1)
        rows, cols = np.nonzero(sims >= np.partition(most, -least, axis=1)[:, -least, None] - SLACK)
        score = np.concatenate([(p[rows[i : i + EXACT]] * g[cols[i : i + EXACT]]).sum(axis=1) for i in range(0, len(rows), EXACT)])
        first = np.flatnonzero(np.diff(rows * len(names) + at[cols], prepend=-1))
        row, name, score = rows[first], at[cols[first]], np.maximum.reduceat(score, first)
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pd.DataFrame({"probe": own["probe"].to_numpy()[row[kept]], "identity": names[name[kept]], "score": score[kept]})


def in_blocks(gallery: DataFrame, blocks: int) -> DataFrame:
    """The distinct rows (identity, gvec) of a gallery with their block b: the vectors of one identity are in many."""
    return gallery.distinct().withColumn("b", F.pmod(F.xxhash64("identity", "gvec"), F.lit(blocks)))


def nearest(probes: DataFrame, gallery: DataFrame, probe_id: str, identity: str, vec: str, k: int = 2) -> DataFrame:
    """probe_id, rank, identity, score: the k identities of the best cosine for each probe (the best vector of each).

    The gallery is cut into blocks of BLOCK vectors. If it is small (checked by its row count and length) it goes whole
    to every executor, else it is dealt, an identity's vectors to any block, and probes meet one block after another. Each
    task keeps k candidates of a probe and block only, so what is shuffled is probes * blocks * k. Ties by identity.
    """
    n = gallery.count()
    width = gallery.select(F.max(F.size(vec))).first()[0] or 1
    numbers = isinstance(gallery.schema[identity].dataType, IntegralType)
    g = gallery.select(F.col(identity).cast("string").alias("identity"), F.col(vec).alias("gvec"))
    schema = "probe string, identity string, score double"
    p = probes.select(F.col(probe_id).cast("string").alias("probe"), F.col(vec).alias("pvec"))
    if n * (width * 8 + 64) <= BROADCAST_BYTES:
        held = probes.sparkSession.sparkContext.broadcast(g.toPandas())

        def of_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for own in parts:
                for at in range(0, len(held.value), BLOCK):
                    yield from best_of_block(own, held.value.iloc[at : at + BLOCK], k, numbers)

        found = p.mapInPandas(of_all, schema)
    else:
        blocks, asking = -(-n // BLOCK), max(1, -(-probes.count() // (8 * BLOCK)))
        dealt = in_blocks(g, blocks).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asking - 1)))).withColumn("a", F.col("a").cast("long"))
        asked = p.withColumn("a", F.pmod(F.xxhash64("probe"), F.lit(asking))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("b", F.col("b").cast("long"))
        found = asked.groupBy("a", "b").cogroup(dealt.groupBy("a", "b")).applyInPandas(lambda a, b: pd.concat([pd.DataFrame({"probe": [], "identity": [], "score": []}), *best_of_block(a, b, k, numbers)]), schema)
    each = found.groupBy("probe", "identity").agg(F.max("score").alias("score"))
    each = each.select(F.col("probe").cast(probes.schema[probe_id].dataType).alias(probe_id), F.col("identity").cast(gallery.schema[identity].dataType).alias(identity), "score")
    w = Window.partitionBy(probe_id).orderBy(F.desc("score"), F.asc_nulls_last(identity))
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(probe_id, "rank", identity, "score")


def decide(ranked: DataFrame, probe_id: str, identity: str, threshold: float, margin: float) -> DataFrame:
    """probe_id, closest, similarity, margin, accepted: the best identity if it is near enough and clear of the next."""
    w = Window.partitionBy(probe_id).orderBy("rank")
    rows = ranked.withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(-1.0))).where("rank = 1")
    ok = (F.col("score") >= threshold) & (F.col("margin") >= margin)
    return rows.select(probe_id, F.col(identity).alias("closest"), F.col("score").alias("similarity"), "margin", F.when(ok, F.col(identity)).alias("accepted"))


def open_set(decided: DataFrame, truth: DataFrame, enrolled: DataFrame, probe_id: str, identity: str) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, FAR and FRR. A probe whose identity isn't enrolled is a stranger."""
    known = enrolled.select(F.col(identity).cast("string").alias("t")).distinct()
    rows = truth.select(probe_id, F.col(identity).cast("string").alias("t0")).join(known, F.col("t0") == F.col("t"), "left").join(decided.select(probe_id, F.col("accepted").cast("string").alias("p")), probe_id, "left")
    pairs = rows.select(F.coalesce("t", F.lit(UNKNOWN)).alias("t"), F.coalesce("p", F.lit(UNKNOWN)).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "confusion")
    hit = pairs.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("tp"))
    labels = known.select(F.col("t").alias("label")).unionByName(pairs.limit(1).select(F.lit(UNKNOWN).alias("label"))).distinct()
    per = labels.join(hit, "label", "left").join(pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("nt")), "label", "left").join(pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("np")), "label", "left").fillna(0, ["tp", "nt", "np"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.withColumn("pr", zero(F.try_divide("tp", "np"))).withColumn("re", zero(F.try_divide("tp", "nt"))).withColumn("f", zero(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re"))))
    macro = per.agg(F.avg("pr").alias("precision_macro"), F.avg("re").alias("recall_macro"), F.avg("f").alias("f1_macro"))
    stranger, same = F.col("t") == UNKNOWN, F.col("t") == F.col("p")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rates = pairs.agg(F.sum("n").alias("n_probes"), total(~stranger).alias("n_known"), (total(same) / F.sum("n")).alias("accuracy"), F.try_divide(total(stranger & ~same), total(stranger)).alias("far"), F.try_divide(total(~stranger & ~same), total(~stranger)).alias("frr"))
    return rates.join(macro)


def _by_blocks(df: DataFrame, row_id: str, identity: str, vec: str, compare: Callable[[Tiles], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """Rows are dealt to blocks of about ``block`` by hash, and pairs of blocks meet as groups; ``compare`` gets the tiles of two blocks."""
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(identity).cast("string").alias("who"), F.col(vec).alias("v"))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sent = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "who", "v")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pair_tiles(pdf[pdf["b"] == key[0]], pdf[pdf["b"] == key[1]], key[0] == key[1]))

    return sent.groupBy("i", "j").applyInPandas(meet, schema)


def pair_tiles(left: pd.DataFrame, right: pd.DataFrame, own: bool) -> Tiles:
    """Tiles of two blocks of rows (id, who, v), or of one with itself: STRIP rows against a block at a time.

    Rows without an identity are of nobody's, each other's neither.
    """
    if not len(left) or not len(right):
        return
    who, _ = pd.factorize(pd.concat([left["who"], right["who"]]))
    x, y, ids, others = _matrix(left["v"]), _matrix(right["v"]), left["id"].to_numpy(), right["id"].to_numpy()
    mine, theirs = who[: len(left)], who[len(left) :]
    for at in range(0, len(x), STRIP):
        cut = slice(at, at + STRIP)
        sims = x[cut] @ y.T
        pair = ~np.isnan(sims)
        if own:
            pair &= ids[cut, None] < others[None]
        yield ids[cut], others, pair, (mine[cut, None] == theirs[None]) & (mine[cut, None] >= 0), sims


def pair_scores(df: DataFrame, row_id: str, identity: str, vec: str) -> DataFrame:
    """kind (genuine or impostor), a, b, s: cosine of every unordered pair, for a bounded evaluation set.

    ``pair_counts`` gives what rates and curves need without a row for each pair.
    """

    def rows(tiles: Tiles) -> pd.DataFrame:
        parts = [pd.DataFrame({"kind": [], "a": [], "b": [], "s": []})]
        for ids, others, pair, same, sims in tiles:
            at, then = np.nonzero(pair)
            parts.append(pd.DataFrame({"kind": np.where(same[pair], "genuine", "impostor"), "a": np.minimum(ids[at], others[then]), "b": np.maximum(ids[at], others[then]), "s": sims[pair]}))
        return pd.concat(parts)

    return _by_blocks(df, row_id, identity, vec, rows, "kind string, a long, b long, s double", 4 * STRIP)


def count_tiles(tiles: Tiles, digits: int) -> pd.DataFrame:
    """kind, s, n of the pairs of some tiles; what is held is a count for each score, not the pairs."""
    scale = 10**digits
    total, parts = np.zeros(2 * (2 * scale + 1) if digits <= COUNTED_DIGITS else 0, dtype=np.int64), []
    for _, _, pair, same, sims in tiles:
        code = ((np.rint(sims[pair] * scale).astype(np.int64) + scale) << 1) + same[pair]
        if len(total):
            total += np.bincount(code, minlength=len(total))
        else:
            parts.append(np.stack(np.unique(code, return_counts=True)))
    at = np.flatnonzero(total)
    code, n = np.concatenate([np.stack([at, total[at]]), *parts], axis=1)
    return pd.DataFrame({"kind": np.where(code & 1, "genuine", "impostor"), "s": ((code >> 1) - scale) / scale, "n": n})


def pair_counts(df: DataFrame, row_id: str, identity: str, vec: str, digits: int = 5) -> DataFrame:
    """kind, s (cosine to ``digits`` digits), n: how many unordered pairs have it, as a written table.

    Each pair of blocks is counted in its task, a strip at a time, so a task's memory doesn't grow with the table; its
    time does with the square, as all pairs are compared.
    """
    block = BLOCK if digits <= COUNTED_DIGITS else 4 * STRIP
    found = _by_blocks(df, row_id, identity, vec, lambda tiles: count_tiles(tiles, digits), "kind string, s double, n long", block)
    return materialize(found.groupBy("kind", "s").agg(F.sum("n").alias("n")), "scores")


def _by_score(scores: DataFrame, kind: str, s: str) -> DataFrame:
    """s, g, i: genuine and impostor pairs of each score; rows count once, or as often as their column n says."""
    n = F.col("n") if "n" in scores.columns else F.lit(1)
    of = lambda name: F.sum(F.when(F.col(kind) == name, n).otherwise(0))
    return scores.groupBy(F.col(s).alias("s")).agg(of("genuine").alias("g"), of("impostor").alias("i"))


def roc(scores: DataFrame, kind: str = "kind", s: str = "s") -> DataFrame:
    """s, tpr, fpr at each distinct score from the top. Counts by score are summed first; ranges of score keep windows small."""
    by = _by_score(scores, kind, s).withColumn("__b", F.floor(F.col("s") * 512).cast("long"))
    inside = Window.partitionBy("__b").orderBy(F.desc("s"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("__b").agg(F.sum("g").alias("g"), F.sum("i").alias("i"))
    total = sums.agg(F.sum("g").alias("tg"), F.sum("i").alias("ti"))
    offsets = sums.select("__b", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum("i").over(before), F.lit(0)).alias("i0"))
    rows = by.join(offsets, "__b").join(F.broadcast(total))
    return rows.select("s", ((F.col("g0") + F.sum("g").over(inside)) / F.col("tg")).alias("tpr"), ((F.col("i0") + F.sum("i").over(inside)) / F.col("ti")).alias("fpr"))


def auc_eer(scores: DataFrame, kind: str = "kind", s: str = "s") -> DataFrame:
    """auc, eer, eer_threshold. AUC counts pairs in the right order, ties by half, which is the area by trapezoids."""
    points = materialize(roc(scores, kind, s), "roc")
    by = _by_score(scores, kind, s)
    total = by.agg(F.sum("g").alias("tg"), F.sum("i").alias("ti"))
    area = by.join(points, "s").join(F.broadcast(total)).agg(F.sum((F.col("g") / F.col("tg")) * (1 - F.col("fpr") + F.col("i") / F.col("ti") / 2)).alias("auc"))
    gap = F.struct(F.abs(F.col("fpr") - (1 - F.col("tpr"))).alias("d"), (-F.col("s")).alias("s"))
    cross = points.agg(F.min_by(F.struct(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer"), F.col("s").alias("eer_threshold")), gap).alias("m"))
    return area.join(cross.select("m.eer", "m.eer_threshold"))


def far_frr(scores: DataFrame, threshold: float, kind: str = "kind", s: str = "s") -> DataFrame:
    """far: share of impostor pairs at the threshold or above; frr: of genuine pairs below it."""
    by = _by_score(scores, kind, s)
    share = lambda n, hit: F.try_divide(F.sum(F.when(hit, F.col(n)).otherwise(0)), F.sum(n))
    return by.agg(share("i", F.col("s") >= threshold).alias("far"), share("g", F.col("s") < threshold).alias("frr"))


def split_gallery(df: DataFrame, identity: str, row_id: str, n: int) -> DataFrame:
    """Adds part: the first ``n`` rows of an identity are gallery, the rest probes."""
    w = Window.partitionBy(identity).orderBy(row_id)
    return df.withColumn("part", F.when(F.row_number().over(w) <= n, "gallery").otherwise("probe"))


def match_confidence(score: Column, threshold: float) -> Column:
    """How far above the threshold a score is, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - threshold) / max(1e-9, 1 - threshold)))
