"""Choosing operating points and models: sweeps of gate settings, weighted selection, rankings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import evaluation as ev
from sightline.operators import gate
from sightline.plans.lineage import materialize

WEIGHTS = {"map_50_95": 0.45, "map_50": 0.2, "f1": 0.2, "speed": 0.15}


def replay(cands: DataFrame, classes: DataFrame, decode_floor: float, cfg: gate.GateConfig = gate.GateConfig()) -> DataFrame:
    """Every candidate through the gate at one operating point, those under the decode floor with that as their reason."""
    gated = gate.cascade(cands.where(F.col("score") >= decode_floor), classes, cfg)
    below = cands.where(~F.coalesce(F.col("score") >= decode_floor, F.lit(False))).select("image_id", "det_id", "class_id", "score", F.lit("below_decode_floor").alias("drop_reason"))
    return gated.select("image_id", "det_id", "class_id", "score", "x1", "y1", "x2", "y2", "drop_reason", "demoted_from").unionByName(below, allowMissingColumns=True)


def accounting(replayed: DataFrame) -> DataFrame:
    """One row: raw, below_floor, by_gate, asserted, unknown, unknown_rate, images and detections per image."""
    ok = F.col("drop_reason").isNull()
    n = replayed.agg(
        F.count("*").alias("raw"), F.count_if(F.col("drop_reason") == "below_decode_floor").alias("below_floor"), F.count_if(~ok & (F.col("drop_reason") != "below_decode_floor")).alias("by_gate"),
        F.count_if(ok & (F.col("class_id") != gate.UNKNOWN)).alias("asserted"), F.count_if(ok & (F.col("class_id") == gate.UNKNOWN)).alias("unknown"), F.count_distinct("image_id").alias("images"),
    )
    total = F.col("asserted") + F.col("unknown")
    return n.withColumn("unknown_rate", F.coalesce(F.try_divide("unknown", total), F.lit(0.0))).withColumn("per_image", total / F.greatest("images", F.lit(1)))


def point_score(f1: Column, map_50: Column, fp_per_image: Column, unknown_rate: Column, precision: Column, recall: Column, min_precision: float = 0.0, min_recall: float = 0.0, max_fp: float | None = None) -> Column:
    """Rank of an operating point; null if it breaks a constraint."""
    bad = (precision < min_precision) | (recall < min_recall)
    if max_fp is not None:
        bad = bad | (fp_per_image > max_fp)
    return F.when(~bad, 0.60 * f1 + 0.40 * F.coalesce(map_50, F.lit(0.0)) - 0.02 * fp_per_image - 0.05 * F.coalesce(unknown_rate, F.lit(0.0)))


def _truncated_ap(marked: DataFrame, support: DataFrame, n_cuts: Column) -> DataFrame:
    """class_id, k, area: for each of a class's cuts the sum of the precision envelope over the hits down to it.

    ``part`` counts the cuts above a score, so a cut k keeps the parts up to k. Within its part a hit has one envelope for
    all cuts; what a cut adds is the best precision of the parts in between. So hits are counted by part and envelope,
    which the curve has few of, and only these are multiplied by the cuts.
    """
    curve = ev.precision_curve(marked, "part")
    best = curve.groupBy("class_id", "part").agg(F.max("precision").alias("best"))
    steps = curve.where("tp = 1").groupBy("class_id", "part", "envelope").agg(F.count("*").alias("n"))
    cuts = support.select("class_id", F.explode(F.sequence(F.lit(0), n_cuts - 1)).alias("k"))
    between = best.select("class_id", F.col("part").alias("p"), "best").join(cuts, "class_id").where("p <= k")
    reach = cuts.withColumnRenamed("k", "part").join(between, "class_id").where("p > part").groupBy("class_id", "part", "k").agg(F.max("best").alias("later"))
    each = steps.join(cuts, "class_id").where("part <= k").join(reach, ["class_id", "part", "k"], "left")
    return each.groupBy("class_id", "k").agg(F.sum(F.col("n") * F.greatest("envelope", F.coalesce("later", F.lit(0.0)))).alias("area"))


def sweep(gts: DataFrame, cands: DataFrame, classes: DataFrame, decode_floors: Sequence[float], unknown_floors: Sequence[float], strictness: Sequence[float], cached_floor: float = 0.0, cfg: gate.GateConfig = gate.GateConfig()) -> DataFrame:
    """decode, unknown, strict, precision, recall, f1, map_50, fp_per_image, unknown_rate, score of every grid point.

    Suppression, claims and matching all take boxes by falling score, so leaving out low scores changes nothing above
    them: they run once, at the lowest decode floor, and every point is a cut through each class's scores, at its
    threshold times the strictness or the floor. Rows are counted between the cuts, and points read from the counts: no
    row is multiplied by the grid. Floors under the cached one are refused.
    """
    if min(decode_floors) < cached_floor - 1e-9:
        raise ValueError(f"decode floor {min(decode_floors)} is below the floor {cached_floor} that candidates were kept at")
    good = gate.sanitise(cands.where(F.col("score") >= min(decode_floors)), cfg).where("drop_reason is null").drop("drop_reason")
    kept = gate.resolve_claims(gate.nms_per_class(good, cfg.nms_iou), cfg)
    dim = classes.select("class_id", "ar_lo", "ar_hi", "area_lo", "area_hi", "min_conf")
    rows = materialize(kept.join(dim, "class_id", "left").where(gate.plausibility_reason(cfg).isNull()), "sweep")
    images = cands.select("image_id").distinct()
    truth = materialize(gts.join(images, "image_id", "left_semi"), "sweep")
    # the cuts of each class, falling; at most a grid's worth
    sure = lambda d, s: F.greatest(F.lit(float(d)), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("base") * float(s))))
    maybe = lambda d, u: F.lit(float(max(d, u)))
    both = rows.select("class_id").union(truth.select("class_id")).distinct()
    base = both.join(classes.select("class_id", "min_conf"), "class_id", "left").withColumn("base", F.coalesce("min_conf", F.lit(cfg.default_threshold)))
    every = [*(sure(d, s) for d in decode_floors for s in strictness), *(maybe(d, u) for d in decode_floors for u in unknown_floors)]
    cuts = materialize(base.select("class_id", "base", F.reverse(F.array_sort(F.array_distinct(F.array(*every)))).alias("cuts")), "sweep")
    above = lambda score: F.size(F.filter("cuts", lambda c: c > score))

    m = ev.match(truth, rows.select("image_id", "det_id", "class_id", "score", "x1", "y1", "x2", "y2"))
    marked = materialize(m.join(cuts, "class_id").withColumn("part", above(F.col("score"))).where(F.col("part") < F.size("cuts")).drop("base", "cuts"), "sweep")
    support = truth.groupBy("class_id").agg(F.count("*").alias("support"))
    area = materialize(_truncated_ap(marked, cuts, F.size("cuts")), "sweep")
    counts = marked.groupBy("class_id", "part").agg(F.count("gt_id").alias("hit"), F.count("*").alias("n"))
    ks = cuts.select("class_id", F.explode(F.sequence(F.lit(0), F.size("cuts") - 1)).alias("k"))
    upto = materialize(ks.join(counts, "class_id", "left").where("part is null or part <= k").groupBy("class_id", "k").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "sweep")

    points = [F.struct(F.lit(float(d)).alias("decode"), F.lit(float(u)).alias("unknown"), F.lit(float(s)).alias("strict"), sure(d, s).alias("sure"), maybe(d, u).alias("maybe")) for d in decode_floors for u in unknown_floors for s in strictness]
    at = cuts.select("class_id", "cuts", F.inline(F.array(*points))).withColumn("k", above(F.col("sure"))).withColumn("j", above(F.col("maybe"))).drop("cuts", "sure", "maybe")
    low = upto.select("class_id", F.col("k").alias("j"), F.col("n").alias("n_low"))
    at = at.join(upto, ["class_id", "k"], "left").join(low, ["class_id", "j"], "left").join(area, ["class_id", "k"], "left").join(support, "class_id", "left").fillna(0, ["tp", "n", "n_low"])
    sums = at.groupBy("decode", "unknown", "strict").agg(
        F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.sum(F.greatest(F.lit(0), F.col("n_low") - F.col("n"))).alias("n_unknown"), F.sum(F.coalesce("support", F.lit(0))).alias("n_gt"),
        F.avg(F.when(F.col("support") > 0, F.coalesce("area", F.lit(0.0)) / F.col("support"))).alias("map_50"),
    )
    out = sums.withColumns(ev.rates(F.col("tp"), F.col("n") - F.col("tp"), F.col("n_gt") - F.col("tp"))).withColumn("fp_per_image", (F.col("n") - F.col("tp")) / max(1, images.count()))
    out = out.withColumn("unknown_rate", F.coalesce(F.try_divide("n_unknown", F.col("n") + F.col("n_unknown")), F.lit(0.0)))
    score = point_score(F.col("f1"), F.col("map_50"), F.col("fp_per_image"), F.col("unknown_rate"), F.col("precision"), F.col("recall"))
    return out.select("decode", "unknown", "strict", "precision", "recall", "f1", "map_50", "fp_per_image", "unknown_rate", score.alias("score"))


def best_point(points: DataFrame) -> DataFrame:
    """The eligible point of the best score; of equals the higher floors, then the strictness nearest to 1."""
    rank = F.struct("score", "decode", "unknown", (-F.abs(F.col("strict") - 1)).alias("s"))
    return points.where("score is not null").agg(F.max_by(F.struct(*points.columns), rank).alias("b")).select("b.*")


def refine_thresholds(base: DataFrame, gts: DataFrame, preds: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, min_conf, adopted: the threshold of best F1 where it ranks above the present one, else the present one."""
    best = ev.best_thresholds(gts, preds)
    out = classes.select("class_id", "min_conf").join(best.select("class_id", "threshold", F.col("f1").alias("new_f1")), "class_id", "left").join(base.select("class_id", F.col("f1").alias("old_f1")), "class_id", "left")
    better = F.coalesce(F.col("new_f1") > F.coalesce("old_f1", F.lit(0.0)), F.lit(False))
    return out.select("class_id", F.when(better, F.col("threshold")).otherwise(F.col("min_conf")).alias("min_conf"), better.alias("adopted"))


def speed_score(latency: Column, budget: float, floor: float = 10.0) -> Column:
    """1 at the floor or under, 0 at the budget, linear in the logarithm between; null without a latency."""
    return F.when(latency.isNull() | (latency <= 0), None).when(latency <= floor, 1.0).when(latency >= budget, 0.0).otherwise(1.0 - F.log(latency / floor) / math.log(budget / floor))


def select_model(evals: DataFrame, profiles: DataFrame, budget: float, least_map: float = 0.0, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """label, score, disqualified, place: accuracy and speed weighed; a model without timing is scored on accuracy alone.

    A model that misses the latency budget or the accuracy floor is out, whatever its score.
    """
    rows = evals.join(profiles.select("label", "latency"), "label", "left")
    w = {k: v / sum(weights.values()) for k, v in weights.items()}
    speed = speed_score(F.col("latency"), budget)
    accuracy = w["map_50_95"] * F.col("map_50_95") + w["map_50"] * F.col("map_50") + w["f1"] * F.col("f1")
    out = F.when(F.col("map_50_95") < least_map, "accuracy_floor").when(F.col("latency") > budget, "latency_budget")
    score = F.when(speed.isNull(), accuracy / (1 - w["speed"])).otherwise(accuracy + w["speed"] * speed)
    rows = rows.withColumn("disqualified", out).withColumn("score", F.when(F.col("disqualified").isNull(), score))
    from pyspark.sql import Window

    place = F.when(F.col("score").isNotNull(), F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "label")))
    return rows.select("label", "score", "disqualified", place.alias("place"))


def domain_gap(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """label, synthetic, real, gap, verdict of mAP scores measured on both."""
    both = synthetic.select("label", F.col("map_50").alias("synthetic")).join(real.select("label", F.col("map_50").alias("real")), "label", "full_outer").withColumn("gap", F.col("synthetic") - F.col("real"))
    verdict = F.when(F.col("real").isNull(), "no_real_evaluation").when(F.col("synthetic").isNull(), "no_synthetic_evaluation").when(F.col("gap") <= 0.05, "small").when(F.col("gap") >= 0.5, "meaningless").otherwise("substantial")
    return both.withColumn("verdict", verdict)


def rank_strategies(results: DataFrame, control: str = "real_only", noise: float = 0.02) -> DataFrame:
    """strategy, place, helped: whether the winner beats the control by more than noise, on the difference as printed (4 digits)."""
    from pyspark.sql import Window

    rows = results.where("map_50 is not null").withColumn("place", F.row_number().over(Window.orderBy(F.desc("map_50"), F.desc("map_50_95"), "strategy")))
    base = rows.where(F.col("strategy") == control).select(F.col("map_50").alias("c"))
    helped = (F.col("place") == 1) & (F.col("strategy") != control) & (F.round(F.col("map_50") - F.col("c"), 4) > noise)
    return rows.join(F.broadcast(base), how="left").select("strategy", "map_50", "place", F.coalesce(helped, F.lit(False)).alias("helped"))


def variant(cfg: gate.GateConfig, **changes) -> gate.GateConfig:
    return replace(cfg, **changes)
