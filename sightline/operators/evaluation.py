"""Detection evaluation: greedy matching, precision and recall, average precision, confusion, threshold grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.plans.lineage import materialize

COCO_IOUS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
BACKGROUND = "__background__"
#: Ranges of score that a running sum is computed over, each on its own.
BUCKETS = 1_024


def overlaps(gts: DataFrame, preds: DataFrame, least: float, same_class: bool = True) -> DataFrame:
    """image_id, class_id (of the prediction), det_id, gt_id, gt_class, iou: pairs of a frame of at least that overlap."""
    t = gts.select("image_id", "gt_id", F.col("class_id").alias("gt_class"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    near = preds.join(t.withColumnRenamed("image_id", "__image"), _on(same_class)).withColumn("iou", g.iou(g.box(), g.box("g")))
    return near.where(F.col("iou") >= least).select("image_id", "class_id", "det_id", "gt_id", "gt_class", "iou")


def _on(same_class: bool) -> Column:
    same = F.col("image_id") == F.col("__image")
    return same & (F.col("class_id") == F.col("gt_class")) if same_class else same


def match(gts: DataFrame, preds: DataFrame, ious: Sequence[float] = (0.5,), same_class: bool = True) -> DataFrame:
    """thr, image_id, det_id, class_id, score, gt_id, gt_class: each prediction with the box it is matched to (null: none).

    In a frame (and class, if ``same_class``) predictions are taken by score, each gets the free ground truth of the
    highest overlap, at least the threshold; of equal overlaps the last. The pairs are found once for all thresholds.
    """
    each = match_each(gts, preds, ious, same_class)
    all_of = each.withColumn("m", F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.col("found")[k].alias("f")) for k, t in enumerate(ious)])))
    return all_of.select(F.col("m.thr").alias("thr"), "image_id", "det_id", "class_id", "score", F.col("m.f.g").alias("gt_id"), F.col("m.f.c").alias("gt_class"))


def match_each(gts: DataFrame, preds: DataFrame, ious: Sequence[float], same_class: bool = True) -> DataFrame:
    """image_id, det_id, class_id, score, found: ``match`` in a row for each prediction, ``found`` with (g, c), the box and its class, for each of ``ious``."""
    keys = ["image_id", "class_id"] if same_class else ["image_id"]
    pairs = overlaps(gts, preds, min(ious), same_class)
    options = pairs.groupBy("image_id", "det_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), (-F.col("gt_id")).alias("g"), F.col("gt_class").alias("c")))).alias("options"))
    rows = preds.select("image_id", "det_id", "class_id", "score").join(options, ["image_id", "det_id"], "left")
    none = F.expr("cast(array() as array<struct<k:double,g:bigint,c:string>>)")
    one = F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("d"), F.col("class_id").alias("cls"), F.coalesce("options", none).alias("o"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("used"), F.expr("cast(array() as array<struct<g:bigint,c:string>>)").alias("out"))

    def at(thr: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            free = F.get(F.filter(p["o"], lambda o: (-o["k"] >= thr) & ~F.array_contains(acc["used"], o["g"])), F.lit(0))
            used = F.when(free.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(free["g"])))
            return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct((-free["g"]).alias("g"), free["c"].alias("c")))).alias("out"))

        return F.aggregate("all", start, step)["out"]

    # one group for each frame (and class) serves all thresholds: no row is multiplied
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one), lambda a, b: _compare(a, b)).alias("all"))
    own = [f"f{k}" for k in range(len(ious))]
    done = frames.select("image_id", "all", *[at(F.lit(t)).alias(f) for f, t in zip(own, ious, strict=True)]).select("image_id", F.explode(F.arrays_zip("all", *own)).alias("m"))
    found = F.array(*[F.col(f"m.{f}") for f in own])
    return done.select("image_id", F.col("m.all.d").alias("det_id"), F.col("m.all.cls").alias("class_id"), (-F.col("m.all.s")).alias("score"), found.alias("found"))


def _compare(a: Column, b: Column) -> Column:
    less = (a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["d"] < b["d"]))
    same = (a["s"] == b["s"]) & (a["d"] == b["d"])
    return F.when(same, 0).when(less, -1).otherwise(1)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and F1; 0 where nothing can be divided."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return {"precision": p, "recall": r, "f1": zero(F.try_divide(2 * p * r, p + r))}


def class_counts(matched: DataFrame, gts: DataFrame) -> DataFrame:
    """thr, class_id, tp, fp, fn, support and the rates; classes of either side."""
    hit = matched.groupBy("thr", "class_id").agg(F.count("gt_id").alias("tp"), F.count("*").alias("n"))
    truth = gts.groupBy("class_id").agg(F.count("*").alias("support")).join(matched.select("thr").distinct(), how="inner")
    both = hit.join(truth, ["thr", "class_id"], "full_outer").fillna(0, ["tp", "n", "support"])
    both = both.withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.greatest(F.lit(0), F.col("support") - F.col("tp"))).drop("n")
    return both.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def precision_curve(matched: DataFrame, part: str | None = None) -> DataFrame:
    """Adds cum_tp, cum_n, precision and envelope (best precision from there down) by falling score, within thr and class.

    Running values are taken in two steps, within a range of scores and over the ranges, so that no task needs all rows
    of a class. With ``part``, a column that grows as scores fall, the envelope looks down to the end of a row's part only.
    """
    keys = ["thr", "class_id"]
    part_of = F.col(part) if part else F.lit(0)
    place = F.struct(part_of.alias("p"), F.floor((1 - F.col("score")) * BUCKETS).cast("long").alias("b"))
    rows = matched.withColumn("__b", place).withColumn("tp", F.col("gt_id").isNotNull().cast("long"))
    order = [F.desc("score"), F.col("image_id"), F.col("det_id")]
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*keys, "__b.p").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__b").agg(F.sum("tp").alias("t"), F.count("*").alias("n"))
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(sums, [*keys, "__b"]).withColumn("cum_tp", F.col("t0") + F.sum("tp").over(inside)).withColumn("cum_n", F.col("n0") + F.row_number().over(inside)).withColumn("precision", F.col("cum_tp") / F.col("cum_n"))
    best = rows.groupBy(*keys, "__b").agg(F.max("precision").alias("p")).select(*keys, "__b", F.max("p").over(below).alias("later"))
    upwards = Window.partitionBy(*keys, "__b").orderBy(F.asc("score"), F.desc("image_id"), F.desc("det_id"))
    rest = F.max("precision").over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(best, [*keys, "__b"]).withColumn("envelope", F.greatest(rest, F.col("later"))).drop("__b", "t0", "n0", "later")


def average_precision(matched: DataFrame, gts: DataFrame) -> DataFrame:
    """thr, class_id, ap: area under the precision envelope over recall, for each class with ground truth."""
    support = gts.groupBy("class_id").agg(F.count("*").alias("support"))
    gained = precision_curve(matched).where("tp = 1").groupBy("thr", "class_id").agg(F.sum("envelope").alias("area"))
    every = support.join(matched.select("thr").distinct(), how="inner")
    return every.join(gained, ["thr", "class_id"], "left").select("thr", "class_id", F.coalesce(F.col("area") / F.col("support"), F.lit(0.0)).alias("ap"))


def average_precisions(each: DataFrame, gts: DataFrame, ious: Sequence[float]) -> DataFrame:
    """thr, class_id, ap as ``average_precision`` has them, from ``match_each``: predictions are put in order once for all thresholds."""
    every = range(len(ious))
    keys = ["class_id", "__b"]
    place = F.struct(F.floor((1 - F.col("score")) * BUCKETS).cast("long").alias("b"))  # null scores are a range, too
    rows = each.select("image_id", "det_id", "class_id", "score", place.alias("__b"), *[F.col("found")[k]["g"].isNotNull().cast("long").alias(f"tp{k}") for k in every])
    order = [F.desc("score"), F.col("image_id"), F.col("det_id")]
    inside = Window.partitionBy(*keys).orderBy(*order)
    before = Window.partitionBy("class_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("class_id").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"tp{k}").alias(f"t{k}") for k in every])
    sums = sums.select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("n", *(f"t{k}" for k in every))])
    rows = rows.join(sums, keys).withColumn("n", F.col("n_0") + F.row_number().over(inside))
    rows = rows.select("image_id", "det_id", "score", *keys, *[f"tp{k}" for k in every], *[((F.col(f"t{k}_0") + F.sum(f"tp{k}").over(inside)) / F.col("n")).alias(f"p{k}") for k in every])
    best = rows.groupBy(*keys).agg(*[F.max(f"p{k}").alias(f"p{k}") for k in every]).select(*keys, *[F.max(f"p{k}").over(below).alias(f"later{k}") for k in every])
    upwards = Window.partitionBy(*keys).orderBy(F.asc("score"), F.desc("image_id"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, *[f"tp{k}" for k in every], *[F.max(f"p{k}").over(upwards).alias(f"rest{k}") for k in every]).join(best, keys)
    gained = rows.groupBy("class_id").agg(*[F.sum(F.when(F.col(f"tp{k}") == 1, F.greatest(f"rest{k}", f"later{k}"))).alias(f"area{k}") for k in every])
    thr = F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.lit(k).alias("k")) for k, t in enumerate(ious)])).alias("t")
    support = gts.groupBy("class_id").agg(F.count("*").alias("support")).join(each.limit(1).select(thr), how="inner")
    area = F.get(F.array(*[f"area{k}" for k in every]), F.col("t.k"))
    return support.join(gained, "class_id", "left").select("t.thr", "class_id", F.coalesce(area / F.col("support"), F.lit(0.0)).alias("ap"))


def confusion(gts: DataFrame, preds: DataFrame, iou: float = 0.5) -> DataFrame:
    """gt_class, class_id, n: class-blind matches, with the background as the other side of what is unmatched."""
    m = match(gts, preds, (iou,), same_class=False)
    pairs = m.select(F.coalesce("gt_class", F.lit(BACKGROUND)).alias("gt_class"), "class_id")
    missed = gts.join(m.where("gt_id is not null").select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").select(F.col("class_id").alias("gt_class"), F.lit(BACKGROUND).alias("class_id"))
    return pairs.unionByName(missed).groupBy("gt_class", "class_id").agg(F.count("*").alias("n"))


def false_positive_causes(matched: DataFrame, gts: DataFrame, preds: DataFrame, iou: float = 0.5) -> DataFrame:
    """image_id, det_id, class_id, cause, best_iou of each unmatched prediction: what it overlaps most, of any class."""
    missed = preds.join(matched.where("gt_id is null").select("image_id", "det_id"), ["image_id", "det_id"], "left_semi")
    best = overlaps(gts, missed, 0.0, same_class=False).groupBy("image_id", "det_id").agg(F.max("iou").alias("best_iou"))
    out = missed.join(best, ["image_id", "det_id"], "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))
    cause = F.when(F.col("best_iou") >= iou, "class_confusion").when(F.col("best_iou") >= 0.1, "localisation").otherwise("spurious_detection")
    return out.select("image_id", "det_id", "class_id", cause.alias("cause"), "best_iou")


def evaluate(gts: DataFrame, preds: DataFrame, iou: float = 0.5, ious: Sequence[float] = COCO_IOUS) -> DataFrame:
    """scope, class_id, metric values: one row for each class at ``iou``, and one overall with mAP at ``iou`` and over ``ious``."""
    thrs = sorted({*ious, iou})
    each = materialize(match_each(gts, preds, thrs), "matches")  # counts and curves read it, each more than once
    found = F.col("found")[thrs.index(iou)]
    counts = class_counts(each.select(F.lit(iou).alias("thr"), "class_id", found["g"].alias("gt_id")), gts)
    ap = average_precisions(each, gts, thrs)
    own = counts.join(ap.where(F.col("thr") == iou).drop("thr"), "class_id", "left").select(F.lit("class").alias("scope"), "class_id", "tp", "fp", "fn", "precision", "recall", "f1", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.lit(None).cast("double").alias("map_50_95"))
    total = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))
    by_iou = ap.groupBy("thr").agg(F.avg("ap").alias("m"))
    means = by_iou.agg(F.max(F.when(F.col("thr") == iou, F.col("m"))).alias("ap"), F.avg(F.when(F.col("thr").isin(*ious), F.col("m"))).alias("map_50_95"))
    return own.unionByName(total.join(means).select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("class_id"), "tp", "fp", "fn", "precision", "recall", "f1", "ap", "map_50_95"))


def best_thresholds(gts: DataFrame, preds: DataFrame, grid: Sequence[float] = tuple(round(0.05 * k, 2) for k in range(1, 20)), iou: float = 0.5, min_precision: float = 0.0) -> DataFrame:
    """class_id, threshold, tp, fp, fn, precision, recall, f1: the grid point of the best F1 for each class, the first of equals.

    Predictions are matched by falling score, so dropping low scores never changes the matches of the others: one
    matching serves the whole grid.
    """
    m = match(gts, preds, (iou,))
    steps = F.array(*map(F.lit, sorted(grid)))
    reached = m.select("class_id", F.size(F.filter(steps, lambda t: t <= F.col("score"))).alias("k"), F.col("gt_id").isNotNull().cast("long").alias("hit"))
    counts = reached.groupBy("class_id", "k").agg(F.sum("hit").alias("hit"), F.count("*").alias("n")).where("k > 0")  # a row for each class and step
    sums = counts.withColumn("threshold", F.explode(F.slice(steps, F.lit(1), F.col("k")))).groupBy("class_id", "threshold").agg(F.sum("hit").alias("tp"), F.sum("n").alias("n"))
    classes = preds.select("class_id").distinct().join(gts.groupBy("class_id").agg(F.count("*").alias("support")), "class_id", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    all_points = classes.join(sums, ["class_id", "threshold"], "left").fillna(0, ["tp", "n", "support"]).withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp")).withColumns(rates(F.col("tp"), F.col("n") - F.col("tp"), F.col("support") - F.col("tp")))
    w = Window.partitionBy("class_id").orderBy(F.desc("f1"), "threshold")
    return all_points.where(F.col("precision") >= min_precision).withColumn("__r", F.row_number().over(w)).where("__r = 1").select("class_id", "threshold", "tp", "fp", "fn", "precision", "recall", "f1")
