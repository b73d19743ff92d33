"""Reports and small rules over detections, models, data sets and wires."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators.datasets import RELIABLE, TRAINABLE
from sightline.operators.selection import WEIGHTS, select_model
from sightline.plans import pieces


def acquisition(sources: DataFrame, counts: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, forecast, unquantified, status, origin, priority_gap: what usable sources give for each class.

    ``sources``: source, kind, usable. ``counts``: source, class_id, n (null: provided but not counted). ``classes``:
    class_id, priority. Only counted rows of usable sources that aren't manual are summed, so the forecast is a floor;
    a class that only manual sources have must be captured, one that none has has no origin.
    """
    use = sources.where("usable").select("source", (F.col("kind") == "manual").alias("manual"))
    have = counts.join(use, "source").groupBy("class_id").agg(
        F.sum(F.when(~F.col("manual"), F.col("n"))).alias("n"),
        F.bool_or(~F.col("manual")).alias("public"),
        F.bool_or(~F.col("manual") & F.coalesce(F.col("n") == 0, F.lit(True))).alias("unquantified"),
    )
    rows = classes.join(have, "class_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(n == 0, "none").when(n < TRAINABLE, "untrainable").when(n < RELIABLE, "weak").otherwise("reliable")
    origin = F.when(F.col("public"), "public").when(F.col("public").isNotNull(), "manual").otherwise("none")
    return rows.select("class_id", n.alias("forecast"), F.coalesce("unquantified", F.lit(False)).alias("unquantified"), status.alias("status"), origin.alias("origin"), (F.col("priority") & (n == 0)).alias("priority_gap"))


def catalogue_summary(entries: DataFrame, maker: str, klass: str) -> DataFrame:
    """entries, makers, classes, and the maker of most entries (of equals the first by name)."""
    per = entries.groupBy(maker).agg(F.count("*").alias("n"))
    first = per.agg(F.min_by(maker, F.struct(-F.col("n"), maker)).alias("largest"))
    return entries.agg(F.count("*").alias("entries"), F.count_distinct(maker).alias("makers"), F.count_distinct(klass).alias("classes")).join(first)


def rule_summary(rules: DataFrame) -> DataFrame:
    """rule, n_classes, total weight, heaviest class (of equals the first by name)."""
    return rules.groupBy("rule").agg(F.count("*").alias("n_classes"), F.sum("weight").alias("total"), F.min_by("class_id", F.struct(-F.col("weight"), "class_id")).alias("heaviest"))


def colour_counts(wires: DataFrame, frame: str = "image_id") -> DataFrame:
    """frame, color, n: wires of each colour in each frame."""
    return wires.groupBy(frame, "color").agg(F.count("*").alias("n"))


def dataset_health(per_class: DataFrame, priority: DataFrame, images: int | Column, least_images: int = 500, named: int = 8) -> DataFrame:
    """missing (priority classes without an instance), first_missing (at most ``named``), warnings: whether data is too thin to search settings on."""
    rows = priority.join(per_class.select("class_id", "instances"), "class_id", "left")
    gone = rows.agg(F.array_sort(F.collect_set(F.when(F.coalesce("instances", F.lit(0)) == 0, F.col("class_id")))).alias("gone"))
    n = F.lit(images) if isinstance(images, int) else images
    warnings = F.array_compact(F.array(F.when(F.size("gone") > 0, "priority_classes_without_data"), F.when(n < least_images, "few_images")))
    return gone.select(F.size("gone").alias("missing"), F.slice("gone", 1, named).alias("first_missing"), warnings.alias("warnings"))


def model_report(evals: DataFrame, profiles: DataFrame, budget: float, least_map: float = 0.0, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """label, place, score, reason, note, role, accuracy_lost: the ranking with what choosing its winner costs.

    ``role``: winner, runner_up, or most_accurate where that is another model; ``accuracy_lost`` is how much mAP the
    winner has less than the model. A disqualified model has its reason and no place. There are as many rows as models.
    """
    ranked = select_model(evals, profiles, budget, least_map, weights).join(evals.select("label", "map_50_95"), "label").join(profiles.select("label", "latency"), "label", "left")
    best = ranked.agg(F.max(F.when(F.col("place") == 1, F.col("map_50_95"))).alias("win"), F.max_by("label", F.when(F.col("place").isNotNull(), F.struct("map_50_95", -F.col("place")))).alias("accurate"))
    rows = ranked.join(best)
    role = F.when(F.col("place") == 1, "winner").when(F.col("label") == F.col("accurate"), "most_accurate").when(F.col("place") == 2, "runner_up")
    note = F.when(F.col("latency").isNull() & F.col("place").isNotNull(), "accuracy_only")
    return rows.select("label", F.col("place").cast("long").alias("place"), "score", F.col("disqualified").alias("reason"), note.alias("note"), role.alias("role"), F.when(F.col("place").isNotNull(), F.col("map_50_95") - F.col("win")).alias("accuracy_lost"))


def image_pair_report(objects: DataFrame, texts: DataFrame, regions: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, summary) of pairs of images.

    ``objects``: image_id, ref_id, obs_id, type. ``texts``: image_id, removed, added (arrays of tokens). ``regions``:
    image_id, region_id, type. ``scores``: image_id, similarity, one row a pair. Differences are image_id, part, type,
    ref; the summary has for each pair its similarity in percent, n_diffs, n_major and status. Missing or changed
    objects and removed text are major.
    """
    null = F.lit(None).cast("string")
    of_text = texts.select("image_id", F.explode(F.concat(F.transform("removed", lambda t: F.struct(F.lit("text_removed").alias("type"), t.alias("ref"))), F.transform("added", lambda t: F.struct(F.lit("text_added").alias("type"), t.alias("ref"))))).alias("d"))
    diffs = (
        objects.select("image_id", F.lit("object").alias("part"), "type", F.coalesce("ref_id", "obs_id").cast("string").alias("ref"))
        .unionByName(of_text.select("image_id", F.lit("text").alias("part"), "d.type", "d.ref"))
        .unionByName(regions.select("image_id", F.lit("region").alias("part"), "type", F.coalesce(F.col("region_id").cast("string"), null).alias("ref")))
    )
    major = F.col("type").isin("missing_object", "changed_object", "text_removed")
    n = diffs.groupBy("image_id").agg(F.count("*").alias("n_diffs"), F.count_if(major).alias("n_major"))
    rows = scores.join(n, "image_id", "left").fillna(0, ["n_diffs", "n_major"])
    status = F.when(F.col("n_diffs") == 0, "identical").when(F.col("n_major") > 0, "major").otherwise("minor")
    return diffs, rows.select("image_id", F.round(F.col("similarity") * 100, 2).alias("similarity"), "n_diffs", "n_major", status.alias("status"))


def validate_datasets(files: DataFrame, labels: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row a data set: n_images, n_labels, n_classes, imbalance, missing_labels, corrupt, warnings, errors, ok.

    ``files``: dataset, stem, is_image, readable. ``labels``: dataset, stem, class_id, one row a label.
    """
    images = files.where("is_image").join(labels.select(dataset, "stem").distinct().withColumn("labelled", F.lit(True)), [dataset, "stem"], "left")
    per = images.groupBy(dataset).agg(F.count("*").alias("n_images"), F.count("labelled").alias("n_labels"), F.count_if(F.col("labelled").isNull()).alias("missing_labels"), F.count_if(~F.col("readable")).alias("corrupt"))
    n = labels.groupBy(dataset, "class_id").agg(F.count("*").alias("n"))
    classes = n.groupBy(dataset).agg(F.count("*").alias("n_classes"), (F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("ratio"))
    rows = files.select(dataset).distinct().join(per, dataset, "left").join(classes, dataset, "left").fillna(0, ["n_images", "n_labels", "missing_labels", "corrupt", "n_classes"])
    ratio = F.round("ratio", 2)
    warnings = F.array_compact(F.array(F.when(ratio >= 10, "severe_imbalance").when(ratio >= 3, "imbalance"), F.when(F.col("missing_labels") > 0, "missing_labels")))
    errors = F.array_compact(F.array(F.when(F.col("corrupt") > 0, "corrupt_images"), F.when(F.col("n_images") == 0, "no_images").when(F.col("n_labels") == 0, "no_labels")))
    return rows.select(dataset, "n_images", "n_labels", "n_classes", ratio.alias("imbalance"), "missing_labels", "corrupt", warnings.alias("warnings"), errors.alias("errors"), (F.size(errors) == 0).alias("ok"))


def topology(components: DataFrame, wires: DataFrame, frame: str = "image_id") -> DataFrame:
    """frame, kind (node or edge), id, label, src, dst: what a frame shows, its components numbered in order of id."""
    at = F.row_number().over(Window.partitionBy(frame).orderBy("det_id")) - 1
    null = F.lit(None).cast("string")
    nodes = components.select(frame, F.lit("node").alias("kind"), at.cast("string").alias("id"), F.col("class_id").alias("label"), null.alias("src"), null.alias("dst"))
    return nodes.unionByName(wires.select(frame, F.lit("edge").alias("kind"), F.col("wire_uid").cast("string").alias("id"), F.col("color").alias("label"), "src", "dst"))


def connections(edges: DataFrame) -> DataFrame:
    """edge, src, dst, color, complete: the edges of a graph as rows, and whether both of their ends are known."""
    return edges.select("edge", "src", "dst", "color", (F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("complete"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that only depends on the parts, the same in any engine with MD5."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / float(1 << 32)


def augment(rows: DataFrame, row_id: str, vector: str, seed: int = 42, spread: float = 0.03, scale: float = 0.1) -> DataFrame:
    """``rows`` and a jittered copy of each (column augmented): x * U(1 - scale, 1 + scale) + N(0, spread), cut to 0..1.

    Draws are functions of the row's id, the position and the seed, so they neither depend on partitions nor on a rerun.
    """
    factor = 1 - scale + 2 * scale * _uniform(F.lit(seed), F.col(row_id), F.lit("s"))

    def jitter(x: Column, k: Column) -> Column:
        normal = F.sqrt(-2 * F.log(_uniform(F.lit(seed), F.col(row_id), k, F.lit("a")))) * F.cos(2 * F.pi() * _uniform(F.lit(seed), F.col(row_id), k, F.lit("b")))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x * factor + normal * spread))

    return rows.withColumn("augmented", F.lit(False)).unionByName(rows.withColumn(vector, F.transform(vector, jitter)).withColumn("augmented", F.lit(True)))


def falls(people: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Boxes of people that are at least ``ratio`` times as wide as high, with label and w_h; boxes without height are none."""
    w_h = F.try_divide(g.width(g.box()), g.height(g.box()))
    return people.where((g.height(g.box()) > 0) & (w_h >= ratio)).withColumn("label", F.lit("falling")).withColumn("w_h", F.round(w_h, 2))


def latency_profile(timings: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float] = {"p50": 0.5, "p95": 0.95, "p99": 0.99}, bins: int = 4_096) -> DataFrame:
    """by, the quantiles (values that occur), mean, least, most, sd, fps (1000 / mean).

    A histogram of each key tells which of its bins hold the quantiles, and only the values of those are ordered, so a key
    that has most rows is no single group.
    """
    by = list(by)
    rows = timings.where(F.col(value).isNotNull())
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("sd"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0)) * bins)).cast("int")
    counts = rows.join(stats.select(*by, "n", "least", "most"), by).groupBy(*by, "n", at.alias("bin"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    binned = counts.groupBy(*by, "n", "bin").agg(F.sum("k").alias("k"))
    binned = binned.withColumn("upto", F.sum("k").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(q) * F.col("n")).alias("rank")) for name, q in quantiles.items()])
    asked = binned.withColumn("q", F.explode(ranks)).where((F.col("q.rank") <= F.col("upto")) & (F.col("q.rank") > F.col("upto") - F.col("k")))
    asked = asked.select(*by, "bin", "q.name", (F.col("q.rank") - F.col("upto") + F.col("k")).alias("rank"))
    within = counts.join(asked.select(*by, "bin").distinct(), [*by, "bin"], "left_semi")
    within = within.withColumn("upto", F.sum("k").over(Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = asked.join(within.select(*by, "bin", "v", "upto"), [*by, "bin"]).where("upto >= rank").groupBy(*by).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles])
    return stats.drop("n").join(found, by).withColumn("fps", F.try_divide(F.lit(1000), F.col("mean")))


def classifier_metrics(rows: DataFrame, truth: str = "label", predicted: str = "pred", probability: str = "pr") -> DataFrame:
    """class, right, predicted, precision (0 if never predicted) and log loss of the probability given to the truth."""
    own = rows.groupBy(F.col(truth).alias("class")).agg(F.count_if(F.col(truth) == F.col(predicted)).alias("right"), F.avg(-F.log(F.greatest(probability, F.lit(1e-15)))).alias("log_loss"))
    n = rows.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("predicted"))
    return own.join(n, "class", "left").fillna(0, ["predicted"]).withColumn("precision", F.coalesce(F.try_divide("right", "predicted"), F.lit(0.0)))


def refinement_summary(rows: DataFrame, reason: str = "reason", value: str = "iou") -> DataFrame:
    """reason (accepted if null), n, mean of the overlap with the box before."""
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_iou"))


def refinement_totals(rows: DataFrame, reason: str = "reason", value: str = "iou", before: str = "area", after: str = "new_area") -> DataFrame:
    """One row: boxes, accepted (no reason against it), accept_rate, mean_iou of these with the box before, tightened (smaller than before) and their mean_area_reduction.

    What there is nothing to take a mean of is null, not 0.
    """
    ok = F.col(reason).isNull()
    smaller = ok & (F.col(after) < F.col(before))
    left = F.avg(F.when(smaller, F.col(after) / F.greatest(F.col(before), F.lit(1e-9))))
    return rows.agg(F.count("*").alias("boxes"), F.count_if(ok).alias("accepted"), F.try_divide(F.count_if(ok), F.count("*")).alias("accept_rate"), F.avg(F.when(ok, F.col(value))).alias("mean_iou"), F.count_if(smaller).alias("tightened"), (1 - left).alias("mean_area_reduction"))


def classifier_totals(rows: DataFrame, truth: str = "label", predicted: str = "pred", probability: str = "pr") -> DataFrame:
    """One row: n, accuracy, precision, recall and f1 (means over the classes of either side, 0 where nothing can be divided) and log_loss."""
    t, p = F.col(truth), F.col(predicted)
    sides = rows.select(F.explode(F.array(F.struct(t.alias("class"), F.lit(1).alias("own"), F.lit(0).alias("said")), F.struct(p.alias("class"), F.lit(0).alias("own"), F.lit(1).alias("said")))).alias("x"), (t == p).alias("right"))
    per = sides.groupBy("x.class").agg(F.sum("x.own").alias("support"), F.sum("x.said").alias("said"), F.sum(F.when(F.col("right"), F.col("x.own")).otherwise(0)).alias("hit"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"p": zero(F.col("hit"), F.col("said")), "r": zero(F.col("hit"), F.col("support"))}).withColumn("f", zero(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    means = per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))
    whole = rows.agg(F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(probability, F.lit(1e-15)))).alias("log_loss"))
    return whole.join(means).select("n", "accuracy", "precision", "recall", "f1", "log_loss")


def requirement_estimate(classes: Column, target: Column, per_image: float = 12.0, seen: float = 4.0) -> Column:
    """Struct of what a target score takes for a label space of so many classes: low and high instances a class, instances and images in all.

    Of the bands that of the nearest target counts, of two as near the lower. A frame shows ``seen`` classes and
    ``per_image`` boxes, so images grow with the square of the classes.
    """
    # fixed values: target, least and most instances of a class
    bands = ((0.50, 150, 300), (0.70, 300, 600), (0.85, 700, 1_200), (0.92, 1_500, 2_500))
    band = F.array_min(F.array(*[F.struct(F.round(F.abs(F.lit(t) - target), 9).alias("d"), F.lit(t).alias("t"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for t, lo, hi in bands]))
    images = lambda n: F.round(n * classes / (F.lit(per_image * seen) / classes)).cast("long")
    return F.struct(band["low"].alias("class_low"), band["high"].alias("class_high"), (band["low"] * classes).cast("long").alias("instances_low"), (band["high"] * classes).cast("long").alias("instances_high"), images(band["low"]).alias("images_low"), images(band["high"]).alias("images_high"))


def unsteady(sd: Column, mean: Column, most: float = 0.35) -> Column:
    """Whether timings spread so much that they should be taken again on an idle machine."""
    return F.coalesce(F.try_divide(sd, mean) > most, F.lit(False))


def as_of(rows: DataFrame, key: str, time: str, row_id: str, wanted: Column, value: str) -> DataFrame:
    """Adds as_of: ``value`` of the last row before this one, in order of time and id, for which ``wanted`` holds (and that has one)."""
    order = [time, row_id]
    own = pieces.cut(rows.withColumn("__v", F.when(wanted, F.col(value))), [key], order)
    return pieces.running(own, [key], order, as_of=pieces.last_known(F.col("__v"), order, before=True)).select(*rows.columns, "as_of")


def with_fallback(rows: DataFrame, reference: DataFrame, key: str, value: str, computed: Column) -> DataFrame:
    """Adds ``value`` from a reference table, or as computed where that has none."""
    return rows.join(reference.select(key, F.col(value).alias("given")), key, "left").withColumn(value, F.coalesce("given", computed)).drop("given")


def scope(labels: DataFrame, profile: DataFrame) -> DataFrame:
    """Labels of the classes that a profile (class_id, new_index) has, with their index in it."""
    return labels.join(profile.select("class_id", "new_index"), "class_id")


VERDICTS = ("accept", "reject", "relabel")


def valid_verdict(verdict: Column, allowed: Sequence[str] = VERDICTS) -> Column:
    """Whether a verdict is one of those allowed, as it is written; a null isn't."""
    return F.coalesce(verdict.isin(*allowed), F.lit(False))


def label_signature(labels: DataFrame, image: str = "image_id", steps: int = 100) -> DataFrame:
    """image, signature: the class and all four coordinates of its boxes (cls, cx, cy, w, h, in parts of the image), rounded to 1 / ``steps``, in sorted order.

    Equal labels give equal texts whatever their order; boxes that differ in height alone do not.
    """
    one = F.concat_ws(":", F.col("cls").cast("string"), *(F.floor(F.col(c) * steps + 0.5).cast("string") for c in ("cx", "cy", "w", "h")))
    return labels.groupBy(image).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("signature"))


def number(text: Column, low: float | None = None, high: float | None = None) -> Column:
    """A finite number, from text too, kept within bounds; null if it is none."""
    x = text.try_cast("double")
    x = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    x = x if low is None else F.greatest(x, F.when(x.isNotNull(), F.lit(low)))
    return x if high is None else F.least(x, F.when(x.isNotNull(), F.lit(high)))


def review_queue(boxes: DataFrame, limit: int, image: str = "image_id", sure: float = 0.1) -> DataFrame:
    """image, least, place: images with most unsure boxes first, then those of the least score; the first ``limit``."""
    per = boxes.groupBy(image).agg(F.min("score").alias("least"), F.count_if(F.col("score") < sure).alias("unsure"))
    top = per.orderBy(F.desc("unsure"), "least", image).limit(limit)
    return top.select(image, "least", F.row_number().over(Window.orderBy(F.desc("unsure"), "least", image)).cast("long").alias("place"))


def renumber(boxes: DataFrame, *order: Column, image: str = "image_id") -> DataFrame:
    """Adds new_id: boxes of an image numbered from 1 in the order given."""
    return boxes.withColumn("new_id", F.row_number().over(Window.partitionBy(image).orderBy(*order)).cast("long"))


def severity_rank(severity: Column, order: Sequence[str] = ("important", "advisory", "info")) -> Column:
    """Place of a severity in the order, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), severity)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order)).otherwise(at - 1).cast("int")


def requirement_band(target: Column, bands: Sequence[tuple[float, int]] = ((0.3, 50), (0.5, 150), (0.7, 300), (0.85, 800))) -> Column:
    """Instances a class needs for a target score: those of the nearest band, of two as near the lower."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(t) - target).alias("d"), F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in bands]))["n"]


def short_name(class_id: Column) -> Column:
    return F.split_part(class_id, F.lit("_"), F.lit(1))


def panel_sentence(panel: str, n: str, classes: str) -> Column:
    return F.format_string("Panel %d: %d devices, %d classes", panel, n, classes)


def duplicate_verdict(report: DataFrame) -> DataFrame:
    """verdict: what a ``duplicate_report`` means, in up to three sentences."""
    n = lambda c: F.col(c).cast("string")
    share = F.format_string("%.1f", 100.0 * F.col("redundant") / F.greatest("images", F.lit(1)))
    copies = F.when(F.col("redundant") == 0, "Every image is its own.").otherwise(F.concat(n("redundant"), F.lit(" of "), n("images"), F.lit(" images ("), share, F.lit(" %) repeat another.")))
    across = F.when(F.col("cross_split") > 0, F.concat(n("cross_split"), F.lit(" groups lie in more than one split, so scores measured here are too good.")))
    clash = F.when(F.col("label_conflicts") > 0, F.concat(n("label_conflicts"), F.lit(" groups have labels that disagree and need a look.")))
    return report.select(F.concat_ws(" ", copies, across, clash).alias("verdict"))


def camera_healthy(connected: Column, age_ms: Column, most_ms: float = 5_000) -> Column:
    """Connected, with a frame, and that not too old."""
    return F.coalesce(connected & (age_ms < most_ms), F.lit(False))


def fleet(cameras: DataFrame) -> DataFrame:
    """cameras, connected, fps in all, mean latency of those that have one. ``cameras``: up, fps, latency, a row a camera."""
    return cameras.agg(F.count("*").alias("cameras"), F.count_if("up").alias("connected"), F.sum(F.coalesce("fps", F.lit(0.0))).alias("fps"), F.avg("latency").alias("mean_latency"))


def review_progress(states: DataFrame) -> DataFrame:
    """state, n, share of all."""
    n = states.groupBy("state").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("state", "n", (F.col("n") / F.col("total")).alias("share"))


def best_trials(trials: DataFrame, score: str, row_id: str, k: int) -> DataFrame:
    """The k best trials, those without a score last, ties by id."""
    return trials.orderBy(F.col(score).isNull(), F.desc(score), row_id).limit(k)
