"""What accepted detections say about a panel: quantities, type, application, gaps and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.gate import UNKNOWN

UNCLASSIFIED = "unclassified"
# Weights and levels of the risk score.
MISSING_WEIGHTS = {"important": 3.0, "advisory": 1.0, "info": 0.25}
NOTE_WEIGHTS = {"important": 2.5, "advisory": 1.0, "info": 0.25}
LEVELS = (("high", 9.0), ("elevated", 5.0), ("moderate", 2.0))
SAFETY_BONUS = 1.5


def counts(dets: DataFrame, panel: str = "image_id") -> DataFrame:
    return dets.groupBy(panel, "class_id").agg(F.count("*").alias("n"))


def bill_of_materials(findings: DataFrame, classes: DataFrame, panel: str = "image_id") -> DataFrame:
    """Quantity, confidences, makers and finding numbers of each class of a panel, with its place in the list (countable first)."""
    rows = findings.groupBy(panel, "class_id").agg(
        F.count("*").alias("quantity"), F.avg("score").alias("mean_confidence"), F.min("score").alias("min_confidence"), F.max("score").alias("max_confidence"),
        F.array_sort(F.collect_set("maker")).alias("makers"), F.array_sort(F.collect_list("det_id")).alias("indices"),
    )
    rows = rows.join(classes.select("class_id", "category", "countable"), "class_id", "left")
    w = Window.partitionBy(panel).orderBy(F.coalesce("countable", F.lit(False)).desc(), F.desc("quantity"), "class_id")
    return rows.withColumn("place", F.row_number().over(w))


def confidence_stats(dets: DataFrame, panel: str = "image_id") -> DataFrame:
    """n, mean, median, least, most, low (< .5) and unknown of each panel."""
    return dets.groupBy(panel).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"), F.count_if(F.col("score") < 0.5).alias("low"), F.count_if(F.col("class_id") == UNKNOWN).alias("unknown"))


def rule_scores(inventory: DataFrame, rules: DataFrame, keystones: DataFrame, panel: str = "image_id") -> DataFrame:
    """panel, rule, ordinal, score: weighted evidence with the square root of capped counts; x .3 without a key device; floor 0."""
    rows = inventory.where((F.col("n") > 0) & (F.col("class_id") != UNKNOWN))
    part = rows.join(rules, "class_id").groupBy(panel, "rule").agg(F.sum(F.col("weight") * F.sqrt(F.least("n", "cap"))).alias("raw"))
    key = rows.join(keystones, "class_id").select(panel, "rule", F.lit(True).alias("key")).distinct()
    every = inventory.select(panel).distinct().join(rules.select("rule", "ordinal").distinct())
    out = every.join(part, [panel, "rule"], "left").join(key, [panel, "rule"], "left")
    score = F.coalesce("raw", F.lit(0.0)) * F.when(F.col("key"), 1.0).otherwise(0.30)
    return out.select(panel, "rule", "ordinal", F.greatest(F.lit(0.0), score).alias("score"))


def classify(scores: DataFrame, devices: DataFrame, panel: str = "image_id", least_devices: int = 3, least_share: float = 0.22) -> DataFrame:
    """panel, panel_type, confidence, reason: the best rule, refused with too few devices or too small a share. ``devices``: panel, n."""
    total = Window.partitionBy(panel)
    order = total.orderBy(F.desc("score"), "ordinal")
    rows = scores.withColumn("share", F.coalesce(F.try_divide("score", F.sum("score").over(total)), F.lit(0.0))).withColumn("k", F.row_number().over(order)).where("k = 1")
    rows = rows.join(devices.select(panel, F.col("n").alias("devices")), panel, "left")
    few = F.coalesce("devices", F.lit(0)) < least_devices
    reason = F.when(few, "insufficient_evidence").when(F.col("share") < least_share, "ambiguous_composition")
    return rows.select(panel, F.when(reason.isNull(), F.col("rule")).otherwise(UNCLASSIFIED).alias("panel_type"), F.when(few, 0.0).otherwise(F.col("share")).alias("confidence"), reason.alias("reason"))


def top_types(scores: DataFrame, k: int = 3, panel: str = "image_id") -> DataFrame:
    w = Window.partitionBy(panel).orderBy(F.desc("score"), "ordinal")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def missing(types: DataFrame, inventory: DataFrame, expected: DataFrame, important: Sequence[str], panel: str = "image_id") -> DataFrame:
    """panel, class_id, severity: what a panel of its type normally has and shows none of."""
    want = types.select(panel, F.col("panel_type").alias("rule")).join(expected, "rule").select(panel, "class_id")
    gone = want.join(inventory.where("n > 0").select(panel, "class_id"), [panel, "class_id"], "left_anti")
    return gone.withColumn("severity", F.when(F.col("class_id").isin(*important), "important").otherwise("advisory"))


def applications(inventory: DataFrame, texts: DataFrame, patterns: Sequence[tuple[str, str]], hints: Sequence[tuple[str, Sequence[str]]], panel: str = "image_id") -> DataFrame:
    """panel, application, votes: 2 for each pattern that the panel's text matches, .6 for each device of a hint with two or more."""
    text = F.lower("text")
    by_text = texts.select(panel, F.explode(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(a)) for p, a in patterns]))).alias("application")).withColumn("votes", F.lit(2.0))
    have = F.collect_set("class_id")
    sets = inventory.where("n > 0").groupBy(panel).agg(have.alias("have"))
    n = {a: F.size(F.array_intersect("have", F.array(*map(F.lit, c)))) for a, c in hints}
    by_parts = sets.select(panel, F.explode(F.array_compact(F.array(*[F.when(v >= 2, F.struct(F.lit(a).alias("a"), (0.6 * v).alias("v"))) for a, v in n.items()]))).alias("h")).select(panel, "h.a", "h.v").toDF(panel, "application", "votes")
    return by_text.unionByName(by_parts).groupBy(panel, "application").agg(F.sum("votes").alias("votes"))


def risk(stats: DataFrame, absent: DataFrame, notes: DataFrame, safety: Sequence[str], panel: str = "image_id") -> DataFrame:
    """panel, score, level, assessable: sum of what drives risk. Nothing found, or half of it unknown, is no low risk but none known.

    ``stats``: panel, n, mean, unknown; ``absent``: panel, class_id, severity; ``notes``: panel, severity.
    """
    def weigh(table: dict[str, float], other: float) -> F.Column:
        out = F.lit(other)
        for k, v in table.items():
            out = F.when(F.col("severity") == k, v).otherwise(out)
        return out

    ratio = F.try_divide("unknown", "n")
    gone = absent.groupBy(panel).agg(F.sum(weigh(MISSING_WEIGHTS, 1.0) + F.when(F.col("class_id").isin(*safety), SAFETY_BONUS).otherwise(0.0)).alias("w_missing"))
    said = notes.groupBy(panel).agg(F.sum(weigh(NOTE_WEIGHTS, 0.25)).alias("w_notes"))
    rows = stats.join(gone, panel, "left").join(said, panel, "left").fillna(0.0, ["w_missing", "w_notes"])
    own = F.when(ratio >= 0.2, 1 + 2 * ratio).otherwise(0.0) + F.when(F.col("mean") < 0.55, 1.0).otherwise(0.0)
    score = own + F.when(F.col("n") >= 4, F.col("w_missing")).otherwise(0.0) + F.col("w_notes")
    ok = (F.col("n") > 0) & (ratio < 0.5)
    level = F.lit("low")
    for name, least in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    rows = rows.withColumn("assessable", ok).withColumn("score", F.when(ok, score).otherwise(0.0))
    return rows.select(panel, "score", F.when(F.col("assessable"), level).otherwise("unknown").alias("level"), "assessable")
