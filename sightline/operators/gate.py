"""Cleaning of detector candidates: sanitise, suppress, resolve double claims, judge geometry and confidence, order.

Candidates are rows (image_id, det_id, class_id, score, x1, y1, x2, y2, ...); det_id is unique in an image. The greedy
steps run as one ``aggregate()`` over the sorted boxes of a frame and class, inside the JVM; a frame's boxes are what a
detector can return for one frame, so a group stays small however many frames there are. All steps after the first
shuffle are keyed by image_id, so the exchange on it is reused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g

UNKNOWN = "unknown_industrial_component"
#: Classes that a detector takes for one another.
CONFUSABLE: tuple[tuple[str, ...], ...] = (
    ("mcb", "mccb", "acb", "rcbo", "rccb", "motor_starter"),
    ("relay", "timer_relay", "safety_relay", "protection_relay", "signal_isolator"),
    ("vfd", "soft_starter", "servo_drive"),
    ("power_supply", "ups", "transformer"),
    ("push_button", "indicator_lamp", "selector_switch", "emergency_stop"),
    ("fuse", "fuse_holder"),
    ("busbar", "neutral_bar", "earth_bar"),
    ("terminal_block", "wire_duct", "din_rail"),
    ("ethernet_switch", "industrial_router", "io_module"),
    ("energy_meter", "ammeter", "pf_controller", "ats_controller"),
)


@dataclass(frozen=True)
class GateConfig:
    frame_w: float = 1024
    frame_h: float = 768
    min_side: float = 4.0
    nms_iou: float = 0.50
    cross_iou: float = 0.65
    contain: float = 0.80
    aspect_slack: float = 1.35
    area_slack: float = 2.0
    strictness: float = 1.0
    unknown_floor: float = 0.18
    default_threshold: float = 0.35
    cap: int = 200
    row_tolerance: float = 0.6
    confusable: tuple[tuple[str, ...], ...] = CONFUSABLE


def sanitise(cands: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Boxes put in order and cut to the frame, scores cut to 1; ``drop_reason`` tells what is wrong (first that holds)."""
    b, w, h = g.box(), F.lit(float(cfg.frame_w)), F.lit(float(cfg.frame_h))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    fixed = (cut(F.least(b[0], b[2]), w - 1), cut(F.least(b[1], b[3]), h - 1), cut(F.greatest(b[0], b[2]), w), cut(F.greatest(b[1], b[3]), h))
    all_finite = finite(b[0]) & finite(b[1]) & finite(b[2]) & finite(b[3])
    score = F.col("score")
    reason = (
        F.when(~all_finite, "non_finite_box")
        .when((g.width(fixed) < cfg.min_side) | (g.height(fixed) < cfg.min_side), "degenerate_box")
        .when(~finite(score) | (score <= 0), "invalid_score")
    )
    new = dict(zip(("x1", "y1", "x2", "y2"), fixed, strict=True))
    return cands.withColumns({"drop_reason": reason} | {k: F.when(all_finite, v).otherwise(F.col(k)) for k, v in new.items()} | {"score": F.least(score, F.lit(1.0))})


def greedy_mark(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], clash: Callable[[Column, Column], Column], active: Column | None = None) -> DataFrame:
    """Adds ``kept``: whether a row survives when rows are taken in ``order`` within ``keys``.

    A row goes if it clashes with one kept before it. Rows where ``active`` doesn't hold take no part and aren't kept.
    """
    packed = F.struct(*[c.alias(f"__{i}") for i, c in enumerate(order)], F.coalesce(F.lit(True) if active is None else active, F.lit(False)).alias("__on"), *[F.col(c) for c in rows.columns if c not in keys])
    sorted_rows = F.array_sort(F.collect_list(packed))
    start = F.struct(F.filter(F.col("__all"), lambda _: F.lit(False)).alias("kept"), F.expr("cast(array() as array<boolean>)").alias("flags"))

    def step(acc: Column, c: Column) -> Column:
        ok = c["__on"] & ~F.exists(acc["kept"], lambda k: clash(k, c))
        return F.struct(F.when(ok, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["flags"], F.array(ok)).alias("flags"))

    out = rows.groupBy(*keys).agg(sorted_rows.alias("__all")).withColumn("__flags", F.aggregate("__all", start, step)["flags"])
    out = out.select(*keys, F.explode(F.arrays_zip("__all", "__flags")).alias("__z"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__z.__all.{c}").alias(c) for c in rows.columns], F.col("__z.__flags").alias("kept"))


def greedy_keep(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows that survive when taken in ``order`` within ``keys``, each dropped if it clashes with one kept before it."""
    return greedy_mark(rows, keys, order, clash).where("kept").drop("kept")


def _by_score() -> list[Column]:
    return [-F.col("score"), F.col("det_id")]


def _overlaps(iou: float) -> Callable[[Column, Column], Column]:
    return lambda k, c: g.iou(g.fields(k), g.fields(c)) > iou


def nms_per_class(cands: DataFrame, iou: float = 0.5) -> DataFrame:
    """Within a frame and class, a box goes if it overlaps one kept before it by more than ``iou``."""
    return greedy_keep(cands, ["image_id", "class_id"], _by_score(), _overlaps(iou))


def nms_any_class(cands: DataFrame, iou: float = 0.45) -> DataFrame:
    """The same within a frame, whatever the class."""
    return greedy_keep(cands, ["image_id"], _by_score(), _overlaps(iou))


def nms_largest(cands: DataFrame, iou: float = 0.4) -> DataFrame:
    """Within a frame the larger box stays; a box goes at an overlap of ``iou`` or more."""
    return greedy_keep(cands, ["image_id"], [-g.area(g.box()), F.col("det_id")], lambda k, c: g.iou(g.fields(k), g.fields(c)) >= iou)


def confusable(a: Column, b: Column, groups: Sequence[Sequence[str]] = CONFUSABLE) -> Column:
    """Whether two classes are one, or stand in one group of look-alikes."""
    out = a == b
    for names in groups:
        out = out | (a.isin(*names) & b.isin(*names))
    return out


def _one_device(cfg: GateConfig) -> Callable[[Column, Column], Column]:
    def clash(k: Column, c: Column) -> Column:
        a, b = g.fields(k), g.fields(c)
        return confusable(k["class_id"], c["class_id"], cfg.confusable) & ((g.iou(a, b) > cfg.cross_iou) | (g.containment(b, a) > cfg.contain))

    return clash


def resolve_claims(cands: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Look-alike classes that claim one device: the best score stays. Other classes may overlap."""
    return greedy_keep(cands, ["image_id"], _by_score(), _one_device(cfg))


def plausibility_reason(cfg: GateConfig = GateConfig()) -> Column:
    """Why a box can't be its class (null if it can), from the columns of the class table: ar_lo, ar_hi, area_lo, area_hi."""
    b = g.box()
    ratio = F.try_divide(g.width(b), g.height(b))
    share = g.area(b) / (float(cfg.frame_w) * float(cfg.frame_h))
    return (
        F.when(F.col("class_id") == UNKNOWN, None)
        .when(g.height(b) <= 0, "degenerate_box")
        .when((ratio < F.col("ar_lo") / cfg.aspect_slack) | (ratio > F.col("ar_hi") * cfg.aspect_slack), "implausible_aspect_ratio")
        .when(share < F.col("area_lo") / cfg.area_slack, "implausible_too_small")
        .when(share > F.least(F.lit(1.0), F.col("area_hi") * cfg.area_slack), "implausible_too_large")
    )


def threshold(cfg: GateConfig = GateConfig()) -> Column:
    base = F.coalesce(F.col("min_conf"), F.lit(cfg.default_threshold))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), base * cfg.strictness))


def judge(cands: DataFrame, classes: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Adds drop_reason, and demoted_from where a low score makes a box *unknown*: geometry first, then confidence.

    ``classes`` is the class table, one row for each class; a class that it lacks passes the geometry gate.
    """
    dim = classes.select("class_id", "ar_lo", "ar_hi", "area_lo", "area_hi", "min_conf")
    rows = cands.join(dim, "class_id", "left").withColumn("drop_reason", plausibility_reason(cfg)).withColumn("__thr", threshold(cfg))
    low = F.col("drop_reason").isNull() & (F.col("score") < F.col("__thr"))
    rows = rows.withColumn("demoted_from", F.when(low & (F.col("score") >= cfg.unknown_floor), F.col("class_id")))
    rows = rows.withColumn("drop_reason", F.when(low & F.col("demoted_from").isNull(), "below_unknown_floor").otherwise(F.col("drop_reason")))
    rows = rows.withColumn("class_id", F.when(F.col("demoted_from").isNotNull(), UNKNOWN).otherwise(F.col("class_id")))
    return rows.select(*cands.columns, "drop_reason", "demoted_from")


def cap_per_image(cands: DataFrame, cap: int = 200) -> DataFrame:
    """Adds rank by score, and over_cap."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return cands.withColumn("rank", F.row_number().over(w)).withColumn("over_cap", F.col("rank") > cap)


def group_rows(cands: DataFrame, tolerance: float = 0.6, active: Column | None = None) -> DataFrame:
    """Adds row_no (from the top) and pos_in_row (from the left), both from 1; null where ``active`` doesn't hold.

    Boxes are taken from the top down; one joins the row at hand if its centre is no further from the mean of that row's
    centres than the tolerance times the median height of the frame's boxes.
    """
    b = g.box()
    on = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    one = F.struct(F.when(on, 0).otherwise(1).alias("o"), g.centre(b)[1].alias("cy"), (-F.col("score")).alias("s"), F.col("det_id").alias("d"), F.struct(*[c for c in cands.columns if c != "image_id"]).alias("r"))
    frame = cands.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.median(F.when(on & (g.height(b) > 0), g.height(b))).alias("h"))
    frame = frame.withColumn("band", F.coalesce(F.col("h"), F.lit(20.0)) * max(0.1, tolerance))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        joins = (acc["n"] > 0) & (F.abs(c["cy"] - acc["sum"] / acc["n"]) <= F.col("band"))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        moved = F.struct(row.alias("row"), (F.when(joins, acc["sum"]).otherwise(0.0) + c["cy"]).alias("sum"), (F.when(joins, acc["n"]).otherwise(0) + 1).alias("n"), F.concat(acc["out"], F.array(row)).alias("out"))
        none = F.struct(acc["row"].alias("row"), acc["sum"].alias("sum"), acc["n"].alias("n"), F.concat(acc["out"], F.array(F.lit(None).cast("int"))).alias("out"))
        return F.when(c["o"] == 0, moved).otherwise(none)

    rows = frame.withColumn("rows", F.aggregate("all", start, step)["out"]).select("image_id", F.explode(F.arrays_zip("all", "rows")).alias("z"))
    rows = rows.select(*[F.col(c) if c == "image_id" else F.col(f"z.all.r.{c}").alias(c) for c in cands.columns], F.col("z.rows").alias("row_no"))
    w = Window.partitionBy("image_id", "row_no").orderBy(g.centre(b)[0], F.desc("score"), "det_id")
    return rows.withColumn("pos_in_row", F.when(F.col("row_no").isNotNull(), F.row_number().over(w)))


def cascade(cands: DataFrame, classes: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """The whole gate: every candidate with ``drop_reason`` (null if accepted), what it ends as, and its place.

    Columns: image_id, det_id, class_id, score, box, drop_reason, demoted_from, row_no, pos_in_row. One chain without a
    join but for the class table: each step marks rows and passes all of them on, so nothing is computed twice.
    """
    base = ["image_id", "det_id", "class_id", "score", "x1", "y1", "x2", "y2"]
    alive = F.col("drop_reason").isNull()
    rows = sanitise(cands.select(*base), cfg)
    for keys, clash, name in ((["image_id", "class_id"], _overlaps(cfg.nms_iou), "nms_same_class"), (["image_id"], _one_device(cfg), "duplicate_class_claim")):
        rows = greedy_mark(rows, keys, _by_score(), clash, alive)
        rows = rows.withColumn("drop_reason", F.when(alive & ~F.col("kept"), name).otherwise(F.col("drop_reason"))).drop("kept")
    rows = judge(rows.withColumnRenamed("drop_reason", "__before").withColumn("__class", F.col("class_id")), classes, cfg)
    fresh = F.col("__before").isNull()
    rows = rows.withColumns({"drop_reason": F.coalesce("__before", "drop_reason"), "demoted_from": F.when(fresh, F.col("demoted_from")), "class_id": F.when(fresh, F.col("class_id")).otherwise(F.col("__class"))}).drop("__before", "__class")
    best = Window.partitionBy("image_id").orderBy(F.when(alive, 0).otherwise(1), F.desc("score"), "det_id")
    rows = rows.withColumn("__rank", F.row_number().over(best))
    rows = rows.withColumn("drop_reason", F.when(alive & (F.col("__rank") > cfg.cap), "over_detection_cap").otherwise(F.col("drop_reason"))).drop("__rank")
    rows = rows.withColumn("demoted_from", F.when(alive, F.col("demoted_from")))
    return group_rows(rows, cfg.row_tolerance, alive).select(*base, "drop_reason", "demoted_from", "row_no", "pos_in_row")


def diagnostics(gated: DataFrame) -> DataFrame:
    """reason, n over all frames, with accepted and relabelled_unknown among the reasons."""
    reason = F.coalesce("drop_reason", F.lit("accepted"))
    return gated.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).unionByName(gated.where("drop_reason is null and demoted_from is not null").agg(F.count("*").alias("n")).select(F.lit("relabelled_unknown").alias("reason"), "n"))


def agree_across_sources(cands: DataFrame, iou: float = 0.55, gain: float = 0.35, most: float = 0.99) -> DataFrame:
    """Adds n_sources (other sources with an overlapping box of the class) and fused_score, raised by each of them."""
    a, b = cands.alias("a"), cands.select("image_id", "class_id", F.col("source").alias("osource"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    near = a.join(b, ["image_id", "class_id"]).where((F.col("source") != F.col("osource")) & (g.iou(g.box(), g.box("o")) >= iou))
    n = near.groupBy("image_id", "det_id").agg(F.count_distinct("osource").alias("n_sources"))
    out = cands.join(n, ["image_id", "det_id"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    return out.withColumn("fused_score", F.when(F.col("n_sources") > 0, F.least(F.lit(most), F.col("score") + (1 - F.col("score")) * gain * F.col("n_sources"))).otherwise(F.col("score")))


def refine_reason(orig: g.Box, new: g.Box, ar_lo: Column, ar_hi: Column, growth: float = 1.6, least_area: float = 0.35, drift: float = 0.35, slack: float = 1.5) -> Column:
    """Why a refined box is not taken (null if it is): grown, shrunk, moved or of an unlikely shape, in that order."""
    ratio = F.try_divide(g.area(new), g.area(orig))
    (ax, ay), (bx, by) = g.centre(orig), g.centre(new)
    shape = F.try_divide(g.width(new), g.height(new))
    return (
        F.when((g.width(new) <= 1) | (g.height(new) <= 1), "degenerate")
        .when(ratio > growth, "grew_too_much")
        .when(ratio < least_area, "shrank_too_much")
        .when(g.distance(ax, ay, bx, by) > drift * F.hypot(g.width(orig), g.height(orig)), "moved_too_far")
        .when((shape < ar_lo / slack) | (shape > ar_hi * slack), "implausible_shape")
    )
