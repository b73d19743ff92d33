"""Jobs that chain operators: inspection and report of panels, gate experiments, references, derived label spaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import checks
from sightline.functions import geometry as g
from sightline.functions import panel_rules as rules
from sightline.operators import compare as cp
from sightline.operators import evaluation as ev
from sightline.operators import gate
from sightline.operators import identity as idn
from sightline.operators import inventory as inv
from sightline.plans.lineage import materialize
from sightline.plans.skew import joined_where_they_lie


def findings(accepted: DataFrame, panel: str = "image_id", reach: float = 2.8) -> DataFrame:
    """Accepted boxes with their neighbours' classes, purpose and place in the frame. Neighbours are sought per panel."""
    b = accepted.select(panel, F.col("det_id").alias("o"), F.col("class_id").alias("oc"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    (ax, ay), (bx, by) = g.centre(g.box()), g.centre(g.box("o"))
    near = (F.abs(ax - bx) <= reach * g.width(g.box())) & (F.abs(ay - by) <= reach * g.height(g.box())) & (F.col("det_id") != F.col("o"))
    sets = accepted.join(b, panel).where(near).groupBy(panel, "det_id").agg(F.array_sort(F.collect_set("oc")).alias("neighbours"))
    rows = accepted.join(sets, [panel, "det_id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
    return rows.withColumn("purpose", checks.purpose(F.col("class_id"), F.col("neighbours")))


def inspect(accepted: DataFrame, panel: str = "image_id") -> DataFrame:
    """panel, n, mean, median, unknown, panel_type, confidence, reason, notes, missing: what there is to say of each panel."""
    spark = accepted.sparkSession
    n = inv.counts(accepted, panel)
    scores = inv.rule_scores(n, rules.rule_weights(spark), rules.rule_classes(spark, rules.KEYSTONES), panel).withColumn("score", F.round("score", 9))
    devices = n.where(F.col("class_id") != gate.UNKNOWN).groupBy(panel).agg(F.sum("n").alias("n"))
    types = inv.classify(scores, devices, panel)
    absent = inv.missing(types, n, rules.rule_classes(spark, rules.EXPECTED), rules.IMPORTANT_ABSENCES, panel)
    gaps = absent.groupBy(panel).agg(F.array_sort(F.collect_list(F.struct("class_id", "severity"))).alias("missing"))
    names = sorted({c for w in rules.WEIGHTS.values() for c in w} | {"fuse_holder", "emergency_stop", "safety_relay"})
    wide = accepted.groupBy(panel).agg(*[F.count_if(F.col("class_id") == c).alias(f"n_{c}") for c in names], F.count_if(F.col("class_id") == gate.UNKNOWN).alias("u"), F.count("*").alias("t"))
    notes = wide.select(panel, checks.engineering_notes({c: F.col(f"n_{c}") for c in names}, F.col("u"), F.col("t")).alias("notes"))
    stats = inv.confidence_stats(accepted, panel).select(panel, "n", "mean", "median", "unknown")
    out = stats.join(types, panel).join(notes, panel).join(gaps, panel, "left")
    return out.withColumn("missing", F.coalesce("missing", F.array().cast("array<struct<class_id:string,severity:string>>")))


NOTE_SEVERITY = {"overload_mismatch": "important", "stop_without_safety_relay": "important", "no_earth_bar": "important", "supply_unprotected": "important", "some_unknown": "info", "no_wire_duct": "info"}


def report(inspected: DataFrame, panel: str = "image_id") -> DataFrame:
    """Inspection with its risk: panel, n, panel_type, n_missing, n_notes, score, level, assessable."""
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NOTE_SEVERITY.items() for x in kv]), F.col("code")), F.lit("advisory"))
    notes = inspected.select(panel, F.explode("notes").alias("code")).select(panel, severity.alias("severity"))
    absent = inspected.select(panel, F.explode("missing").alias("m")).select(panel, "m.class_id", "m.severity")
    risk = inv.risk(inspected.select(panel, "n", "mean", "unknown"), absent, notes, rules.SAFETY_CRITICAL, panel)
    return inspected.join(risk, panel).select(panel, "n", "panel_type", F.size("missing").alias("n_missing"), F.size("notes").alias("n_notes"), "score", "level", "assessable")


def legacy_gate(cands: DataFrame, least: float = 0.25, iou: float = 0.45) -> DataFrame:
    """The gate that the cascade replaced: one threshold for all classes and suppression across them."""
    return gate.nms_any_class(cands.where(F.col("score") >= least), iou)


def gate_experiment(gts: DataFrame, cands: DataFrame, classes: DataFrame, cfg: gate.GateConfig = gate.GateConfig()) -> DataFrame:
    """gate (old, new), tp, fp, fn, precision, recall, f1 of both gates over the same candidates."""
    base = ["image_id", "det_id", "class_id", "score", "x1", "y1", "x2", "y2"]
    good = gate.sanitise(cands, cfg).where("drop_reason is null").select(*base)
    new = gate.cascade(cands, classes, cfg).where("drop_reason is null").where(F.col("class_id") != gate.UNKNOWN).select(*base)
    out = None
    for name, preds in (("old", legacy_gate(good).select(*base)), ("new", new)):
        c = ev.class_counts(ev.match(gts, preds), gts).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        row = c.withColumns(ev.rates(F.col("tp"), F.col("fp"), F.col("fn"))).select(F.lit(name).alias("gate"), "tp", "fp", "fn", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def learn_template(components: DataFrame, images: Sequence[str] = ("image_id",)) -> DataFrame:
    """comp_type, expected, seen_in: most of each type in one image, and how many images show it."""
    n = components.groupBy(*images, "comp_type").agg(F.count("*").alias("n"))
    return n.groupBy("comp_type").agg(F.max("n").alias("expected"), F.count("*").alias("seen_in"))


def recognise(faces: DataFrame, gallery: DataFrame, threshold: float, margin: float, least_side: float = 20) -> DataFrame:
    """image_id, det_id, status, identity, confidence: suppression, size, quality, match. Faces: boxes with vec and crop statistics."""
    kept = gate.nms_largest(faces).where(F.least(g.width(g.box()), g.height(g.box())) >= least_side)
    reason = checks.crop_reason(F.least(g.width(g.box()), g.height(g.box())), F.col("score"), F.col("blur"), F.col("brightness"), F.col("over"), F.col("under"))
    rated = kept.withColumn("reason", reason)
    good = rated.where("reason is null")
    decided = idn.decide(idn.nearest(good, gallery, "det_id", "identity", "vec"), "det_id", "identity", threshold, margin)
    rows = rated.select("image_id", "det_id", "reason").join(decided, "det_id", "left")
    status = F.when(F.col("reason").isNotNull(), "low_quality").when(F.col("accepted").isNotNull(), "known").otherwise("unknown")
    return rows.select("image_id", "det_id", status.alias("status"), F.col("accepted").alias("identity"), F.when(F.col("accepted").isNotNull(), idn.match_confidence(F.col("similarity"), threshold)).alias("confidence"))


def reembed(stored: DataFrame, fresh: DataFrame, identity: str) -> DataFrame:
    """Stored vectors with those of every identity in ``fresh`` replaced by its fresh ones."""
    return stored.join(fresh.select(identity).distinct(), identity, "left_anti").unionByName(fresh.select(*stored.columns))


def derive_profile(labels: DataFrame, space: DataFrame, least: int) -> DataFrame:
    """ordinal, class_id, n: classes of a label space with at least ``least`` instances, in its order, numbered anew."""
    from pyspark.sql import Window

    n = labels.groupBy("class_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return space.join(n, "class_id").select((F.row_number().over(Window.orderBy("ordinal")) - 1).alias("ordinal"), "class_id", "n")


def panel_errors(refs: DataFrame, obs: DataFrame, wire_refs: DataFrame, wire_obs: DataFrame, transforms: DataFrame | None = None, ref_terminals: DataFrame | None = None, obs_terminals: DataFrame | None = None) -> DataFrame:
    """panel_id, target (id of the reference part, else of the observed one), type, severity of all that differs.

    With ``transforms`` (``compare.align``) what was observed is first put into the reference's frame. Where wires have
    terminals (rs, re of the reference; s, e of the observed), ends at the wrong place are reported, and with the tables of
    terminals (panel_id, x, y) loose and disconnected ends.
    """
    if transforms is not None:
        obs, wire_obs = cp.align(obs, transforms, ("cx", "cy")), cp.align(wire_obs, transforms, ("sx", "sy"), ("ex", "ey"))
        obs_terminals = obs_terminals if obs_terminals is None else cp.align(obs_terminals, transforms, ("x", "y"))
    parts = cp.component_diff(refs, obs).select("panel_id", F.coalesce("ref_id", "obs_id").alias("target"), "type", "severity")
    matched = materialize(cp.wire_matches(wire_refs, wire_obs), "wires")
    wires = cp.wire_diff(wire_refs, wire_obs, matched=matched)
    hard = F.col("type").isin("missing_wire", "broken_wire")
    out = parts.unionByName(wires.select("panel_id", F.coalesce("ref_id", "obs_id").alias("target"), "type", F.when(hard, "error").otherwise("warning").alias("severity")))
    if {"rs", "re", "os", "oe"} <= set(matched.columns):
        wrong = cp.endpoint_issues(matched.where("obs_id is not null")).select("panel_id", F.col("ref_id").alias("target"), F.explode("issues").alias("type"))
        out = out.unionByName(wrong.withColumn("severity", F.when(F.col("type") == "wrong_terminal", "warning").otherwise("error")))
        if ref_terminals is not None and obs_terminals is not None:
            out = out.unionByName(cp.connection_issues(matched, ref_terminals, obs_terminals).select("panel_id", F.col("ref_id").alias("target"), "type", "severity"))
    return out


def compare_panels(refs: DataFrame, obs: DataFrame, wire_refs: DataFrame, wire_obs: DataFrame, **more: DataFrame | None) -> DataFrame:
    """panel_id, n_err, n_warn, score, status of the ``panel_errors``."""
    elements = refs.select("panel_id").unionByName(wire_refs.select("panel_id")).groupBy("panel_id").agg(F.count("*").alias("n_elements"))
    refs, obs, wire_refs, wire_obs = (x.repartition("panel_id") for x in (refs, obs, wire_refs, wire_obs))  # all that follows is within a panel
    with joined_where_they_lie(refs.sparkSession):
        return materialize(cp.inspection_score(panel_errors(refs, obs, wire_refs, wire_obs, **more), elements), "panels")
