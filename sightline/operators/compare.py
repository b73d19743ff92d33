"""Comparing what is observed with a reference: counts, components, wires, objects, text, and graphs of connections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g


def count_diff(expected: DataFrame, observed: DataFrame, keys: Sequence[str] = ("kind", "name")) -> DataFrame:
    """keys, expected, found, type: components missing, extra or of a wrong count; wire colours missing or unexpected."""
    both = expected.select(*keys, F.col("n").alias("expected")).join(observed.select(*keys, F.col("n").alias("found")), list(keys), "full_outer").fillna(0, ["expected", "found"])
    e, f, part = F.col("expected"), F.col("found"), F.col("kind") == "component"
    kind = (
        F.when((e > 0) & (f == 0), F.when(part, "missing_component").otherwise("missing_wire_color"))
        .when((f > 0) & (e == 0), F.when(part, "extra_component").otherwise("unexpected_wire_color"))
        .when(part & (e != f), "wrong_count")
    )
    return both.withColumn("type", kind).where("type is not null")


def count_status(diff: DataFrame) -> DataFrame:
    """status and n: components that differ fail, wire colours alone warn."""
    hard = F.count_if(F.col("type").isin("missing_component", "extra_component", "wrong_count"))
    return diff.agg(F.count("*").alias("n"), F.when(hard > 0, "fail").when(F.count("*") > 0, "warning").otherwise("pass").alias("status"))


def greedy_assign(refs: DataFrame, pairs: DataFrame, panel: str, ref_id: str, obs_id: str, cost: str) -> DataFrame:
    """panel, ref_id, obs_id (null: none left), cost: references in order of id take the cheapest free partner, ties by id.

    One ``aggregate()`` over the references of a panel; a panel's parts are few, however many panels there are.
    """
    options = pairs.groupBy(panel, ref_id).agg(F.array_sort(F.collect_list(F.struct(F.col(cost).alias("c"), F.col(obs_id).alias("o")))).alias("options"))
    rows = refs.select(panel, ref_id).join(options, [panel, ref_id], "left")
    all_refs = rows.groupBy(panel).agg(F.array_sort(F.collect_list(F.struct(F.col(ref_id).alias("r"), "options"))).alias("all"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("used"), F.expr("cast(array() as array<struct<r:bigint,o:bigint,c:double>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        free = F.get(F.filter(F.coalesce(r["options"], F.expr("cast(array() as array<struct<c:double,o:bigint>>)")), lambda x: ~F.array_contains(acc["used"], x["o"])), F.lit(0))
        used = F.when(free.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(free["o"])))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(r["r"].alias("r"), free["o"].alias("o"), free["c"].alias("c")))).alias("out"))

    out = all_refs.select(panel, F.explode(F.aggregate("all", start, step)["out"]).alias("m"))
    return out.select(panel, F.col("m.r").alias(ref_id), F.col("m.o").alias(obs_id), F.col("m.c").alias(cost))


def component_diff(refs: DataFrame, obs: DataFrame, within: float = 60.0, moved: float = 25.0, turned: float = 20.0) -> DataFrame:
    """panel_id, ref_id, obs_id, type, severity: components missing, wrong, moved, rotated or extra.

    Both tables: panel_id, ref_id or obs_id, comp_type, cx, cy, rotation; observed centres in the reference's frame.
    """
    o = obs.select("panel_id", "obs_id", F.col("comp_type").alias("otype"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("rotation").alias("orot"))
    near = refs.join(o, "panel_id").withColumn("dist", g.distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy"))).where(F.col("dist") < within)
    m = greedy_assign(refs, near, "panel_id", "ref_id", "obs_id", "dist")
    rows = m.join(refs, ["panel_id", "ref_id"]).join(o, ["panel_id", "obs_id"], "left")
    one = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))
    same = F.col("comp_type") == F.col("otype")
    found = F.when(F.col("obs_id").isNull(), F.array(one("missing_component", "error"))).when(~same, F.array(one("wrong_component", "error"))).otherwise(
        F.array_compact(F.array(F.when(F.col("dist") > moved, one("moved_component", "warning")), F.when(g.axis_difference(F.col("rotation"), F.col("orot")) > turned, one("wrong_rotation", "warning"))))
    )
    errors = rows.select("panel_id", "ref_id", "obs_id", F.explode(found).alias("e")).select("panel_id", "ref_id", "obs_id", "e.type", "e.severity")
    extra = o.join(m.where("obs_id is not null").select("panel_id", "obs_id"), ["panel_id", "obs_id"], "left_anti")
    return errors.unionByName(extra.select("panel_id", F.lit(None).cast("long").alias("ref_id"), "obs_id", F.lit("extra_component").alias("type"), F.lit("error").alias("severity")))


def wire_cost(prefix: str = "o") -> Column:
    """Distance of an observed wire (osx, osy, oex, oey) from a reference wire (sx, sy, ex, ey), whichever way round."""
    s, e = (F.col("sx"), F.col("sy")), (F.col("ex"), F.col("ey"))
    a, b = (F.col(f"{prefix}sx"), F.col(f"{prefix}sy")), (F.col(f"{prefix}ex"), F.col(f"{prefix}ey"))
    ends = F.least(g.distance(*s, *a) + g.distance(*e, *b), g.distance(*s, *b) + g.distance(*e, *a))
    mid = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    beside = F.greatest(g.point_segment(*mid, *s, *e), g.point_segment(*a, *s, *e) * 0.5, g.point_segment(*b, *s, *e) * 0.5)
    aligned = g.axis_difference(g.angle(*s, *e), g.angle(*a, *b)) < 30
    return F.when(aligned, F.least(ends, 2.0 * beside)).otherwise(ends)


def wire_matches(refs: DataFrame, obs: DataFrame, end_dist: float = 45.0) -> DataFrame:
    """The reference wires with obs_id (null: none is near), dist, and the columns of the observed wire as o..."""
    o = obs.select("panel_id", "obs_id", *[F.col(c).alias(f"o{c}") for c in obs.columns if c not in ("panel_id", "obs_id")])
    near = refs.join(o, "panel_id").withColumn("dist", wire_cost()).where(F.col("dist") < 2 * end_dist)
    m = greedy_assign(refs, near, "panel_id", "ref_id", "obs_id", "dist")
    return m.join(refs, ["panel_id", "ref_id"]).join(o, ["panel_id", "obs_id"], "left")


def wire_diff(refs: DataFrame, obs: DataFrame, end_dist: float = 45.0, broken: float = 0.6, matched: DataFrame | None = None) -> DataFrame:
    """panel_id, ref_id, obs_id, type: wires missing, broken (far shorter), of another colour, or extra. ``matched``: ``wire_matches``, if it is known."""
    rows = wire_matches(refs, obs, end_dist) if matched is None else matched
    other = (F.col("color") != F.col("ocolor")) & (F.col("color") != "unknown") & (F.col("ocolor") != "unknown")
    kinds = F.when(F.col("obs_id").isNull(), F.array(F.lit("missing_wire"))).otherwise(F.array_compact(F.array(F.when(F.try_divide("olength", "length") < broken, "broken_wire"), F.when(other, "wrong_wire_color"))))
    errors = rows.select("panel_id", "ref_id", "obs_id", F.explode(kinds).alias("type"))
    extra = obs.select("panel_id", "obs_id").join(rows.where("obs_id is not null").select("panel_id", "obs_id"), ["panel_id", "obs_id"], "left_anti")
    return errors.unionByName(extra.select("panel_id", F.lit(None).cast("long").alias("ref_id"), "obs_id", F.lit("extra_wire").alias("type")))


def endpoint_issues(matched: DataFrame) -> DataFrame:
    """Adds issues of matched wires whose ends are elsewhere than expected.

    rs, re and os, oe: terminals of start and end as expected and as seen. If there are rsc, rec, osc and oec, too, the
    components, those tell where no terminal is known at the start: *wrong_terminal*, whichever way round the wire is.
    """
    differs = lambda want, have, opposite: F.col(want).isNotNull() & F.col(have).isNotNull() & (F.col(want) != F.col(have)) & ~F.col(opposite).eqNullSafe(F.col(want))
    kinds = [F.when(differs("rs", "os", "oe"), "wrong_source"), F.when(differs("re", "oe", "os"), "wrong_destination")]
    if {"rsc", "rec", "osc", "oec"} <= set(matched.columns):
        is_ = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        same = (is_("rsc", "osc") & is_("rec", "oec")) | (is_("rsc", "oec") & is_("rec", "osc"))
        bare = F.col("rs").isNull() & F.col("os").isNull() & F.col("rsc").isNotNull() & F.col("osc").isNotNull()
        kinds.append(F.when(bare & ~same, "wrong_terminal"))
    return matched.withColumn("issues", F.array_compact(F.array(*kinds)))


#: Confidence of what is compared in the reference's frame, and without a transform.
ALIGNED, RAW = 1.0, 0.65


def align(rows: DataFrame, transforms: DataFrame, *points: tuple[str, str], panel: str = "panel_id") -> DataFrame:
    """``rows`` with the named points in the reference's frame, and align: how sure that makes the comparison.

    ``transforms``: panel, h (the nine numbers of a homography by rows), one row for each panel that could be registered;
    the others stay as they are.
    """
    h = lambda k: F.col("__h")[k]
    out = rows.join(transforms.select(panel, F.col("h").alias("__h")), panel, "left")
    moved = {}
    for x, y in points:
        w = h(6) * F.col(x) + h(7) * F.col(y) + h(8)
        for name, k in ((x, 0), (y, 3)):
            at = F.try_divide(h(k) * F.col(x) + h(k + 1) * F.col(y) + h(k + 2), w)
            moved[name] = F.when(F.col("__h").isNull(), F.col(name)).otherwise(at)
    return out.withColumns(moved).withColumn("align", F.when(F.col("__h").isNull(), RAW).otherwise(ALIGNED)).drop("__h")


def nearest_distance(points: DataFrame, targets: DataFrame, key: Sequence[str], radius: float, panel: str = "panel_id") -> DataFrame:
    """``key`` and near: the distance of each point (panel, key, x, y) from the nearest target (panel, x, y) of its panel.

    Targets are in square cells of the radius, and a point looks into its own and the eight around; only points that
    find nothing within the radius meet all targets of their panel. A panel without targets has no row.
    """
    keys = [panel, *key]
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    t = targets.where("x is not null and y is not null").select(panel, F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    d = g.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    own = points.select(*keys, "x", "y")
    p = own.withColumn("o", around).withColumn("gx", cell("x") + F.col("o.i")).withColumn("gy", cell("y") + F.col("o.j"))
    close = p.join(t, [panel, "gx", "gy"]).withColumn("d", d).where(F.col("d") <= radius).groupBy(*keys).agg(F.min("d").alias("near"))
    far = own.join(close, keys, "left_anti").join(t, panel).groupBy(*keys).agg(F.min(d).alias("near"))
    return close.unionByName(far)


def connection_issues(matched: DataFrame, ref_terminals: DataFrame, obs_terminals: DataFrame, loose: float = 40.0, conf: Column | None = None) -> DataFrame:
    """panel_id, ref_id, side, type (loose_wire or disconnected_wire), severity, regression, confidence.

    Each end of a matched wire (sx, sy, ex, ey; osx ...) that the reference has at a terminal (rs, re not null) is compared
    with the end of the observed wire that is nearer to it: an end counts as loose if it is farther from the nearest
    observed terminal than the reference's end from its own, by more than ``loose``; as disconnected by twice that. So an
    equal panel is always clean. Panels without terminals on either side have no issues.
    """
    rows = matched.where("obs_id is not null")
    end = lambda side, x, y, at: F.struct(F.lit(side).alias("side"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(at).isNotNull().alias("on"))
    ends = rows.select("panel_id", "ref_id", "osx", "osy", "oex", "oey", F.inline(F.array(end("source", "sx", "sy", "rs"), end("destination", "ex", "ey", "re")))).where("on")
    first = g.distance(F.col("x"), F.col("y"), F.col("osx"), F.col("osy")) <= g.distance(F.col("x"), F.col("y"), F.col("oex"), F.col("oey"))
    seen = ends.select("panel_id", "ref_id", "side", F.when(first, F.col("osx")).otherwise(F.col("oex")).alias("x"), F.when(first, F.col("osy")).otherwise(F.col("oey")).alias("y"))
    key = ["ref_id", "side"]
    baseline = nearest_distance(ends, ref_terminals, key, 2 * loose).withColumnRenamed("near", "baseline")
    found = nearest_distance(seen, obs_terminals, key, 2 * loose).join(baseline, ["panel_id", *key]).withColumn("regression", F.col("near") - F.col("baseline"))
    cut = F.col("regression") > 2 * loose
    sure = F.lit(1.0) if conf is None else conf
    confidence = F.round(sure * F.least(F.lit(1.0), F.col("regression") / (3 * loose)), 3)
    return found.where(F.col("regression") > loose).select("panel_id", "ref_id", "side", F.when(cut, "disconnected_wire").otherwise("loose_wire").alias("type"), F.when(cut, "error").otherwise("warning").alias("severity"), "regression", confidence.alias("confidence"))


def object_diff(refs: DataFrame, cur: DataFrame, least_iou: float = 0.25, moved: float = 20.0) -> DataFrame:
    """image_id, ref_id, obs_id, type: objects missing, changed, moved or new. Both: image_id, id, label, box."""
    c = cur.select("image_id", "obs_id", F.col("label").alias("olabel"), *[F.col(k).alias(f"o{k}") for k in ("x1", "y1", "x2", "y2")])
    near = refs.join(c, "image_id").withColumn("cost", -g.iou(g.box(), g.box("o"))).where(F.col("cost") < -least_iou)
    m = greedy_assign(refs, near, "image_id", "ref_id", "obs_id", "cost")
    rows = m.join(refs, ["image_id", "ref_id"]).join(c, ["image_id", "obs_id"], "left")
    (ax, ay), (bx, by) = g.centre(g.box()), g.centre(g.box("o"))
    kind = F.when(F.col("obs_id").isNull(), "missing_object").when(F.col("label") != F.col("olabel"), "changed_object").when(g.distance(ax, ay, bx, by) > moved, "moved_object")
    diffs = rows.select("image_id", "ref_id", "obs_id", kind.alias("type")).where("type is not null")
    new = c.join(m.where("obs_id is not null").select("image_id", "obs_id"), ["image_id", "obs_id"], "left_anti")
    return diffs.unionByName(new.select("image_id", F.lit(None).cast("long").alias("ref_id"), "obs_id", F.lit("new_object").alias("type")))


def inspection_score(errors: DataFrame, elements: DataFrame, panel: str = "panel_id") -> DataFrame:
    """panel, n_err, n_warn, score, status: 1 - (errors + .4 warnings) / elements of the reference, at least 0."""
    n = errors.groupBy(panel).agg(F.count_if(F.col("severity") == "error").alias("n_err"), F.count_if(F.col("severity") == "warning").alias("n_warn"))
    rows = elements.join(n, panel, "left").fillna(0, ["n_err", "n_warn"])
    score = F.greatest(F.lit(0.0), 1 - (F.col("n_err") + 0.4 * F.col("n_warn")) / F.greatest("n_elements", F.lit(1)))
    return rows.select(panel, "n_err", "n_warn", score.alias("score"), F.when(F.col("n_err") > 0, "fail").when(F.col("n_warn") > 0, "warning").otherwise("pass").alias("status"))


def element_status(elements: DataFrame, errors: DataFrame, key: str, order: str) -> DataFrame:
    """Adds status: the last error that names an element, else ok."""
    last = errors.groupBy(F.col("target").alias(key)).agg(F.max_by("type", order).alias("__t"))
    return elements.join(last, key, "left").withColumn("status", F.coalesce("__t", F.lit("ok"))).drop("__t")


def text_in_boxes(items: DataFrame, boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """image_id, item_id, det_id: the box that holds most of a piece of text, at least that share; of equals the last."""
    b = boxes.select("image_id", "det_id", *[F.col(k).alias(f"b{k}") for k in ("x1", "y1", "x2", "y2")])
    held = items.join(b, "image_id").withColumn("share", g.containment(g.box(), g.box("b"))).where(F.col("share") >= least)
    return held.groupBy("image_id", "item_id").agg(F.max_by("det_id", F.struct("share", "det_id")).alias("det_id"))


def nearest_within(points: DataFrame, targets: DataFrame, panel: str, point_id: str, target_id: str, radius: float) -> DataFrame:
    """point_id, target_id: the nearest target closer than ``radius``, of equals the first.

    Targets are put into square cells of the radius and each point looks into its own and the eight around it.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    t = targets.select(panel, target_id, F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = points.withColumn("o", around).withColumn("gx", cell("x") + F.col("o.i")).withColumn("gy", cell("y") + F.col("o.j"))
    near = p.join(t, [panel, "gx", "gy"]).withColumn("d", g.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))).where(F.col("d") < radius)
    return near.groupBy(panel, point_id).agg(F.min_by(target_id, F.struct("d", target_id)).alias(target_id))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, neighbours (sorted), degree; nodes without edges too."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    sets = both.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    out = nodes.select("node").distinct().join(sets, "node", "left")
    return out.select("node", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"), F.coalesce(F.size("neighbours"), F.lit(0)).alias("degree"))


def wire_graph(components: DataFrame, terminals: DataFrame, wires: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): components and terminals; wires by terminal where one is known, else by component."""
    nodes = components.select(F.col("ref_id").alias("node"), F.lit("component").alias("kind"), F.col("comp_type").alias("type")).unionByName(terminals.select(F.col("ref_id").alias("node"), F.lit("terminal").alias("kind"), F.col("kind").alias("type")))
    edges = wires.select(F.col("wire_uid").alias("edge"), F.coalesce("from_terminal", "from_component").alias("src"), F.coalesce("to_terminal", "to_component").alias("dst"), "color")
    return nodes, edges


def expected_graph(tags: DataFrame, links: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of device documents; ends of connections that no tag names are nodes too."""
    named = tags.where("kind <> 'wire'").select(key, F.col("tag").alias("node"), "kind", "type")
    ends = links.select(key, F.col("src").alias("node")).union(links.select(key, "dst")).distinct()
    more = ends.join(named, [key, "node"], "left_anti").select(key, "node", F.lit("component").alias("kind"), F.lit("component").alias("type"))
    return named.unionByName(more), links.select(key, F.concat(F.lit("e"), "pos").alias("edge"), "src", "dst")


def similarity(ssim: Column, histogram: Column, hashes: Column, objects: Column) -> Column:
    """Blend of four likenesses of two images."""
    return 0.5 * ssim + 0.2 * histogram + 0.15 * hashes + 0.15 * objects


def pair_status(pairs: DataFrame, diffs: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``pairs`` with n_diffs and status: *identical* without a difference, *major* with one of that severity, else *minor*."""
    n = diffs.groupBy(pair).agg(F.count("*").alias("n_diffs"), F.count_if(F.col("severity") == "major").alias("__major"))
    rows = pairs.join(n, pair, "left").fillna(0, ["n_diffs", "__major"])
    return rows.withColumn("status", F.when(F.col("n_diffs") == 0, "identical").when(F.col("__major") > 0, "major").otherwise("minor")).drop("__major")


def drop_covered(wires: DataFrame, tolerance: float = 8.0, panel: str = "panel_id") -> DataFrame:
    """Wires but for those that run along a longer one kept before (half the tolerance across colours), longest first."""
    from sightline.operators.gate import greedy_keep

    def clash(k: Column, c: Column) -> Column:
        tol = F.when(k["color"] == c["color"], tolerance).otherwise(tolerance / 2)
        s, e = (k["sx"], k["sy"]), (k["ex"], k["ey"])
        mid = ((c["sx"] + c["ex"]) / 2, (c["sy"] + c["ey"]) / 2)
        return (g.point_segment(c["sx"], c["sy"], *s, *e) < tol) & (g.point_segment(c["ex"], c["ey"], *s, *e) < tol) & (g.point_segment(*mid, *s, *e) < tol)

    return greedy_keep(wires, [panel], [-F.col("length"), F.col("wire_id")], clash)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place by the given order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
