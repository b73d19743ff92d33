"""Annotated-dataset jobs: validation, coverage, merging, near-duplicates, leak-free splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.graph import connected_components
from sightline.plans.lineage import materialize, scratch_path
from sightline.plans.near_hashes import diameters, near_pairs
from sightline.plans.skew import running

KEEP_ORDER = ("train", "val", "test")
TRAINABLE, RELIABLE, PER_IMAGE = 50, 300, 12.0


def label_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds n_fields, cls, cx, cy, w, h of an annotation line; a field that is no number is null."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    return lines.withColumns({"n_fields": F.when(F.trim(line) == "", 0).otherwise(F.size(parts)), "cls": F.floor(number(1)).try_cast("int"), "cx": number(2), "cy": number(3), "w": number(4), "h": number(5)})


def row_issues(class_count: int, ceiling: float = 0.9, floor: float = 1e-5) -> Column:
    """Issues of a parsed row, as an array of codes: the first fatal one alone, else all warnings."""
    fatal = (
        F.when(F.col("n_fields") < 5, "malformed_row")
        .when(F.col("cls").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("w").isNull() | F.col("h").isNull(), "unparseable_row")
        .when(~F.col("cls").between(0, class_count - 1), "class_out_of_range")
        .when(~(F.col("cx").between(0, 1) & F.col("cy").between(0, 1)), "centre_out_of_range")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "degenerate_box")
        .when((F.col("w") > 1) | (F.col("h") > 1), "box_exceeds_image")
    )
    area = F.col("w") * F.col("h")
    out = lambda c, s: (F.col(c) - F.col(s) / 2 < -0.01) | (F.col(c) + F.col(s) / 2 > 1.01)
    warnings = F.array_compact(F.array(F.when(area > ceiling, "box_covers_frame").when(area < floor, "box_too_small"), F.when(out("cx", "w") | out("cy", "h"), "box_outside_frame")))
    return F.when(fatal.isNotNull(), F.array(fatal)).otherwise(warnings)


def image_issues(stats: DataFrame) -> DataFrame:
    """Adds issues, from size and brightness statistics: 0 or more codes an image."""
    ratio = F.greatest("w", "h") / F.least("w", "h")
    checks = (
        F.when(F.least("w", "h") < 320, "image_too_small"),
        F.when(ratio > 4, "extreme_aspect"),
        F.when(F.col("luma_mean") < 30, "too_dark").when(F.col("luma_mean") > 225, "too_bright"),
        F.when(F.col("clipped_frac") > 0.35, "clipped"),
        F.when(F.col("laplacian_var") < 40, "blurred"),
        F.when(F.col("luma_std") < 8, "featureless"),
    )
    return stats.withColumn("issues", F.array_compact(F.array(*checks)))


def analyse(labels: DataFrame, image: str = "image_id") -> DataFrame:
    """class_id, instances, images, and mean, least and greatest relative area."""
    area = F.col("w") * F.col("h")
    return labels.groupBy("class_id").agg(F.count("*").alias("instances"), F.count_distinct(image).alias("images"), F.avg(area).alias("mean_area"), F.min(area).alias("min_area"), F.max(area).alias("max_area"))


def balance(per_class: DataFrame, least: int = 20) -> DataFrame:
    """most and least common class, their ratio, and how many classes are below ``least`` instances. Ties by name."""
    key = lambda sign: F.struct((sign * F.col("instances")).alias("n"), "class_id")
    return per_class.agg(F.min_by("class_id", key(-1)).alias("most_common"), F.min_by("class_id", key(1)).alias("least_common"), (F.max("instances") / F.greatest(F.min("instances"), F.lit(1))).alias("ratio"), F.count_if(F.col("instances") < least).alias("n_small"))


def coverage(classes: DataFrame, per_class: DataFrame, target: int = RELIABLE) -> DataFrame:
    """class_id, instances, status, shortfall and images to collect, for every class of the label space."""
    rows = classes.select("class_id").join(per_class.select("class_id", "instances"), "class_id", "left").fillna(0, ["instances"])
    n = F.col("instances")
    status = F.when(n == 0, "absent").when(n < TRAINABLE, "untrainable").when(n < target, "weak").otherwise("reliable")
    need = F.greatest(F.lit(0), F.lit(target) - n)
    return rows.select("class_id", "instances", status.alias("status"), need.alias("shortfall"), F.ceil(need / PER_IMAGE).alias("images_needed"))


def remap(labels: DataFrame, class_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with the mapped class, dropped labels). ``class_map``: cls, class_id; a bounded label space."""
    m = class_map.select(F.col("cls").alias("__c"), F.col("class_id"))
    on = F.col("cls") == F.col("__c")
    return labels.join(m, on).drop("__c"), labels.join(m, on, "left_anti")


def merge(datasets: Sequence[DataFrame], name: str = "filename") -> DataFrame:
    """Union of datasets, file names prefixed s0_, s1_, ... so that equal names stay apart."""
    out = None
    for k, df in enumerate(datasets):
        own = df.withColumn(name, F.concat(F.lit(f"s{k}_"), name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def _hashes(images: DataFrame, row_id: str, h: str, other: str | None, sha: str) -> DataFrame:
    """i, h, o, s of the images, as a written table: several steps read it."""
    return materialize(images.select(F.col(row_id).alias("i"), F.col(h).cast("long").alias("h"), (F.col(other) if other else F.lit(0)).cast("long").alias("o"), F.col(sha).alias("s")), "hashes")


def _linked(rows: DataFrame, threshold: int, exact: bool, forest: bool) -> DataFrame:
    first = rows.groupBy("s").agg(F.min("i").alias("a"))
    copies = rows.join(first, "s").where("i <> a").select("a", F.col("i").alias("b"))
    nodes = rows.where("h is not null and o is not null").groupBy("h", "o").agg(F.min("i").alias("i"))
    same = rows.join(nodes.withColumnRenamed("i", "a"), ["h", "o"]).where("i <> a").select("a", F.col("i").alias("b"))
    near = near_pairs(nodes, threshold, 2 * threshold, exact, forest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return copies.union(same).union(near)


def hash_links(images: DataFrame, row_id: str = "image_id", h: str = "dhash", other: str | None = "ahash", sha: str = "sha", threshold: int = 5, exact: bool = False) -> DataFrame:
    """a, b (a < b): rows that share a 16-bit slice of the hash and differ in at most ``threshold`` bits, or have equal content.

    Four slices find every pair of up to 3 differing bits; of pairs with 4 or 5 they miss those that differ in each
    slice (10 and 25 % of random ones). With ``exact`` none is missed: the hash is cut into threshold + 2 lanes, of which
    two at least are equal, and rows meet by pairs of lanes. Slices that many rows share are dealt anew by their other bits.

    Equal content is linked to its least row only. Near links are sought between distinct hashes, so that many copies of
    one hash are one node: of rows with one hash the least stands for all. Rows without a hash have links by content only.
    """
    return _linked(_hashes(images, row_id, h, other, sha), threshold, exact, forest=False).distinct()


def duplicate_groups(images: DataFrame, row_id: str = "image_id", h: str = "dhash", other: str | None = "ahash", sha: str = "sha", threshold: int = 5, exact: bool = False) -> DataFrame:
    """row_id, group_id (least row), kind, max_distance; rows in groups only.

    Groups are what ``hash_links`` connect, of which only as many are made as that takes. kind is *exact* if every pair
    of the group has equal content, else *near*; max_distance is the most bits in which two hashes of the group differ.
    """
    rows = _hashes(images, row_id, h, other, sha)
    parts = connected_components(_linked(rows, threshold, exact, forest=True), "a", "b")
    own = materialize(rows.select(F.col("i").alias("node"), "s", "h").join(parts, "node"), "grouped")
    kind = own.groupBy("component").agg(F.when((F.min("s") == F.max("s")) & (F.count("s") == F.count("*")), "exact").otherwise("near").alias("kind"))
    far = diameters(own.where("h is not null"), "component", "h")
    out = own.join(kind, "component").join(far, "component", "left")
    return out.select(F.col("node").alias(row_id), F.col("component").alias("group_id"), "kind", F.coalesce("max_distance", F.lit(0)).alias("max_distance"))


def _scan_order(row_id: str, split: str, name: str) -> Column:
    rank = F.array_position(F.array(*map(F.lit, KEEP_ORDER)), F.col(split))
    return F.struct(F.when(F.coalesce(rank, F.lit(0)) == 0, 9).otherwise(rank).alias("r"), F.col(name).alias("n"), F.col(row_id).alias("i"))


def label_conflicts(images: DataFrame, groups: DataFrame, signatures: DataFrame, row_id: str = "image_id") -> DataFrame:
    """group_id of the groups whose members' labels disagree. ``signatures``: row_id, signature; a row without one has no labels."""
    own = groups.select(row_id, "group_id").join(images.select(row_id), row_id).join(signatures.select(row_id, "signature"), row_id, "left")
    text = F.coalesce("signature", F.lit(""))
    return own.groupBy("group_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("group_id")


def keep_one(images: DataFrame, groups: DataFrame, row_id: str = "image_id", split: str = "split", name: str = "filename", keep: str = "train_first", whole: DataFrame | None = None) -> DataFrame:
    """``images`` without the redundant rows of each group.

    ``keep``: with *train_first* training copies stay before others, so that no test image is seen; with *first* the least
    row stays. Groups of ``whole`` (group_id), as those of ``label_conflicts``, stay in full: to choose one of two labels
    is not for a program.
    """
    if keep not in ("train_first", "first"):
        raise ValueError(f"keep must be train_first or first, not {keep!r}")
    cut = groups.select(row_id, "group_id") if whole is None else groups.select(row_id, "group_id").join(whole.select("group_id"), "group_id", "left_anti")
    order = _scan_order(row_id, split, name) if keep == "train_first" else F.col(row_id)
    best = images.join(cut, row_id).groupBy("group_id").agg(F.min_by(row_id, order).alias("__best"))
    gone = cut.join(best, "group_id").where(F.col(row_id) != F.col("__best")).select(row_id)
    return images.join(gone, row_id, "left_anti")


def duplicate_report(images: DataFrame, groups: DataFrame, signatures: DataFrame | None = None, row_id: str = "image_id", split: str = "split") -> DataFrame:
    """One row: images, groups, exact and near ones, redundant rows and their share, groups and images over several splits, groups whose labels disagree, largest distance."""
    per = images.join(groups, row_id).groupBy("group_id", "kind", "max_distance").agg(F.count("*").alias("n"), (F.min(split) != F.max(split)).alias("across"))
    clash = label_conflicts(images, groups, signatures, row_id) if signatures is not None else per.where("false").select("group_id")
    per = per.join(clash.withColumn("clash", F.lit(True)), "group_id", "left")
    sums = per.agg(
        F.count("*").alias("groups"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "near").alias("near"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"),
        F.count_if("across").alias("cross_split"), F.coalesce(F.sum(F.when(F.col("across"), F.col("n"))), F.lit(0)).alias("cross_images"), F.count_if("clash").alias("label_conflicts"), F.coalesce(F.max("max_distance"), F.lit(0)).alias("max_distance"),
    )
    n = images.count()
    return sums.select(F.lit(n).alias("images"), "*", (F.col("redundant") / max(1, n)).alias("redundancy"))


def redundant_by_split(images: DataFrame, groups: DataFrame, row_id: str = "image_id", split: str = "split", name: str = "filename") -> DataFrame:
    """split, redundant: the rows of groups but for the first of each, in the order of splits and names."""
    own = images.join(groups.select(row_id, "group_id"), row_id)
    first = own.groupBy("group_id").agg(F.min(_scan_order(row_id, split, name)).alias("f"))
    return own.join(first, "group_id").where(F.col(row_id) != F.col("f.i")).groupBy(split).agg(F.count("*").alias("redundant"))


class Quotas:
    """What the splits have so far, and which of them the next group goes to: that which is furthest below its share.

    The shortfall of a split sums, over the classes that a group has, what is missing to the split's share, weighed by one
    over the root of the class's total, so rare classes decide. Of equal shortfalls the split with fewer groups is next.
    """

    def __init__(self, overall: dict[object, int], ratios: Sequence[float]):
        self.overall, self.share = overall, [r / sum(ratios) for r in ratios]
        self.have: list[dict[object, int]] = [{} for _ in ratios]
        self.groups = [0] * len(ratios)

    def _place(self, classes: Sequence[tuple[object, int]], split: int) -> tuple[float, int]:
        """The greatest is next."""
        if not classes:
            return -self.groups[split] / max(self.share[split], 1e-9), 0
        short = 0.0
        for c, _ in classes:
            short += (self.overall[c] * self.share[split] - self.have[split].get(c, 0)) * (1.0 / math.sqrt(self.overall[c]))
        return short, -self.groups[split]

    def _take(self, classes: Sequence[tuple[object, int]], split: int, n: int) -> None:
        self.groups[split] += n
        for c, k in classes:
            self.have[split][c] = self.have[split].get(c, 0) + k * n

    def _sure(self, classes: Sequence[tuple[object, int]], m: int) -> list[int]:
        """Groups that each split gets for sure of ``m`` alike: a group lowers a split's place by a fixed step, so the ``m`` highest places are taken."""
        at = [self._place(classes, s)[0] for s in range(len(self.share))]
        step = [sum(k / math.sqrt(self.overall[c]) for c, k in classes) if classes else 1 / max(x, 1e-9) for x in self.share]
        low, high = min(at) - m * max(step), max(at)
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(max(0.0, (a - mid) / d) for a, d in zip(at, step, strict=True)) > m else (mid, high)
        return [max(0, math.floor((a - high) / d) - 2) for a, d in zip(at, step, strict=True)]

    def deal(self, classes: Sequence[tuple[object, int]], m: int) -> list[int]:
        """How many of ``m`` groups with the same ``classes`` (class, instances) go to each split, as if they came one by one."""
        out = self._sure(classes, m) if m > 16 else [0] * len(self.share)
        if sum(out) > m:
            out = [0] * len(self.share)
        for split, n in enumerate(out):
            self._take(classes, split, n)
        for _ in range(m - sum(out)):
            split = max(range(len(self.share)), key=lambda s: self._place(classes, s))
            self._take(classes, split, 1)
            out[split] += 1
        return out


#: Signatures that the driver deals before it writes them.
ROUND = 50_000


def assign_groups(group_classes: DataFrame, ratios: Sequence[float] = (0.7, 0.2, 0.1), group: str = "group_key", seed: int = 0) -> DataFrame:
    """group, split: whole groups to train, val or test, those with rare classes first, each to the split furthest below its share.

    ``group_classes``: group, class_id, n (n null for a group without labels; those come last and go by the number of
    groups). Groups of equal class counts are alike, and are dealt together: the choices, each of which depends on those
    before, are made for distinct counts, not for groups; which of the alike go where is by chance of group and seed. The
    order is that of the rarest class's total, then of the counts. The distinct counts pass the driver in rounds of ROUND.
    """
    spark = group_classes.sparkSession
    known = F.col("n").isNotNull() & (F.col("n") > 0)
    counted = group_classes.groupBy(group, "class_id").agg(F.sum("n").alias("n"))
    total = counted.where(known).groupBy("class_id").agg(F.sum("n").alias("t"))
    one = F.when(known, F.struct("class_id", "n"))
    per = counted.join(total, "class_id", "left").groupBy(group).agg(F.min(F.when(known, F.col("t"))).alias("rarity"), F.array_sort(F.collect_list(one)).alias("counts"))
    per = materialize(per.withColumn("alike", F.to_json("counts")), "groups")
    quotas = Quotas({r["class_id"]: r["t"] for r in total.collect()}, ratios)  # a label space
    alike = per.groupBy("rarity", "alike").agg(F.first("counts").alias("counts"), F.count("*").alias("m")).orderBy(F.col("rarity").asc_nulls_last(), "alike")
    path, rows = scratch_path(spark, "dealt"), []
    schema = "alike string, train long, val long"

    def flush() -> None:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        rows.clear()

    for r in alike.toLocalIterator():
        train, val, _ = quotas.deal([(c["class_id"], c["n"]) for c in r["counts"]], r["m"])
        rows.append((r["alike"], train, val))
        if len(rows) >= ROUND:
            flush()
    flush()
    placed = running(per.select(group, "alike"), ["alike"], seed, group).join(spark.read.schema(schema).parquet(path), "alike")
    at = F.col("before")
    return placed.select(group, F.when(at < F.col("train"), KEEP_ORDER[0]).when(at < F.col("train") + F.col("val"), KEEP_ORDER[1]).otherwise(KEEP_ORDER[2]).alias("split"))


def group_report(images: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    """Groups, mean size and how many lie in more than one split."""
    per = images.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(split).alias("k"))
    return per.agg(F.count("*").alias("groups"), F.avg("n").alias("mean_size"), F.count_if(F.col("k") > 1).alias("leaking"))


def mix_synthetic(real: DataFrame, synthetic: DataFrame, fraction: float, name: str = "filename", split: str = "split", seed: int = 0) -> DataFrame:
    """Real rows and as many synthetic training rows as make ``fraction`` of the training set (halves up), the first by chance of name and seed."""
    n = real.where(F.col(split) == "train").count()
    want = math.floor(fraction / (1 - fraction) * n + 0.5) if fraction < 1 else synthetic.count()
    chosen = running(synthetic.where(F.col(split) == "train"), [split], seed, name).where(F.col("before") < want).drop("before", "total")
    return real.withColumn("synthetic", F.lit(False)).unionByName(chosen.withColumn("synthetic", F.lit(True)), allowMissingColumns=True)


def stratified_split(df: DataFrame, stratum: str, row_id: str, train: float = 0.64, val: float = 0.16, seed: int = 0) -> DataFrame:
    """Adds split: within each stratum rows are ordered by chance of id and seed and cut at the shares."""
    at = F.col("before") / F.col("total")
    out = running(df, [stratum], seed, row_id)
    return out.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test")).drop("before", "total")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: names that repeat get _1, _2, ... in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), k.cast("string"))))


def triage(boxes: DataFrame, image: str = "image_id", review: float = 0.15, accept: float = 0.35, unknown: str = "unknown_industrial_component") -> tuple[DataFrame, DataFrame]:
    """(boxes with ``needs_review`` or ``to_sidecar``, a verdict for each image: empty, uncertain, review or auto)."""
    kept = boxes.where(F.col("score") >= review).withColumn("to_sidecar", F.col("class_id") == unknown).withColumn("needs_review", F.col("score") < accept)
    per = kept.groupBy(image).agg(F.count_if(~F.col("to_sidecar")).alias("n"), F.bool_or("to_sidecar").alias("u"), F.bool_or("needs_review").alias("r"), F.min("score").alias("least"))
    every = boxes.select(image).distinct().join(per, image, "left")
    verdict = F.when(F.coalesce("n", F.lit(0)) == 0, F.when(F.coalesce("u", F.lit(False)), "uncertain").otherwise("empty")).when(F.col("u"), "uncertain").when(F.col("r"), "review").otherwise("auto")
    return kept, every.select(image, verdict.alias("verdict"), "least")


def quarantine(images: DataFrame, issues: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(clean images, quarantined images): those with a fatal issue are set apart, none is deleted."""
    bad = issues.where("severity = 'fatal'").select(key).distinct()
    return images.join(bad, key, "left_anti"), images.join(bad, key, "left_semi")


def label_space(smaller: DataFrame, larger: DataFrame) -> DataFrame:
    """One row on two ordered label spaces (ordinal, class_id): is_prefix, first_divergence, added, removed."""
    a, b = (df.select(F.col("ordinal"), F.col("class_id").alias(n)) for df, n in ((smaller, "x"), (larger, "y")))
    both = a.join(b, "ordinal", "full_outer")
    off = F.when(F.col("x").isNotNull() & (F.col("y").isNull() | (F.col("x") != F.col("y"))), F.col("ordinal"))
    return both.agg(F.min(off).isNull().alias("is_prefix"), F.min(off).alias("first_divergence"), F.array_sort(F.array_except(F.collect_set("y"), F.collect_set("x"))).alias("added"), F.array_sort(F.array_except(F.collect_set("x"), F.collect_set("y"))).alias("removed"))


def export_reviewed(boxes: DataFrame, verdicts: DataFrame, states: DataFrame, include_pending: bool = False) -> DataFrame:
    """Boxes to export after review: rejected ones and images that need redrawing stay out, pending images too unless asked."""
    last = verdicts.select("image_id", "box_index", "verdict", F.col("class_id").alias("new_class"))
    rows = boxes.join(last, ["image_id", "box_index"], "left").join(states.select("image_id", "state"), "image_id", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    ok = (F.col("state") != "needs_redraw") & (F.lit(include_pending) | (F.col("state") != "pending")) & (F.coalesce("verdict", F.lit("accept")) != "reject")
    return rows.where(ok).withColumn("class_id", F.when(F.col("verdict") == "relabel", F.col("new_class")).otherwise(F.col("class_id"))).where(F.col("class_id").isNotNull()).select("image_id", "box_index", "class_id")
