"""Vectors and identities."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import identity as idn
from sightline.registry import query
from sightline.views import view

R = lambda c, n=None, k=5: F.round(c, k).alias(n or c)
T, M = 0.15, 0.02
#: Unit vectors in double precision, and dot products, as DuckDB text.
UNITS = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) v from vectors)"
CENT = "c as (select label, list(m order by pos) v from (select label, pos, avg(x) m from (select label, unnest(v) x, generate_subscripts(v, 1) pos from u where vec_id % 5 <> 0 and label < 8) group by 1, 2) group by 1), cn as (select label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) v from c)"
RANK = "r as (select p.vec_id, p.label truth, cn.label, list_dot_product(p.v, cn.v) s, row_number() over (partition by p.vec_id order by list_dot_product(p.v, cn.v) desc, cn.label) k from u p cross join cn where p.vec_id % 5 = 0), dec as (select a.vec_id, a.truth, a.label closest, a.s similarity, a.s - coalesce(b.s, -1) margin from r a left join r b on b.vec_id = a.vec_id and b.k = 2 where a.k = 1)"
PAIRS = "sc as (select case when a.label = b.label then 'genuine' else 'impostor' end kind, a.vec_id a, b.vec_id b, round(list_dot_product(a.v, b.v), 5) s from u a join u b on a.vec_id < b.vec_id)"


def _gallery(v: DataFrame) -> DataFrame:
    return idn.centroids(v.where("vec_id % 5 <> 0 and label < 8"), "label", "embedding")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    return idn.nearest(v.where("vec_id % 5 = 0"), _gallery(v), "vec_id", "label", "embedding")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return idn.pair_counts(view(spark, d, "vectors"), "vec_id", "label", "embedding")


@query(f"with {UNITS} select vec_id, round(v[1], 5) x, round(list_dot_product(v, v), 5) n from u", "vectors")
def f12_unit(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "vectors").select("vec_id", idn.unit(F.col("embedding")).alias("v"))
    return u.select("vec_id", R(F.col("v")[0], "x"), R(idn.dot(F.col("v"), F.col("v")), "n"))


@query(f"with {UNITS}, {CENT} select label, round(v[1], 5) x, round(v[64], 5) y from cn", "vectors")
def a18_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _gallery(view(spark, d, "vectors")).select("label", R(F.col("embedding")[0], "x"), R(F.col("embedding")[63], "y"))


@query(f"with {UNITS}, {PAIRS} select kind, count(*) n, round(avg(s), 5) mean, max(s) most from sc group by 1", "vectors")
def j20_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("kind").agg(F.sum("n").alias("n"), R(F.sum(F.col("s") * F.col("n")) / F.sum("n"), "mean"), F.max("s").alias("most"))


@query(f"with {UNITS}, {CENT}, {RANK} select vec_id, label, k \"rank\", round(s, 5) score from r where k <= 2", "vectors")
def j21_gallery_match(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("vec_id", "label", F.col("rank").cast("long").alias("rank"), R("score"))


@query(f"with {UNITS}, {CENT}, {RANK} select vec_id, closest, round(similarity, 5) similarity, round(margin, 5) margin, case when similarity >= {T} and margin >= {M} then closest end accepted from dec", "vectors")
def w6_accept(spark: SparkSession, d: str) -> DataFrame:
    return idn.decide(_ranked(spark, d), "vec_id", "label", T, M).select("vec_id", "closest", R("similarity"), R("margin"), "accepted")


@query(f"with {UNITS} select vec_id, label, round(s, 5) score from (select p.vec_id, g.label, max(list_dot_product(p.v, g.v)) s, row_number() over (partition by p.vec_id order by max(list_dot_product(p.v, g.v)) desc, g.label) k from u p cross join u g where p.vec_id % 5 = 0 and g.vec_id % 5 <> 0 group by 1, 2) where k = 1", "vectors")
def a19_best_sample(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    return idn.nearest(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), "vec_id", "label", "embedding", 1).select("vec_id", "label", R("score"))


@query(f"with {UNITS} select vec_id, other, k \"rank\", round(s, 5) score from (select p.vec_id, g.vec_id other, list_dot_product(p.v, g.v) s, row_number() over (partition by p.vec_id order by list_dot_product(p.v, g.v) desc, g.vec_id) k from u p cross join u g where p.vec_id % 50 = 0) where k <= 5", "vectors")
def t12_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    out = idn.nearest(v.where("vec_id % 50 = 0"), v.withColumn("other", F.col("vec_id")), "vec_id", "other", "embedding", 5)
    return out.select("vec_id", "other", F.col("rank").cast("long").alias("rank"), R("score"))


OPEN = f"""{UNITS}, {CENT}, {RANK}, lab as (select vec_id, case when truth in (select label from cn) then truth::varchar else '__unknown__' end t, case when similarity >= {T} and margin >= {M} then closest::varchar else '__unknown__' end p from dec),
names as (select label::varchar l from cn union select '__unknown__'),
per as (select l, coalesce((select count(*) from lab where t = l and p = l) / nullif((select count(*) from lab where p = l), 0), 0) pr, coalesce((select count(*) from lab where t = l and p = l) / nullif((select count(*) from lab where t = l), 0), 0) re from names)"""


@query(
    f"with {OPEN} select (select count(*) from lab) n_probes, (select count(*) from lab where t <> '__unknown__') n_known, round((select avg(case when t = p then 1.0 else 0.0 end) from lab), 5) accuracy, round((select avg(case when p <> t then 1.0 else 0.0 end) from lab where t = '__unknown__'), 5) \"far\", "
    "round((select avg(case when p <> t then 1.0 else 0.0 end) from lab where t <> '__unknown__'), 5) frr, round((select avg(pr) from per), 5) precision_macro, round((select avg(re) from per), 5) recall_macro, round((select avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end) from per), 5) f1_macro",
    "vectors",
)
def d9_open_set(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    gallery = _gallery(v)
    probes = v.where("vec_id % 5 = 0")
    out = idn.open_set(idn.decide(_ranked(spark, d), "vec_id", "label", T, M), probes, gallery, "vec_id", "label")
    return out.select("n_probes", "n_known", *[R(c) for c in ("accuracy", "far", "frr", "precision_macro", "recall_macro", "f1_macro")])


@query(f"with {OPEN} select t, p, count(*) n from lab group by 1, 2", "vectors")
def a44_confusion(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors")
    dec = idn.decide(_ranked(spark, d), "vec_id", "label", T, M)
    known = _gallery(v).select(F.col("label").alias("k"))
    rows = v.where("vec_id % 5 = 0").select("vec_id", "label").join(known, F.col("label") == F.col("k"), "left").join(dec, "vec_id", "left")
    return rows.groupBy(F.coalesce(F.col("k").cast("string"), F.lit("__unknown__")).alias("t"), F.coalesce(F.col("accepted").cast("string"), F.lit("__unknown__")).alias("p")).agg(F.count("*").alias("n"))


@query(f"with {UNITS}, {PAIRS}, n as (select count(*) filter (where kind = 'genuine') g, count(*) filter (where kind = 'impostor') i from sc) select round(s, 5) s, round(sum(gg) over (order by s desc) / g, 5) tpr, round(sum(ii) over (order by s desc) / i, 5) fpr from (select s, count(*) filter (where kind = 'genuine') gg, count(*) filter (where kind = 'impostor') ii from sc group by 1) cross join n", "vectors")
def w5_roc(spark: SparkSession, d: str) -> DataFrame:
    return idn.roc(_pairs(spark, d)).select(R("s"), R("tpr"), R("fpr"))


@query(f"with {UNITS}, {PAIRS}, b as (select s, count(*) filter (where kind = 'genuine') g, count(*) filter (where kind = 'impostor') i from sc group by 1), k as (select g, i, sum(i) over (order by s) - i / 2 below from b) select round(sum(g * below) / (sum(g) * sum(i)), 5)::double auc from k", "vectors")
def w5_auc(spark: SparkSession, d: str) -> DataFrame:
    return idn.auc_eer(_pairs(spark, d)).select(R("auc"))


@query(f"with {UNITS}, {PAIRS} select round(avg(case when kind = 'impostor' then case when s >= 0.1 then 1.0 else 0.0 end end), 5) \"far\", round(avg(case when kind = 'genuine' then case when s < 0.1 then 1.0 else 0.0 end end), 5) frr from sc", "vectors")
def a20_far_frr(spark: SparkSession, d: str) -> DataFrame:
    return idn.far_frr(_pairs(spark, d), 0.1).select(R("far"), R("frr"))


@query("select vec_id, case when row_number() over (partition by label order by vec_id) <= 5 then 'gallery' else 'probe' end part from vectors", "vectors")
def d10_gallery_split(spark: SparkSession, d: str) -> DataFrame:
    return idn.split_gallery(view(spark, d, "vectors"), "label", "vec_id", 5).select("vec_id", "part")


@query("select det_id, round(greatest(0.0, least(1.0, (score - 0.65) / 0.35)), 5) confidence from detections", "detections")
def f19_match_confidence(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections").select("det_id", R(idn.match_confidence(F.col("score"), 0.65), "confidence"))


@query("select label, avg(case when vec_id % 7 <> 0 then 1.0 else 0.0 end) rate from vectors group by 1", "vectors")
def a47_detection_rate(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "vectors").groupBy("label").agg(F.avg((F.col("vec_id") % 7 != 0).cast("double")).alias("rate"))


@query("select vec_id from vectors where len(embedding) = 64 and vec_id % 3 <> 0", "vectors")
def s20_usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vectors").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return idn.usable(v, "embedding", 64).select("vec_id")
