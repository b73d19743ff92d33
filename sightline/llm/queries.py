"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import byte_bpe, conversation_trie, decontaminate, hard_negatives, importance, language_id, line_dedup, minhash, ngram_lm, secret_scan, simhash, warc
from sightline.llm.token_counts import token_counts

JSON_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), JSON_TOKENIZER, public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark")
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), items, least_words=1).drop("key").distinct()
    members = decontaminate.item_classes(items, least_words=1).withColumnRenamed("item_id", "member").distinct()
    each = found.join(members, F.col("item_id") == F.col("class_id"))  # equal items have their rows, too
    return each.select("doc_id", F.col("member").alias("item_id"), "coverage", "reparameterised")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.beside_next(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "log_weight", "gumbel_key", "selected")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_byte_bpe, op3_decontamination, op4_secret_scan, op5_simhash, op6_ngram_lm, op7_warc, op8_minhash, op9_language_id, op10_importance, op11_hard_negatives, op12_conversation_trie, op13_line_dedup)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Python's words of a text: A-Z lower-cased, split at ASCII white space.
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_NGRAM_LM = f"""
with d as (select row_number() over () r, doc_id, {_WORDS} l from documents),
  t as (select r, unnest(l) w, generate_subscripts(l, 1) i from d),
  g as (select r, w, lag(w) over (partition by r order by i) v, lag(w, 2) over (partition by r order by i) u from t),
  one as (select w, count(*) n from g group by w),
  two as (select v, w, count(*) n from g where v is not null group by v, w),
  three as (select u, v, w, count(*) n from g where u is not null group by u, v, w),
  s as (
    select g.r, case when three.n is not null then ln(three.n / uv.n)
        else case when g.u is not null then ln(0.4) else 0 end + case when vw.n is not null then ln(vw.n / first.n)
          else case when g.v is not null then ln(0.4) else 0 end + ln(one.n / (select sum(n) from one)) end end score
    from g join one on one.w = g.w left join two vw on vw.v = g.v and vw.w = g.w left join one first on first.w = g.v
      left join three on three.u = g.u and three.v = g.v and three.w = g.w left join two uv on uv.v = g.u and uv.w = g.v)
select doc_id, cast(len(l) as bigint) n_words, round(coalesce(total, 0), 4) log_score, round(case when len(l) > 0 then coalesce(total, 0) / len(l) else 0 end, 6) mean_log_score
from d left join (select r, sum(score) total from s group by r) x on x.r = d.r
"""

_WARC = """
with p as (select page_id, encode(coalesce(html, '')) payload from pages),
  h as (select page_id, octet_length(payload) payload_bytes, sha1(payload) x from p),
  f as (select x, min(page_id) first from h group by x),
  b as (select *, [cast('0x' || substr(x, 5 * k + 1, 5) as bigint) for k in range(8)] fives from h join f using (x))
select page_id, payload_bytes,
  array_to_string(list_transform(fives, lambda q: array_to_string(list_transform([15, 10, 5, 0], lambda z: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((q >> z) & 31 as int) + 1, 1)), '')), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from b
"""


def _spans(kind: str, pattern: str, least: int, value: str) -> str:
    """Spans of one kind: pieces between the matches, and the matches, tell where each begins."""
    return f"""
  {kind}_m as (select doc_id, text, regexp_extract_all(text, '{pattern}') m, regexp_split_to_array(text, '{pattern}') s from t),
  {kind}_p as (select doc_id, '{kind}' kind, m[k] found, list_sum(list_transform(s[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[: k - 1], lambda x: length(x))), 0) start
    from (select *, unnest(range(1, len(m) + 1)) k from {kind}_m)),
  {kind}_f as (select doc_id, kind, cast(start as bigint) b, cast(start + length(found) as bigint) e, {value} v from {kind}_p where length({value}) >= {least})"""


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"
_SECRETS = f"""
with t as (select row_number() over () doc_id, doc_id id, source, coalesce(text, '') text from documents),
  {_spans("assign", _ASSIGN, 8, r"regexp_extract(found, '[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)")},
  {_spans("access", "AKIA[A-Z0-9]+", 16, "found")},
  {_spans("hex", "[0-9a-f]+", 32, "found")},
  {_spans("bare", "[A-Za-z0-9+/_=-]{{20,}}".replace("{{", "{").replace("}}", "}"), 20, "found")},
  base as (select *, 0 o from assign_f union all select *, 1 from access_f union all select *, 2 from hex_f),
  mixed as (select c.*, list_sum(list_transform(map_values(h), lambda n: -(n::double) / length(v) * log2(n / length(v)))) bits
    from (select *, list_histogram(string_split(v, '')) h from bare_f where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')) c),
  extra as (select doc_id, kind, b, e, v, 3 o from mixed where bits >= 3.5
      and not exists (select 1 from base where base.doc_id = mixed.doc_id and base.b < mixed.e and mixed.b < base.e)),
  owners as (select v, count(distinct coalesce(source, '')) n from (select doc_id, v from base union all select doc_id, v from extra) join t using (doc_id) group by v),
  kept as (select x.*, n from (select * from base union all select * from extra) x join owners using (v) where kind <> 'bare' or n <= 1),
  each as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    string_agg(concat_ws(':', kind, b, e), ',' order by b, o) filter (o < 3) base, string_agg(concat_ws(':', kind, b, e), ',' order by b, o, e) spans,
    count(*) filter (n <= 1) n_live, count(*) filter (n >= 5) n_copied from kept group by doc_id)
select id doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_copied, 0) n_copied
from t left join each using (doc_id)
"""

_HARD_NEGATIVES = """
with e as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.r ar, a.vec_id anchor_id, b.r br, b.vec_id id, a.label = b.label same, cast(list_dot_product(a.v, b.v) as bigint) score from e a join e b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
  p as (select *, row_number() over (partition by ar order by score desc, id) k from s where same qualify k <= 5),
  n as (select p.ar, p.anchor_id, p.br, p.id positive_id, p.score positive_score, s.id negative_id, s.score negative_score, row_number() over (partition by p.ar, p.br order by s.score desc, s.id) rank
    from p join s on s.ar = p.ar and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: cast(ord(ch) as bigint)),
      lambda c, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295), 4294967295)"""
#: A node is known by the digests of its turns, one after the other.
_TRIE = f"""
with c as (select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) pos from conversations where conv_id is not null),
  o as (select conv_id, {_CRC32} % 9 h, conv_id - conv_id % 5 base from (select distinct conv_id from c)),
  b as (select o.*, least(h, (select count(*) from c where c.conv_id = base)) lent from o),
  r as (select b.conv_id, pos d, role, text from b join c on c.conv_id = base and pos <= h union all select conv_id, pos - h + lent, role, text from b join c using (conv_id) where pos > h),
  p as (select conv_id, d, octet_length(encode(text)) bytes, string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by d) path from r),
  e as (select o.conv_id, coalesce(max_by(path, d), '') path from o left join p using (conv_id) group by 1),
  n as (select path, any_value(d) d, any_value(bytes) bytes, min(conv_id) conv_id, count(*) n from p group by path union all select '', 0, 0, min(conv_id), count(*) from o having count(*) > 0),
  k as (select substr(path, 1, length(path) - 32) path, count(*) kids from n where d > 0 group by 1),
  v as (select n.*, coalesce(kids, 0) kids, (n - 1) * bytes saved from n left join k using (path)),
  s as (select substr(path, 1, 32 * i) path, count(*) filter (kids = 0) leaves, sum(saved) saved from (select *, unnest(range(d + 1)) i from v) group by 1),
  x as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) ids from e group by path)
select v.conv_id, cast(v.d as bigint) depth, up.conv_id parent_conv_id, v.n n_convs, kids n_children, leaves n_leaves, cast(s.saved as bigint) saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from v join s using (path) left join n up on v.d > 0 and up.path = substr(v.path, 1, length(v.path) - 32) left join x on x.path = v.path
"""

_LINE_DEDUP = f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
  t as (select r, unnest(l) x, generate_subscripts(l, 1) i from d),
  k as (select *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') k from t),
  f as (select k from k where length(k) >= 1 group by k having count(distinct r) >= 10),
  m as (select k.*, f.k is not null gone from k left join f using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) kept_sha256
from m join d using (r) group by r, doc_id
"""

#: The other queries hold hashes, models or encodings that DuckDB doesn't have; tests hold them against brute force.
SQL: dict[str, str] = {"op4_secret_scan": _SECRETS, "op6_ngram_lm": _NGRAM_LM, "op7_warc": _WARC, "op11_hard_negatives": _HARD_NEGATIVES, "op12_conversation_trie": _TRIE, "op13_line_dedup": _LINE_DEDUP}
