"""Secret scans: candidates by pattern, judged by how many repositories and owners hold the same value."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.rows import arrow_map, fresh, row_key, text_input
from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is matched whole: shorter runs fail
HEX = re.compile(r"[0-9a-f]{32,}")
#: What the method adds: long mixed strings outside the patterns above, kept only if a single owner has them.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BARE_BITS = 3.5
#: For each pattern, a linear-time test that holds for every text with a match.
MAY_HAVE = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "bare": r"[0-9][A-Za-z0-9+/_=-]{10}|[A-Za-z0-9+/_=-]{10}[0-9]",
}
MASK = "[SECRET]"


def _bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find_base(text: str, kinds: set[str]) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base patterns, by start and then kind as listed."""
    out = []
    if "assign" in kinds:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "access" in kinds:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    if "hex" in kinds:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(out)]


def find_bare(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    out = []
    for m in BARE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _bits(v) >= BARE_BITS and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), "bare", m.end(), v))
    return out


def _scan(part: pa.RecordBatch) -> dict:
    texts = part.column("text")
    may = {k: pc.match_substring_regex(texts, p).to_pylist() for k, p in MAY_HAVE.items()}
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "found")}
    for i, text in enumerate(texts):
        kinds = {k for k in KINDS if may[k][i]}
        base, bare = [], []
        if kinds:
            text = text.as_py()
            base = find_base(text, kinds)
            bare = find_bare(text, base) if "bare" in kinds else []
        for k in ("assign", "access", "hex"):
            out[f"n_{k}"].append(sum(x[1] == k for x in base))
        out["base"].append(",".join(f"{k}:{s}:{e}" for s, k, e, _ in base))
        out["found"].append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v in base + bare])
    return {"doc_id": part.column("doc_id"), "owner": part.column("owner"), "repo": part.column("repo"), "key": part.column("key"), **out}


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of each row, written once: they are small, and both the corpus table and the verdicts read them."""
    rows = text_input(docs, id_col, text_col, F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), row_key(id_col, text_col).alias("key"))
    found = arrow_map(rows, "doc_id long, owner string, repo string, key long, n_assign long, n_access long, n_hex long, base string, found array<struct<start:long,kind:string,end:long,value:string>>", _scan)
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, n_uses over the whole corpus; uses are summed before each shuffle."""
    each = scanned.select("owner", "repo", F.explode("found.value").alias("value")).groupBy("value", "owner", "repo").agg(F.count("*").alias("uses"))
    return each.groupBy("value").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.sum("uses").alias("n_uses"))


def verdicts(scanned: DataFrame, owned: int = 1, wide: int = 5) -> DataFrame:
    """row, spans kept (array of struct start, kind, end, wide), for rows with candidates.

    A value of at most ``owned`` owners looks live; one that more owners have, in ``wide`` or more repositories, is a
    copied example; one owner's many repositories don't make it one. Values meet their uses by digest; the hot ones, at most
    1,000 digests, are broadcast, as a copied value may sit in any share of all rows.
    """
    uses = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).withColumn("digest", F.md5("f.value"))
    known = materialize(ownership(scanned).select(F.md5("value").alias("digest"), "n_repos", "n_owners", F.col("n_uses").alias("rows")), "owners")
    judged = join_counted(uses, known, "digest")
    span = F.struct(F.col("f.start").alias("start"), F.when(F.col("f.kind") == "assign", 0).when(F.col("f.kind") == "access", 1).when(F.col("f.kind") == "hex", 2).otherwise(3).alias("rank"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end"), ((F.col("n_repos") >= wide) & (F.col("n_owners") > owned)).alias("wide"), (F.col("n_owners") <= owned).alias("live"))
    kept = judged.where((F.col("f.kind") != "bare") | (F.col("n_owners") <= owned))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("kept"))


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied; one row per input row.

    A null or empty text has no spans; a null owner or repository counts as one unnamed. Spans are kind:start:end in
    code points, end exclusive, by start and then kind as listed. ``n_live``: spans whose value has one owner;
    ``n_copied``: spans of copied examples. Base spans always stay; ``bare`` ones only if owner-specific. Null ids stay,
    repeated rows repeat (and count as uses of one owner), an empty table gives no rows, texts of any length are scanned
    whole, other columns are not read.
    """
    scanned = scan(docs, F.col(owner_col), F.col(repo_col), id_col, text_col)
    own = ["doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256")]
    text = F.concat_ws(",", F.transform("kept", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda flag: F.size(F.filter("kept", lambda s: s[flag])).cast("long")
    some = scanned.where(F.size("found") > 0).drop("found").join(verdicts(scanned), "row", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,wide:boolean,live:boolean>>")))
    none = scanned.where(F.size("found") == 0).select(*own, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return none.unionByName(some.select(*own, text.alias("spans"), count("live").alias("n_live"), count("wide").alias("n_copied")))


def mask_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Each stretch covered by spans becomes one MASK."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "source", id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text masked, but for widely copied examples.

    All rows and other columns stay, but for a column ``length_col`` of the text's length, which follows the text. A null
    text stays null; repeated rows, rows without an id and an empty table stay as they are but for the masks.
    """
    key, may, own = fresh(docs, "key"), fresh(docs, "may"), fresh(docs, "cut")
    scanned = scan(docs, F.col(owner_col), F.col(repo_col), id_col, text_col)
    cut = verdicts(scanned).select("row", F.filter("kept", lambda s: ~s["wide"]).alias(own)).where(F.size(own) > 0)
    cut = materialize(cut.join(scanned.select("row", F.col("key").alias(key)), "row").groupBy(key).agg(F.first(own).alias(own)), "cuts")

    @F.arrow_udf("boolean")
    def may_have(text: pa.Array) -> pa.Array:
        out = pa.array([False] * len(text))
        for pattern in MAY_HAVE.values():
            out = pc.or_(out, pc.match_substring_regex(pc.fill_null(text, ""), pattern))
        return out

    @F.pandas_udf("string")
    def masked(text: pd.Series, cut: pd.Series) -> pd.Series:
        return text.combine(cut, lambda t, c: t if c is None else mask_spans(t, [(s["start"], s["end"]) for s in c]))

    keyed = docs.withColumn(key, row_key(id_col, text_col)).withColumn(may, may_have(F.col(text_col)))
    joined = keyed.where(F.col(may)).join(cut, key, "left").withColumn(text_col, masked(F.col(text_col), F.col(own)))
    if length_col in docs.columns:
        size = F.length(text_col).cast(docs.schema[length_col].dataType)
        joined = joined.withColumn(length_col, F.when(F.col(own).isNotNull(), size).otherwise(F.col(length_col)))
    return keyed.where(~F.col(may)).select(*docs.columns).unionByName(joined.select(*docs.columns))
