"""Column builders for labels, file names, tags and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Formats of file names and of device documents.
EXPORT_SUFFIX = r"(?i)[._](jpe?g|png|bmp|webp)?[._]*rf[._][0-9a-f]{8,}$"
COUNTER_SUFFIX = r"([ _-]+\(?\d{1,4}\)?|\(\d{1,4}\))$"
AUGMENT_SUFFIX = r"(?i)[._-](aug|augmented|flip|fliph|flipv|rot(ate)?[-_]?\d*|bright(ness)?|blur|noise|mosaic|crop|shear|exposure|hue|sat(uration)?)\d*$"
TAG = r"\b-?([A-Z]{1,3})(\d{1,3}(?:\.\d{1,2})?)\b"
TERMINAL = r"\b-?(X\d{1,3})[:\-.]([0-9A-Z]{1,4})\b"
WIRE = r"(?i)\b(W\d{1,4}|wire\s*\d{1,4})\b"
CONNECTION = r"(?i)([A-Z]{1,3}\d{1,3}(?::[0-9A-Z]{1,4})?)\s*(?:-|--|->|=>|→|to)\s*([A-Z]{1,3}\d{1,3}(?::[0-9A-Z]{1,4})?)"
TAG_TYPES = {"Q": "circuit_breaker", "F": "fuse", "K": "relay", "KM": "contactor", "KA": "relay", "T": "transformer", "X": "terminal_block", "S": "switch", "H": "indicator_lamp", "P": "meter", "M": "motor", "G": "generator", "U": "converter", "A": "assembly", "PLC": "plc"}

#: Patterns that each text is tested for.
MOST_SIGNATURES = 10_000


def normalise(label: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def group_key(filename: Column, prefixes: Sequence[str] = ()) -> Column:
    """What a capture is called without its source prefix, export suffix, augmentation verbs and counters."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    own = F.lower(stem)
    cut = stem
    for p in reversed(list(prefixes)):
        cut = F.when(stem.startswith(p), F.substring(stem, F.lit(len(p) + 1), F.length(stem))).otherwise(cut)
    cut = F.regexp_replace(cut, EXPORT_SUFFIX, "")
    for _ in range(3):
        shorter = F.regexp_replace(F.regexp_replace(cut, AUGMENT_SUFFIX, ""), COUNTER_SUFFIX, "")
        cut = F.when(shorter == "", cut).otherwise(shorter)
    cut = F.lower(F.regexp_replace(cut, r"^[._\- ]+|[._\- ]+$", ""))
    return F.when(cut == "", own).otherwise(cut)


def resolve(labels: DataFrame, aliases: DataFrame, label: str = "label") -> DataFrame:
    """Adds class_id: alias equal to the normalised label, else to it without a final s, else the longest alias in it.

    ``aliases``: alias (normalised), class_id, ordinal; a bounded table. Distinct labels are resolved once each.
    """
    a = aliases.select("alias", F.col("class_id").alias("__class"), "ordinal")
    names = labels.select(label).distinct().withColumn("__key", normalise(F.col(label)))
    one = lambda stage: F.struct(F.lit(stage).alias("s"), (-F.length("alias")).alias("l"), F.col("ordinal").alias("o"))
    equal = names.join(a, F.col("__key") == F.col("alias")).select(label, one(0).alias("rank"), "__class")
    plural = names.join(a, F.col("__key") == F.concat("alias", F.lit("s"))).select(label, one(1).alias("rank"), "__class")
    # every stretch of a label that may be an alias meets the aliases by hash, not each label each alias
    spans = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("__key")), lambda i: F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("__key") - i + 1)), lambda n: F.substr("__key", i, n)))))
    inside = names.where(F.length("__key") >= 4).select(label, F.explode(spans).alias("span")).join(a, F.col("span") == F.col("alias")).where(F.length("alias") >= 4).select(label, one(2).alias("rank"), "__class")
    best = equal.unionByName(plural).unionByName(inside).groupBy(label).agg(F.min_by("__class", "rank").alias("class_id"))
    return labels.join(best, label, "left")


def signature_match(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, maker, family, specificity: the most specific signature that a text matches, the first of equals.

    ``signatures``: pattern, maker, family, specificity, ordinal; at most MOST_SIGNATURES rows.
    """
    if signatures.count() > MOST_SIGNATURES:
        raise ValueError(f"every text is tested for every signature: at most {MOST_SIGNATURES}")
    found = texts.join(F.broadcast(signatures), F.expr(f"{text} rlike pattern"))
    w = Window.partitionBy(key).orderBy(F.desc("specificity"), "ordinal")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, "maker", "family", "specificity")


def tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more, lower case, without .,:;| at their ends."""
    cut = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"^[.,:;|]+|[.,:;|]+$", ""))
    return F.array_distinct(F.transform(F.filter(cut, lambda w: F.length(w) >= 2), F.lower))


def redact_password(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/@:]*):[^/@]+@", "$1:***@")


def source_problem(url: Column, schemes: Sequence[str] = ("rtsp", "rtsps")) -> Column:
    """Why an address is no usable stream source; null if it is one."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return (
        F.when(url.isNull() | (u == ""), "empty")
        .when(u.rlike(r"^\d+$"), "numeric_device_index")
        .when(scheme.isin("", "file"), "local_file_or_path")
        .when(~scheme.isin(*schemes), "unsupported_scheme")
        .when(host == "", "missing_host")
    )


def document_tags(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tag, kind (component, terminal or wire), type: what device documents name; each tag once a document."""
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    types = F.create_map(*[F.lit(x) for kv in TAG_TYPES.items() for x in kv])
    term = docs.select(key, F.explode(pairs(TERMINAL)).alias("p"))
    terminals = term.select(key, F.concat_ws(":", "p.a", "p.b").alias("tag"), F.lit("terminal").alias("kind"), F.lit(None).cast("string").alias("type"))
    blocks = term.select(key, F.col("p.a").alias("tag"), F.lit("component").alias("kind"), F.lit("terminal_block").alias("type"))
    tags = docs.select(key, F.explode(pairs(TAG)).alias("p")).select(key, F.concat("p.a", "p.b").alias("tag"), F.lit("component").alias("kind"), F.coalesce(F.try_element_at(types, F.upper("p.a")), F.lit("component")).alias("type"))
    wires = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(WIRE), F.lit(1))).alias("w")).select(key, F.upper(F.regexp_replace("w", " ", "")).alias("tag"), F.lit("wire").alias("kind"), F.lit(None).cast("string").alias("type"))
    every = blocks.withColumn("o", F.lit(0)).unionByName(tags.withColumn("o", F.lit(1))).unionByName(terminals.withColumn("o", F.lit(0))).unionByName(wires.withColumn("o", F.lit(0)))
    return every.groupBy(key, "tag", "kind").agg(F.min_by("type", "o").alias("type"))


def document_links(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, src, dst: connections that device documents name."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(CONNECTION), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(CONNECTION), F.lit(2)).alias("b"))
    return docs.select(key, F.posexplode(both).alias("pos", "p")).select(key, "pos", F.upper("p.a").alias("src"), F.upper("p.b").alias("dst"))
