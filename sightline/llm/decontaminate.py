"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.rows import ending, fresh, row_key, slices, small_batches, text_input
from sightline.plans.lineage import materialize

WINDOW = 8
#: By default, items of fewer template words never match: they would match everywhere.
LEAST_WORDS = 4
#: Alignments that differ by at most so many inserted or cut words belong together.
GAP = 32
#: Bits of the filter of windows: 64 KB to 4 MB. Beyond some two million windows it lets more pass, and loses none.
FILTER_BITS = (19, 25)
#: Keys over which the rows of one window are spread.
SPREAD = 8
#: Unit words that count as such after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams kilogram kilograms ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years km/h mph m/s hz khz mhz v volt volts a w kw watt watts j kj n pa % percent degrees euro euros dollar dollars cent cents usd eur gbp".split()
)
REMEMBERED = 300_000
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(f"<{k}>") & ~7) for k in ("number", "name", "unit"))
_IS_NUMBER, _IS_TITLE, _ENDS = 1, 2, 4
_DIGITS = re.compile(r"[-+(]?[$€£]?\d[\d.,:/-]*[%]?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_UNITS = np.array(sorted(xxhash.xxh64_intdigest(u) & ~7 for u in UNITS), dtype=np.uint64)


class _Words(dict):
    """Raw word to a 64-bit hash of its bare lower-case form, its low 3 bits telling what it looks like; 0: no word."""

    def __missing__(self, raw: str) -> int:
        bare = _EDGE.sub("", raw)
        h = 0
        if bare:
            number = bare[0].isdigit() and _DIGITS.fullmatch(bare)
            title = bare[0].isupper() and (len(bare) == 1 or bare[1:].islower())
            h = xxhash.xxh64_intdigest(bare.lower()) & ~7 | _IS_NUMBER * bool(number) | _IS_TITLE * title | _ENDS * (raw[-1] in ".!?:;")
        elif raw in ("%", "€", "$", "£"):
            h = xxhash.xxh64_intdigest(raw) & ~7
        elif raw[-1] in ".!?:;":
            h = _ENDS
        if len(self) >= REMEMBERED:
            self.clear()
        if len(raw) <= 64:
            self[raw] = h
        return h


_words = _Words()


def templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template words, slot values, position of the text) of all texts in turn; a word that is no placeholder has slot value 0.

    A number is a placeholder, a unit word after it another, and title-case words that don't begin a sentence or line
    are one placeholder together. The first word of a sentence, and text in capitals, stay words.
    """
    raw = [t.replace("\n", ". ").split() for t in texts]
    code = np.fromiter((c for own in raw for c in map(_words.__getitem__, own)), np.uint64, sum(map(len, raw)))
    doc = np.repeat(np.arange(len(raw)), [len(own) for own in raw])
    at = np.flatnonzero(code & ~np.uint64(7))
    ends = np.concatenate([[0], np.cumsum((code & np.uint64(_ENDS)) > 0)])
    look, word, doc = code[at] & np.uint64(7), code[at] & ~np.uint64(7), doc[at]
    starts = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(at) else np.zeros(0, bool)
    begins = starts.copy()
    begins[1:] |= ends[at[1:]] > ends[at[:-1]]
    follows = lambda mask: np.concatenate([[False], mask[:-1]]) & ~starts if len(at) else mask
    number = (look & np.uint64(_IS_NUMBER)) > 0
    unit = follows(number) & ~number
    unit[unit] = np.isin(word[unit], _UNITS)
    name = ((look & np.uint64(_IS_TITLE)) > 0) & ~begins & ~unit & ~number
    out, slot = word.copy(), np.zeros(len(word), np.uint64)
    for mask, mark in ((number, NUMBER), (unit, UNIT), (name, NAME)):
        out[mask], slot[mask] = mark, word[mask]
    more = name & follows(name)
    for k in np.flatnonzero(more):  # a name of several words has one slot value
        slot[k] = (int(slot[k - 1]) * 31 + int(slot[k]) | 1) % (1 << 64)
    last = ~np.concatenate([more[1:], [False]]) if len(at) else more
    return out[last], slot[last], doc[last]


def template(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Template words and slot values of one text."""
    return templates([text])[:2]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` template words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _item_windows(benchmark: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """item_id, template (hash of its words and slot values), wpos, size, n_windows, window, islots: windows of each item."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words, slots = template(text)
                if len(words) < max(1, least_words):
                    continue
                size = min(WINDOW, len(words))
                hashes, whole = window_hashes(words, size), xxhash.xxh64_intdigest(words.tobytes() + slots.tobytes())
                out += [(item, _signed(whole), k, size, len(hashes), _signed(int(h)), slots[k : k + size].view(np.int64).tolist()) for k, h in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 7, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["item_id", "template", "wpos", "size", "n_windows", "window", "islots"])

    return rows.mapInArrow(ending(run, _words.clear), "item_id long, template long, wpos int, size int, n_windows int, window long, islots array<long>")


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, class_id: the item that stands for each in ``leaks``, the least of equal words and slot values."""
    firsts = _item_windows(benchmark, id_col, text_col, least_words).where("wpos = 0").select("item_id", "template").distinct()
    return firsts.join(firsts.groupBy("template").agg(F.min("item_id").alias("class_id")), "template").select("item_id", "class_id")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bloom(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the windows, as bits in 32-bit words, of bounded size whatever the benchmark has."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * max(1, windows.count())).bit_length()))
    at = windows.select(F.explode(F.array(F.col("window"), F.xxhash64("window"))).alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    found, out = words.toArrow(), np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _spark_xxhash(h: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte values with seed 42, as Spark's function of one long gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    acc = np.uint64(42) + p5 + np.uint64(8)
    acc = acc ^ (turn(h * p2, 31) * p1)
    acc = turn(acc, 27) * p1 + p4
    acc = (acc ^ (acc >> np.uint64(33))) * p2
    acc = (acc ^ (acc >> np.uint64(29))) * p3
    return acc ^ (acc >> np.uint64(32))


def _candidates(docs: DataFrame, bloom: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, pos, window, dslots: windows of documents that may be an item's."""
    rows = text_input(docs, id_col, text_col, row_key(id_col, text_col).alias("key"))
    shared, shift = docs.sparkSession.sparkContext.broadcast(bloom), 64 - (len(bloom).bit_length() - 1 + 5)

    def has(at: np.ndarray) -> np.ndarray:
        at = (at >> np.uint64(shift)).astype(np.int64)
        return (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts, keys = (part.column(k).to_pylist() for k in range(3))
            words, slots, doc = templates(texts)
            first, out = np.searchsorted(doc, np.arange(len(texts))), []
            for size in sizes:
                hashes = window_hashes(words, size)
                at = np.flatnonzero(has(hashes)) if len(hashes) else np.zeros(0, np.int64)
                at = at[doc[at] == doc[at + size - 1]]
                at = at[has(_spark_xxhash(hashes[at]))] if len(at) else at
                out += [(keys[doc[k]], ids[doc[k]], int(k - first[doc[k]]), _signed(int(hashes[k])), slots[k : k + size].view(np.int64).tolist()) for k in at]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["key", "doc_id", "pos", "window", "dslots"])

    return rows.mapInArrow(ending(run, _words.clear), "key long, doc_id long, pos int, window long, dslots array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """key, doc_id, item_id, coverage, reparameterised: rows of ``docs`` that hold an item of the benchmark.

    A row holds an item if at least the share ``coverage`` of the item's distinct windows of WINDOW template words (of
    the whole item, if it is shorter) occur in one stretch of it: alignments at most GAP words apart are one stretch.
    Each slot value of the item must stand for one value in the stretch; where one stands for two, only windows with the
    item's own values count. So the same question with other numbers or names is caught, text whose slots contradict
    each other is not, and a copy with a few of its values changed still is. Names are told by title case: a copy in
    small letters or capitals matches only where names don't break up its windows.

    Items with equal words and slot values count as one, the least id (``item_classes`` tells whose); those that differ in
    a value are items of their own, as other rows may hold them. Items of fewer than ``least_words`` template words never
    match. Rows and items with null or empty text never match, rows without an id match like others, repeated rows share
    their key and give one result; empty tables give no rows; texts are read whole and other columns not at all. Beyond
    the Bloom filter, of bounded size, only windows that may match are shuffled and hash-joined with those of the items,
    each window's rows spread over SPREAD keys.
    """
    windows = _item_windows(benchmark, item_id, item_text, least_words)
    least = windows.where("wpos = 0").groupBy("template").agg(F.min("item_id").alias("item_id"))
    windows = materialize(windows.join(least, ["template", "item_id"]).dropDuplicates(["template", "item_id", "wpos"]), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]
    found = _candidates(docs, _bloom(windows.select("window").distinct()), sorted(sizes), id_col, text_col)
    spread = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = found.withColumn("salt", F.pmod("key", F.lit(SPREAD)).cast("int")).join(spread, ["window", "salt"])
    own = ["key", "item_id", "template"]  # a key has one doc_id
    met = met.dropDuplicates([*own, "wpos", "pos"]).withColumn("line", F.col("pos") - F.col("wpos"))  # of equal rows, one
    lines = Window.partitionBy(*own).orderBy("line")
    begins = F.coalesce(F.col("line") - F.lag("line").over(lines) > GAP, F.lit(True))
    met = met.withColumn("begins", begins.cast("int")).withColumn("stretch", F.sum("begins").over(lines))
    pairs = F.filter(F.arrays_zip(F.col("islots").alias("i"), F.col("dslots").alias("d")), lambda s: s["i"] != 0)
    met = met.withColumn("pairs", pairs).withColumn("other", F.exists("pairs", lambda s: s["i"] != s["d"]))
    each = met.groupBy(*own, "stretch", "n_windows").agg(
        F.max("doc_id").alias("doc_id"),
        F.size(F.collect_set("wpos")).alias("all"),
        F.size(F.collect_set(F.when(~F.col("other"), F.col("wpos")))).alias("same"),
        F.max("other").alias("other"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    agree = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda s: s["i"])))
    each = each.withColumn("n", F.when(agree, F.col("all")).otherwise(F.col("same"))).withColumn("verbatim", ~(agree & F.col("other")))
    best = each.groupBy(*own, "n_windows").agg(F.max("doc_id").alias("doc_id"), F.max(F.struct("n", "verbatim")).alias("best"))
    out = best.withColumn("coverage", F.col("best.n") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    return out.select("key", "doc_id", "item_id", "coverage", (~F.col("best.verbatim")).alias("reparameterised"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, without the rows that hold an item of the benchmark.

    Rows of equal id and text go or stay together; rows with null or empty text stay; an empty table stays empty.
    """
    key = fresh(docs, "key")
    with small_batches(docs.sparkSession):
        gone = materialize(leaks(docs, benchmark, coverage, id_col, text_col).select(F.col("key").alias(key)).distinct(), "leaks")
    return docs.join(gone.hint("merge"), row_key(id_col, text_col) == F.col(key), "left_anti")
