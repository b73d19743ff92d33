"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.rows import arrow_map, ending, text_input

BINS, BITS, SHINGLE = 256, 4, 5
#: Ranges of ids: a bound on the two numbers for each that all executors get.
MOST_RANGES = 65_536
#: Word hashes that a worker remembers; results don't depend on it.
REMEMBERED = 300_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``words`` words (ASCII white space between them, A-Z lower-cased); of all the words if there are fewer; none without words."""
    own = text.encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(own) - words + 1)
    out = np.full(n, len(own[:words]), np.uint64)
    for k in range(min(words, len(own))):
        out = _mix(out * _SPREAD + each[k : k + n])
    return out


@lru_cache(maxsize=4)
def _donors(bins: int, tries: int = 512) -> np.ndarray:
    """Row i: the bins that an empty bin i asks, in turn, for their value; each try is a hash of (bin, try)."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(1, tries + 1, dtype=np.uint64)
    return (_mix(at * _SPREAD) % np.uint64(bins)).astype(np.int64)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The least hash in each bin; an empty bin takes that of the first filled bin among those it asks. None: no hash."""
    if not len(hashes):
        return None
    hashes = np.sort(hashes)
    own = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], own[1:] != own[:-1]])
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[own[first]], full[own[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        asks = _donors(bins)[empty]
        found = full[asks]
        donor = asks[np.arange(len(empty)), found.argmax(axis=1)]
        none = ~found.any(axis=1)
        donor[none] = np.flatnonzero(full)[empty[none] % full.sum()]
        out[empty] = out[donor]
    return out


def pack(values: np.ndarray | None, bins: int = BINS, bits: int = BITS) -> bytes:
    """The ``bits`` low-order bits of a hash of each value, packed; a text without words packs to nothing."""
    if values is None:
        return b""
    low = (_mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets: the share of equal bins, less what low-order bits share by chance. Two texts without words: 1; one: 0."""
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).reshape(-1, bits) for v in (a, b))
    same, chance = float((x == y).all(axis=1).mean()), 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprint(text: str) -> bytes:
    return pack(sketch(shingle_hashes(text)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (binary, BINS * BITS bits, empty without words), one row per input row.

    A null text counts as empty, null ids stay, repeated rows repeat, an empty table gives no rows, texts of any length
    are hashed whole, other columns are not read.
    """

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "fingerprint": [fingerprint(t.as_py()) for t in part.column("text")]}

    return arrow_map(text_input(docs, id_col, text_col), "doc_id long, fingerprint binary", run, _words.clear)


def edited(text: str, following: str) -> str:
    """The last third of ``text``, in code points and rounded down, replaced by as many first ones of ``following`` (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ranges(ids: DataFrame, target_rows: int) -> np.ndarray:
    """Upper ids of consecutive ranges of about ``target_rows`` rows, at most MOST_RANGES (beyond that they have more rows)."""
    parts = min(MOST_RANGES, max(1, -(-ids.count() // target_rows)))
    return np.unique(np.array(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts), dtype=np.int64)) if parts > 1 else np.zeros(0, np.int64)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = 8_192) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per input row.

    The next document is that of the next smaller id, after the last the first. Ids are cut into ranges, each sorted in
    one task of about ``target_rows`` rows; the greatest row of each range also goes, as a copy, to the next range up,
    so that nothing is sorted as a whole. Where a row goes is looked up in sorted arrays of the ranges' bounds. A sort
    that outgrows memory spills, so a range that an id repeated without end has filled only takes longer.

    Rows without an id come last, in the lowest range; rows of one id are ordered by the hash of their text, equal rows
    come one after the other. A null text counts as empty, an empty table gives no rows, texts of any length are read
    whole, other columns are not read.
    """
    rows = text_input(docs, id_col, text_col)
    cuts = _ranges(rows.select("doc_id").where("doc_id is not null"), target_rows)

    def part_of(ids: pa.Array) -> np.ndarray:
        return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, pc.fill_null(ids, 0).to_numpy()))

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids), pa.int32())

    seen = sorted((r["part"], r["top"]) for r in rows.select(part("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()) or [(0, None)]
    used = np.array([p for p, _ in seen])
    tops = np.array([-1 if t is None else t for _, t in seen])
    bare = np.array([t is None for _, t in seen])

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        """The row's range, numbered as used, and for the greatest id of a range the one above it, too, as -1 - range."""
        at = np.searchsorted(used, part_of(ids))
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        top = np.where(null, bare[at], ~bare[at] & (tops[at] == pc.fill_null(ids, 0).to_numpy()))
        above = -1 - (at + 1) % len(used)
        both = np.stack([at, above], axis=1)
        keep = np.stack([np.ones(len(at), bool), top], axis=1)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(1 + top)]).astype(np.int32), pa.array(both[keep], pa.int32()))

    sent = rows.withColumn("to", F.explode(places("doc_id"))).withColumn("copy", F.col("to") < 0)
    sent = sent.select(F.when(F.col("copy"), -1 - F.col("to")).otherwise(F.col("to")).alias("part"), "copy", "doc_id", F.xxhash64("text").alias("tie"), "text")
    dealt = sent.repartitionById(len(used), F.col("part")).sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), F.desc("tie"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # held: part, doc_id, text, fingerprint, whether it is a copy

        def row(following: tuple) -> list:
            _, doc_id, text, fp, _ = held
            new = edited(text, following[2])
            new_fp = fingerprint(new)
            return [doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.hex(), new_fp.hex(), likeness(fp, new_fp), likeness(fp, following[3])]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for p, copy, doc_id, text in zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                    if copy and held and held[4] and held[0] == p:
                        continue
                    now = (p, doc_id, text, fingerprint(text), copy)
                    if held and held[0] == p and not held[4]:
                        out.append(row(now))
                    held = now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []

    return dealt.mapInArrow(ending(run, _words.clear), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
