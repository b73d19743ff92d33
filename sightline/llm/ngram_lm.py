"""Stupid-backoff scores, computed relationally: count tables of n-grams, joined to the exploded n-grams, summed by document.

A document is exploded to one row for each distinct run of three words (u, v, w) that it has, with its own number of
them. Dealt by the hash of (v, w), the rows are counted as trigrams and as bigrams in one pass. Values are worked out on
the tables of the n-grams that enough documents hold, which are a small part of all, and joined to the exploded rows by
the same hash; what backs off to single words is joined to the counts of words, and all is summed by document.

Where every n-gram counts, no word of the counted texts backs off, so a text's score is a sum of logarithms of the counts of its
own runs. Then the runs move once, packed by bucket of (v, w), and meet the counts of trigrams and bigrams in their bucket.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.rows import Batches, ending, slices, small_batches, text_input
from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted, joined_where_they_lie

BACKOFF = 0.4
#: Words remembered in a task; results don't depend on it.
REMEMBERED = 300_000
#: A pair of words of this share of a bounded sample is dealt over SALTS keys: at most 1 / FREQUENT pairs are.
FREQUENT, SAMPLE, SALTS = 1 / 1_000, 2_000, 32
#: Words whose counts are broadcast where what backs off meets the counts of words: those of this share of all words.
WORDS = 65_536
#: Words known by a number of two bytes in packed runs, frequent ones; others are packed as their hash.
NUMBERED = 65_534
#: Slots that numbered words are looked up in, by the upper bits of their hash; one word has a slot.
SLOT_BITS = 20
#: Runs packed at once in a task, runs that a task counts at once, and runs a task reads in all (a bucket is never parted).
PACKED, COUNTED, READ = 1 << 19, 1 << 18, 1 << 26
#: Buckets of packed runs: so many, more where a bucket would have over FULL runs.
BUCKETS, FULL = 2_048, 1 << 21


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42) or 1
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def word_hashes(text: str) -> np.ndarray:
    """Words are lower-cased (A-Z) runs without ASCII white space; each is known by its XXH64, never 0."""
    own = text.encode().lower().split()
    return np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def runs(words: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """u, v, w, n, first of a document: its distinct runs, how often it has each, and 1 at one run of each (v, w).

    0 stands for no word: the run of the first word is (0, 0, w), that of the second (0, v, w). Of an ``order`` below 3, u
    (and v) is 0 throughout.
    """
    none = np.zeros(1, np.uint64)
    v = np.concatenate([none, words[:-1]]) if order > 1 else np.zeros(len(words), np.uint64)
    u = np.concatenate([none, v[:-1]]) if order > 2 else np.zeros(len(words), np.uint64)
    at = np.lexsort((u, v, words))
    u, v, w = u[at], v[at], words[at]
    new2 = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    new3 = np.concatenate([[True], new2[1:] | (u[1:] != u[:-1])])
    at = np.flatnonzero(new3)
    return u[at], v[at], w[at], np.diff(np.concatenate([at, [len(w)]])), new2[at].astype(np.int64)


def _often(rows: DataFrame, n_docs: int, order: int, frequent: float = FREQUENT) -> np.ndarray:
    """Hashes of the pairs (v, w) that are frequent in a sample of about SAMPLE documents, sorted; at most 1 / frequent."""

    def tally(batches: Batches) -> Batches:
        for part in slices(batches):
            each = [runs(h, order)[1:4] for t in part.column("text") if len(h := word_hashes(t.as_py()))]
            if each:
                pairs, at = np.unique(np.concatenate([_mixed(v, w) for v, w, _ in each]), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(np.bincount(at, minlength=len(pairs)).astype(np.int64))], names=["pair", "n"])

    share = int(min(1.0, SAMPLE / max(1, n_docs)) * 1_000_003)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share)
    tallied = materialize(some.mapInArrow(ending(tally, _words.clear), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    least = (tallied.agg(F.sum("n")).first()[0] or 0) * frequent
    found = tallied.where(F.col("n") >= max(2.0, least)).orderBy(F.desc("n"), "pair").limit(int(1 / frequent)).collect()
    return np.sort(np.array([r["pair"] for r in found], dtype=np.int64).view(np.uint64))


def explode(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u, v, w, salt, row, n, first: the runs of every document, and a row (doc_id, row, 0) with its number of words.

    ``row`` numbers the input rows, so rows of equal id or text are told apart. ``salt`` is 0, but for frequent (v, w)
    one of SALTS numbers, the same for all runs of a document.
    """
    rows = text_input(docs, id_col, text_col)
    often = docs.sparkSession.sparkContext.broadcast(_often(rows, rows.count(), order))
    names = ["u", "v", "w", "salt", "row", "n", "first"]

    def run(batches: Batches) -> Batches:
        hot = often.value
        for part in slices(batches):
            ids, numbers = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
            cols: list[list] = [[] for _ in names]
            for doc_id, row, text in zip(ids, numbers, part.column("text"), strict=True):
                words = word_hashes(text.as_py())
                own = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 2
                if len(words):
                    own = runs(words, order)
                u, v, w, n, first = own
                at = np.minimum(np.searchsorted(hot, pair := _mixed(v, w)), max(0, len(hot) - 1))
                salt = np.where(hot[at] == pair, 1 + row % SALTS, 0) if len(hot) else np.zeros(len(w), np.int64)
                for c, x in zip(cols, (u.view(np.int64), v.view(np.int64), w.view(np.int64), salt, np.full(len(w), row), n, first), strict=True):
                    c.append(x)
                for c, x in zip(cols, (doc_id or 0, row, 0, -(doc_id is None), row, len(words), 0), strict=True):
                    c.append(np.array([x], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(ending(run, _words.clear), ", ".join(f"{n} long" for n in names))


def _salted(values: DataFrame) -> DataFrame:
    """A row for each salt that the rows of an n-gram may have."""
    every = F.sequence(F.lit(1), F.lit(SALTS)).cast("array<bigint>")
    return values.withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("hot")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """w, n: every word's hash and count, added up in each task first; a written table."""

    def tally(batches: Batches) -> Batches:
        for part in slices(batches):
            own, n = np.unique(np.concatenate([word_hashes(t.as_py()) for t in part.column("text")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    counted = text_input(docs, id_col, text_col).mapInArrow(ending(tally, _words.clear), "w long, n long")
    return materialize(counted.groupBy("w").agg(F.sum("n").alias("n")), "words")


def count_tables(grams: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Trigrams (u, v, w, n, hot) and bigrams (v, w, n, hot) that at least ``min_docs`` documents hold, from ``explode``.

    One pass over rows dealt by (v, w, salt), where trigrams and bigrams can both be counted; what few documents hold
    goes at once, the rest is written, and the counts of the salts are added up.
    """
    dealt = grams.where("w <> 0").repartition("v", "w", "salt")
    tri = dealt.groupBy("u", "v", "w", "salt").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.sum("first").alias("firsts"))
    pair = Window.partitionBy("v", "w", "salt")
    tri = tri.withColumn("n2", F.sum("n").over(pair)).withColumn("docs2", F.sum("firsts").over(pair)).withColumn("one", F.col("u") == F.min("u").over(pair))
    tri = tri.withColumn("three", F.expr(f"u <> 0 and (docs >= {min_docs} or salt > 0)")).withColumn("two", F.expr(f"one and v <> 0 and (docs2 >= {min_docs} or salt > 0)"))
    held = materialize(tri.where("three or two").select("u", "v", "w", "salt", "n", "docs", "n2", "docs2", "three", "two"), "grams")

    def counted(table: DataFrame, n: str, docs: str, *keys: str) -> DataFrame:
        out = table.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(docs).alias("docs"), (F.max("salt") > 0).alias("hot"))
        return out.where(F.col("docs") >= min_docs).drop("docs")

    return counted(held.where("three"), "n", "docs", "u", "v", "w"), counted(held.where("two"), "n2", "docs2", "v", "w")


def _planes(x: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: planes of zeros take no room once compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the slots, the first of ``hashes`` that belongs there or 0, and the words by their number, from 1."""
    place, first = np.unique(hashes >> np.uint64(64 - SLOT_BITS), return_index=True)
    slots, table = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(NUMBERED + 2, np.uint64)
    slots[place] = hashes[first]
    table[1 : len(first) + 1] = hashes[first]
    return slots, table


def _numbers(table: np.ndarray) -> np.ndarray:
    """The number of each slot's word."""
    out = np.zeros(1 << SLOT_BITS, np.uint16)
    n = int(np.count_nonzero(table))
    out[table[1 : n + 1] >> np.uint64(64 - SLOT_BITS)] = np.arange(1, n + 1)
    return out


def _pack(slots: np.ndarray, numbers: np.ndarray, words: tuple[np.ndarray, ...], n: np.ndarray, at: np.ndarray) -> bytes:
    """Runs in order of their documents (``at``): words by number or hash, steps of ``at`` and ``n``."""
    codes, rare = [], []
    for x in words:
        place = x >> np.uint64(64 - SLOT_BITS)
        codes.append(np.where(x == 0, 0, np.where(slots[place] == x, numbers[place], NUMBERED + 1)).astype("<u2"))
        rare.append(x[codes[-1] == NUMBERED + 1].astype("<u8"))
    head = np.array([len(n), *map(len, rare)], "<u4")
    return b"".join([head.tobytes(), _planes(np.diff(at, prepend=0)), _planes(n), *(c.tobytes() for c in codes), *(r.tobytes() for r in rare)])


def _unpack(table: np.ndarray, packed: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """u, v, w, n, row of the runs of several packs, each with the row that its documents are counted from."""
    codes, rare, ns, rows = ([], [], []), ([], [], []), [], []
    for base, data in packed:
        n, *k = np.frombuffer(data, "<u4", 4).tolist()
        rows.append(base + np.cumsum(_from_planes(data, 16, n), dtype=np.int64))
        ns.append(_from_planes(data, 16 + 4 * n, n).astype(np.int64))
        for i in range(3):
            codes[i].append(np.frombuffer(data, "<u2", n, 16 + 8 * n + 2 * n * i))
            rare[i].append(np.frombuffer(data, "<u8", k[i], 16 + 14 * n + 8 * sum(k[:i])))
    words = []
    for c, r in zip(codes, rare, strict=True):
        code = np.concatenate(c)
        x = table[code]
        x[code == NUMBERED + 1] = np.concatenate(r)
        words.append(x)
    return *words, np.concatenate(ns), np.concatenate(rows)


def _sums(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and what their runs add to their scores, from all runs of some pairs (v, w)."""
    at = np.lexsort((u, w, v))
    u, v, w, n, row = u[at], v[at], w[at], n[at], row[at]
    n, last = n >> 1, n & 1
    new2 = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    new3 = new2 | np.concatenate([[True], u[1:] != u[:-1]])
    log3, log2 = (np.log(np.add.reduceat(n, np.flatnonzero(new)))[np.cumsum(new) - 1] for new in (new3, new2))
    return _by_row(row, np.where(u != 0, n * (log3 - log2), 0.0) + last * log2)


def _by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(row, return_inverse=True)
    return own, np.bincount(at, value, len(own))


def _settled(rows: DataFrame, frequent: np.ndarray, hot: np.ndarray, total: int) -> DataFrame:
    """row, value, sums of what a row's runs add in one task; u, v, w, row, n of the runs of ``hot`` pairs; doc_id, row, n_words, w of each row.

    ``n`` is twice the number of a run in its row, and 1 more if the text ends with it. ``w`` of a row is its only word.
    """
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast((*_slots(frequent), hot))
    buckets = max(BUCKETS, -(-total // FULL))
    names = ["u", "v", "w", "row", "n", "doc_id", "n_words"]
    out = ", ".join(f"{c} long" for c in names) + ", value double"

    def chunk(texts: list[tuple], numbers: np.ndarray) -> pa.RecordBatch:
        slots, _, hot = known.value
        base = texts[0][0]
        u, v, w, n = (np.concatenate([t[k] for t in texts]) for k in range(3, 7))
        at = np.repeat([t[0] - base for t in texts], [len(t[3]) for t in texts])
        pair = _mixed(v, w)
        often = hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair if len(hot) else np.zeros(len(pair), bool)
        # the runs of frequent pairs, and the rows themselves, go wherever this chunk's number says
        own = np.where(often, buckets, ((pair >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(own, kind="stable")
        found = []
        for some in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []:
            found.append((int(own[some[0]]), _pack(slots, numbers, (u[some], v[some], w[some]), n[some], at[some])))
        there = zlib.crc32(str(base).encode()) % buckets
        about = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts], pa.int64()), pa.array([t[1] for t in texts], pa.int64()), pa.array([t[2] for t in texts], pa.int64()), pa.array([t[7] for t in texts], pa.int64())], names=["row", "doc_id", "n_words", "w"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as stream:
            stream.write_batch(about)
        found.append((buckets + 1, sink.getvalue().to_pybytes()))
        kind = [max(0, b - buckets + 1) for b, _ in found]
        return pa.RecordBatch.from_arrays([pa.array([there if k else b for k, (b, _) in zip(kind, found, strict=True)], pa.int32()), pa.array(kind, pa.int32()), pa.array([base] * len(found), pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["bucket", "kind", "base", "pack"])

    def pack(batches: Batches) -> Batches:
        texts, held, numbers = [], 0, _numbers(known.value[1])
        for part in slices(batches):
            for doc_id, row, text in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), part.column("text"), strict=True):
                words = word_hashes(text.as_py())
                u, v, w, n = runs(words, 3)[:4] if len(words) else [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)]
                n = 2 * n
                if len(words) > 1:
                    n[(w == words[-1]) & (v == words[-2]) & (u == (words[-3] if len(words) > 2 else 0))] += 1
                pairs = v != 0
                texts.append((row, doc_id, len(words), u[pairs], v[pairs], w[pairs], n[pairs], int(words.view(np.int64)[0]) if len(words) == 1 else None))
                held += len(words) + 16
                if held >= PACKED:
                    yield chunk(texts, numbers)
                    texts, held = [], 0
        if texts:
            yield chunk(texts, numbers)

    def batch(**cols: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols[c].cast(pa.int64()) if c in cols else pa.nulls(size, pa.int64()) for c in names] + [cols.get("value", pa.nulls(size, pa.float64()))], names=[*names, "value"])

    def settle(batches: Batches) -> Batches:
        _, table, _ = known.value
        packs, n_runs, of, sums, n_sums = [], 0, None, [], 0

        def add() -> None:
            nonlocal packs, n_runs, sums, n_sums
            sums.append(_sums(*_unpack(table, packs)))
            packs, n_runs, n_sums = [], 0, n_sums + len(sums[-1][0])
            if n_sums > 2 * PACKED:
                sums = [_by_row(*map(np.concatenate, zip(*sums, strict=True)))]
                n_sums = len(sums[0][0])

        for part in batches:
            for bucket, kind, base, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if kind == 2:
                    about = pa.ipc.open_stream(data).read_all().combine_chunks()
                    yield from (batch(**{c: b.column(c) for c in b.schema.names}) for b in about.to_batches())
                elif kind == 1:
                    u, v, w, n, row = _unpack(table, [(base, data)])
                    yield batch(u=pa.array(u.view(np.int64)), v=pa.array(v.view(np.int64)), w=pa.array(w.view(np.int64)), n=pa.array(n), row=pa.array(row))
                else:
                    if bucket != of and n_runs >= COUNTED:
                        add()
                        if len(sums) == 1 and n_sums > PACKED:  # so many rows, each once
                            yield batch(row=pa.array(sums[0][0]), value=pa.array(sums[0][1]))
                            sums, n_sums = [], 0
                    of = bucket
                    packs.append((base, data))
                    n_runs += int(np.frombuffer(data, "<u4", 1)[0])
        if packs:
            add()
        if sums:
            own, value = _by_row(*map(np.concatenate, zip(*sums, strict=True)))
            yield batch(row=pa.array(own), value=pa.array(value))

    parts = max(2 * sc.defaultParallelism, -(-total // READ))
    packed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(ending(pack, _words.clear), "bucket int, kind int, base long, pack binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(ending(settle), out)


def _most_frequent(words: DataFrame) -> np.ndarray:
    """Hashes of at most NUMBERED words, most frequent first: those of all counts from one on, so that no more is sent."""
    step = F.floor(16 * F.log2("n"))
    sizes = sorted(((r["step"], r["size"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()), reverse=True)
    least, held = math.inf, 0
    for at, size in sizes:
        held += size
        if held > NUMBERED:
            break
        least = at
    if least == math.inf:
        return np.zeros(0, np.uint64)
    found = words.where(step >= least).collect()
    return np.array([r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))], np.int64).view(np.uint64)


def _score_all(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``score`` of order 3 where every n-gram counts.

    Words 3 to k of a text of k words score count(u, v, w) / count(u, v), the second count(v, w) / count(v), the first
    count(w) / words in all; count(v) cancels, and so does count(u, v) of the first two words. What is left of a run of its
    own is the logarithm of count(u, v, w) less that of count(v, w), this but where the text ends.
    """
    words = count_words(docs, id_col, text_col)
    total = words.agg(F.sum("n")).first()[0] or 0
    often = _most_frequent(words)
    rows = text_input(docs, id_col, text_col)
    hot = _often(rows, rows.count(), 3, min(FREQUENT, max(FREQUENT / 10, PACKED / max(1, total))))
    with small_batches(docs.sparkSession):
        each = materialize(_settled(rows, often, hot, total), "sums")
    about = each.where("n_words is not null").select("row", "doc_id", "n_words", "w")
    values = each.where("value is not null").select("row", "value")
    if len(hot):
        own = each.where("n is not null").select(F.struct("u", "v", "w").alias("gram"), "row", F.expr("n div 2").alias("n"), F.expr("n % 2").alias("last"))
        three = materialize(own.groupBy("gram").agg(F.sum("n").alias("n3"), F.count("*").alias("rows")), "hot")
        two = three.groupBy(F.col("gram.v").alias("v"), F.col("gram.w").alias("w")).agg(F.sum("n3").alias("n2"))  # a row for each frequent pair
        met = join_counted(own, three, "gram").select("*", "gram.*").join(F.broadcast(two), ["v", "w"])
        inside = F.when(F.col("u") != 0, F.col("n") * (F.log("n3") - F.log("n2"))).otherwise(0.0)
        values = values.unionByName(met.select("row", (inside + F.col("last") * F.log("n2")).alias("value")))
    one = about.where("n_words = 1").select("row", "w")
    of = one.groupBy("w").agg(F.count("*").alias("rows")).join(words, "w")
    values = values.unionByName(join_counted(one, of, "w").select("row", F.log("n").alias("value")))
    none = F.lit(None).cast("long")
    every = about.select("row", "doc_id", "n_words", F.lit(None).cast("double").alias("value")).unionByName(values.select("row", none.alias("doc_id"), none.alias("n_words"), "value"))
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"))
    return out.withColumn("log_score", F.when(F.col("n_words") > 0, F.col("sum") - math.log(max(1, total))).otherwise(0.0))


def score(docs: DataFrame, min_docs: int = 1, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed over words), mean_log_score; one row per input row.

    Counts are those of all texts, of runs of up to ``order`` (1 to 3) words. With ``min_docs`` over 1 an n-gram that fewer
    documents hold has count 0: that prunes the tables and changes the scores, so it is not the default. A word w after u, v scores count(u, v, w) / count(u, v), else BACKOFF
    times its score after v alone, which is count(v, w) / count(v), else BACKOFF times count(w) / words in all; a text's
    second word has no u, and its first no v.

    A null or empty text has no words and scores 0, rows without an id and repeated rows are scored like others and count
    each, an empty table gives no rows; texts of any length are read whole, other columns are not read.
    """
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    if order == 3 and min_docs <= 1:
        return _score_all(docs, id_col, text_col).select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"))
    words = count_words(docs, id_col, text_col)
    total = words.agg(F.sum("n")).first()[0] or 0
    grams = explode(docs, order, id_col, text_col)
    trigrams, bigrams = count_tables(grams, min_docs)
    # values of bigrams: log(n / count of the first word); of trigrams: log(n / count of the first two)
    of_first = words.select(F.col("w").alias("v"), F.col("n").alias("below"))
    value2 = bigrams.join(of_first, "v").select("v", "w", "hot", F.log(F.col("n") / F.col("below")).alias("value2"))
    of_two = bigrams.select(F.col("v").alias("u"), F.col("w").alias("v"), F.col("n").alias("below"))
    value3 = trigrams.join(of_two, ["u", "v"]).select("u", "v", "w", "hot", F.log(F.col("n") / F.col("below")).alias("value3"))
    key2, key3 = ["v", "w", "salt"], ["u", "v", "w", "salt"]
    dealt = grams.repartition(*key2)  # all three by (v, w, salt), so that the rows of documents move once
    met = dealt.join(_salted(value2).repartition(*key2), key2, "left").join(_salted(value3).repartition(*key2), key3, "left")
    back = math.log(BACKOFF)
    known = F.coalesce(F.col("value3"), F.when(F.col("u") != 0, F.lit(back)).otherwise(0.0) + F.col("value2"))
    steps = F.when(F.col("u") != 0, 2 * back).when(F.col("v") != 0, back).otherwise(0.0)
    doc, often = F.col("w") == 0, F.broadcast(words.where(F.col("n") * WORDS >= total).select("w", F.col("n").alias("count")))
    single = lambda count: F.log(count / float(max(1, total))) + F.col("steps")
    met = met.withColumn("steps", steps).join(often, "w", "left").withColumn("value", F.coalesce(known, single(F.col("count"))) * F.col("n"))
    rest = F.when(~doc & F.col("value").isNull(), F.col("w"))
    each = met.withColumn("rest", rest).groupBy("row", "rest").agg(
        F.max(F.when(doc & (F.col("salt") == 0), F.col("u"))).alias("doc_id"), F.max(F.when(doc, F.col("n"))).alias("n_words"), F.sum(F.when(~doc, F.col("value"))).alias("value"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("steps")).alias("steps")
    )
    with joined_where_they_lie(docs.sparkSession):
        each = materialize(each, "sums")
    done = each.where("rest is null").select("row", "doc_id", "n_words", "value")
    rare = each.where("rest is not null").select("row", F.col("rest").alias("w"), "n", "steps").join(words.select("w", F.col("n").alias("count")), "w")
    none = F.lit(None).cast("long")
    rare = rare.select("row", none.alias("doc_id"), none.alias("n_words"), (F.col("n") * F.log(F.col("count") / float(max(1, total))) + F.col("steps")).alias("value"))
    out = done.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("log_score"))
    return out.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"))
