import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import decontaminate, importance, language_id, ngram_lm, queries
from tests.llm.conftest import passage

ITEM = "A train leaves Paris Gare at 9 and goes 120 km in 2 hours, then Paris Gare calls it back after 45 minutes of waiting there."


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def plain_scores(rows, order, min_docs=1):
    """(doc_id, n_words, log_score) by counting runs of words in dictionaries."""
    rows = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts, spread = Counter(), Counter()
    for _, w in rows:
        grams = [tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]
        counts.update(grams)
        spread.update(set(grams))
    total, out = sum(n for g, n in counts.items() if len(g) == 1), []
    for doc_id, w in rows:
        s = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1 or spread[gram] >= min_docs:
                    s += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
                    break
                s += math.log(0.4)
        out.append((str(doc_id), len(w), s))
    return sorted(out)


def scored(df, **options):
    return sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in ngram_lm.score(df, **options).collect())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(docs, edge, order):
    for df in (docs, edge):
        want = plain_scores([(r["doc_id"], r["text"]) for r in df.collect()], order)
        for a, b in zip(scored(df, order=order), want, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-7)


def test_scores_of_hot_pairs_and_rare_words(frame, monkeypatch):
    monkeypatch.setattr(ngram_lm, "WORDS", 30)
    texts = [(k, f"same pair {passage(k, 6)} same pair {k} x") for k in range(200)] + [(None, "same pair"), (7, "same pair"), (7, "same pair")]
    for options in ({}, {"min_docs": 2}, {"min_docs": 5}):
        for a, b in zip(scored(frame(texts), **options), plain_scores(texts, 3, **options), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-7)


def test_packed_runs_are_whole():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 64, 5_000, np.uint64, endpoint=False)
    slots, table = ngram_lm._slots(words[:3_000])
    u, v, w = (words[rng.integers(0, 5_000, 20_000)] for _ in range(3))
    u[::7] = 0
    n, at = rng.integers(1, 1 << 31, 20_000), np.sort(rng.integers(0, 1 << 17, 20_000))
    packs = [(base, ngram_lm._pack(slots, ngram_lm._numbers(table), (u[own], v[own], w[own]), n[own], at[own])) for base, own in ((0, slice(0, 9)), (1 << 40, slice(9, 20_000)))]
    for got, want in zip(ngram_lm._unpack(table, packs), (u, v, w, n, at + np.repeat([0, 1 << 40], [9, 19_991])), strict=True):
        assert (got == want).all()


def test_scores_move_runs_once(spark, docs):
    """Words' counts and a sample of pairs move too, 20 bytes a word in all here; where runs were dealt twice as rows it was 145."""
    shuffled = lambda: sum(e.totalShuffleWrite() for e in conversions.asJava(store.executorList(False)))
    store, conversions = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters
    before = shuffled()
    n_words = sum(n for _, n, _ in scored(docs))
    assert shuffled() - before < 40 * n_words


def test_scores_without_words(frame, none):
    assert ngram_lm.score(none).count() == 0
    assert scored(frame([(1, None), (2, ""), (2, ""), (None, "  ")])) == [("1", 0, 0.0), ("2", 0, 0.0), ("2", 0, 0.0), ("None", 0, 0.0)]


def test_leaks_equal_plain_search(spark, docs, sf_dir):
    """Where texts have no slots, a leak is a document with half or more of an item's windows in line."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.template(r["text"])[0].tolist() for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words, slots = decontaminate.template(r["text"])
        words = words.tolist()
        seen = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        for item, t in items.items():
            windows = [tuple(t[i : i + 8]) for i in range(len(t) - 7)]
            if sum(w in seen for w in windows) >= 0.5 * len(windows):
                want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and len(want) > 2


def test_reparameterised_questions(spark, frame):
    base = passage(5, 60)
    texts = {
        1: f"{base} {ITEM} {base}",
        2: f"{base}. {ITEM.replace('120', '350').replace('Paris Gare', 'Lyon Part Dieu').replace('45', '7')} {base}",
        3: f"{base}. {ITEM.replace('Paris Gare at', 'Lyon Nord at').replace('Paris Gare calls', 'Metz Sud calls')}",
        4: base,
        5: ITEM.upper(),
        6: " ".join(ITEM.split()[:8]),
    }
    got = {r["doc_id"]: r for r in decontaminate.leaks(frame(list(texts.items())), benchmark(spark, [(1, ITEM), (9, ITEM), (2, None), (3, ""), (4, "too short")])).collect()}
    assert {1, 2} <= set(got) and not {3, 4, 6} & set(got)
    assert got[2]["reparameterised"] and not got[1]["reparameterised"] and got[1]["item_id"] == 1


def plain_template(text):
    """Template words and slot values by a plain reading of the rules, word by word."""
    out, begins = [], True
    for raw in text.replace("\n", ". ").split():
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        ends = raw[-1] in ".!?:;"
        if not bare:
            if raw in ("%", "€", "$", "£"):
                out.append(("unit", raw) if out and out[-1][0] == "number" else (raw, None))
                begins = False
            begins = begins or ends
            continue
        if bare[0].isdigit() and re.fullmatch(r"[-+(]?[$€£]?\d[\d.,:/-]*[%]?", bare):
            out.append(("number", bare.lower()))
        elif out and out[-1][0] == "number" and bare.lower() in decontaminate.UNITS:
            out.append(("unit", bare.lower()))
        elif bare[0].isupper() and (len(bare) == 1 or bare[1:].islower()) and not begins:
            if out and out[-1][0] == "name":
                out[-1] = ("name", f"{out[-1][1]} {bare.lower()}")
            else:
                out.append(("name", bare.lower()))
        else:
            out.append((bare.lower(), None))
        begins = ends
    return out


def plain_leaks(rows, items, coverage=0.5):
    """(doc_id, item_id, coverage, reparameterised) by comparing every window of every item with every place of every row."""
    of, out = {}, set()
    for item, text in sorted(items):
        t = plain_template(text or "")
        if len(t) >= decontaminate.LEAST_WORDS:
            of.setdefault(tuple(w for w, _ in t), (item, t))
    for doc_id, text in rows:
        d = plain_template(text or "")
        at = {}
        for size in {min(8, len(t)) for _, t in of.values()}:
            for p in range(len(d) - size + 1):
                at.setdefault(tuple(x for x, _ in d[p : p + size]), []).append(p)
        for item, t in of.values():
            size = min(8, len(t))
            met = sorted((p - w, w, p) for w in range(len(t) - size + 1) for p in at.get(tuple(x for x, _ in t[w : w + size]), ()))
            stretches, last = [], None
            for line, w, p in met:
                if last is None or line - last > 32:
                    stretches.append([])
                stretches[-1].append((w, p))
                last = line
            best = (0, False)
            for own in stretches:
                pairs = {w: {(a[1], b[1]) for a, b in zip(t[w : w + size], d[p : p + size], strict=True) if a[1] is not None} for w, p in own}
                each = [(w, {(a[1], b[1]) for a, b in zip(t[w : w + size], d[p : p + size], strict=True) if a[1] is not None}) for w, p in own]
                every = set().union(*(x for _, x in each)) if pairs else set()
                agree = len(every) == len({i for i, _ in every})
                n = len({w for w, x in each if agree or all(i == v for i, v in x)})
                best = max(best, (n, not (agree and any(i != v for i, v in every))))
            if best[0] >= coverage * (len(t) - size + 1):
                out.add((doc_id, item, round(best[0] / (len(t) - size + 1), 9), not best[1]))
    return out


def found_leaks(df, items):
    return {(r["doc_id"], r["item_id"], round(r["coverage"], 9), r["reparameterised"]) for r in decontaminate.leaks(df, items).collect()}


def test_leaks_equal_brute_force(spark, docs, edge, frame, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found_leaks(docs, bench) == plain_leaks(rows, [tuple(r) for r in bench.select("item_id", "text").collect()])
    rng = random.Random(11)
    words = "the train goes to a city of Paris Lyon Metz with 3 4 5 km hours and then back again from town".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 14, 30])))) for k in range(20)]
    texts = []
    for k in range(60):
        own = []
        for _ in range(3):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(part))
                part[at] = rng.choice(words)
            own += part[rng.randrange(3) :] + ["so"] * rng.randrange(3)
        texts.append((k, " ".join(own)))
    assert found_leaks(frame(texts), benchmark(spark, items)) == plain_leaks(texts, items)
    assert len(plain_leaks(texts, items)) > 20


def test_repeated_window_and_contradicting_lines(spark, frame):
    item = "we went by train to the city of Paris and there we saw that the town of Paris has many old bridges"
    window = " ".join(item.split()[:7])
    texts = [(1, " so ".join([window + " city"] * 9)), (2, item.replace("city of Paris and", "city of Lyon and so so").replace("town of Paris", "town of Metz")), (3, item.replace("Paris", "Lyon")), (4, item)]
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(frame(texts), benchmark(spark, [(1, item)])).collect()}
    assert got == {3: True, 4: False}


def test_items_that_differ_in_values_are_items_of_their_own(spark, frame, tmp_path):
    """Item 1 asks twice for one value, item 2 for two: a row with two other values holds item 2, not 1; item 9 equals item 2."""
    ask = "how many hours does the train need for {} km if it goes back for {} km and rests at night"
    items = [(1, ask.format(3, 3)), (2, ask.format(3, 4)), (9, ask.format(3, 4).upper().lower())]
    texts = [(1, ask.format(7, 7)), (2, ask.format(7, 8)), (3, ask.format(3, 4)), (4, passage(3))]
    bench = benchmark(spark, items)
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(frame(texts), bench).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 2, False)} <= got and (2, 1) not in {x[:2] for x in got}
    assert {tuple(r) for r in decontaminate.item_classes(bench).collect()} == {(1, 1), (2, 2), (9, 2)}
    frame(texts).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    each = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, str(tmp_path)).collect()}
    assert {(2, 2), (2, 9), (3, 2), (3, 9)} <= each


def test_leaks_edge_cases(spark, edge, none):
    items = benchmark(spark, [(1, passage(1)), (2, None), (3, "The quick brown fox jumps")])
    assert {r["doc_id"] for r in decontaminate.leaks(edge, items).collect()} == {4, 5}
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(edge, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(edge, items)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3


def test_templates():
    words, slots = decontaminate.template("He paid 3 kg. Then Ada Lovelace got 5.5 euros\nNow the CAT ran")
    number, unit, name = (int(x) for x in (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME))
    kind = ["n" if w == number else "u" if w == unit else "N" if w == name else "." for w in words.tolist()]
    assert "".join(kind) == "..nu.N.nu...."
    assert [s != 0 for s in slots.tolist()] == [k != "." for k in kind]


def test_importance_equals_brute_force(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target, of = Counter(), Counter(), {}
    for r in docs.collect():
        of[r["doc_id"]] = importance.buckets(r["text"]).tolist()
        raw.update(of[r["doc_id"]])
        if r["doc_id"] in good:
            target.update(of[r["doc_id"]])
    n, m, b = sum(raw.values()), sum(target.values()), importance.BUCKETS
    got = {r["doc_id"]: r for r in importance.resample(docs, labels).collect()}
    assert set(got) == set(of)
    for i, own in of.items():
        want = sum(math.log((target[x] + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b)) for x in own)
        assert got[i]["log_weight"] == pytest.approx(want, rel=1e-9, abs=1e-6)
    keys = sorted((got[i]["gumbel_key"] for i in good), reverse=True)
    least = keys[math.ceil(0.999 * len(good)) - 1]
    assert all(r["selected"] == (r["gumbel_key"] >= least) for r in got.values())
    top = {r["doc_id"] for r in importance.resample(docs, labels, k=25).collect() if r["selected"]}
    assert top == set(sorted(got, key=lambda i: -got[i]["gumbel_key"])[:25])


def test_importance_tells_junk_apart(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = importance.resample(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in out.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_importance_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    assert importance.resample(edge, labels).count() == edge.count()
    assert importance.resample(none, labels).count() == 0
    assert importance.resample(edge, labels.limit(0)).where("not selected").count() == 0
    assert importance.keep_selected(edge, labels).columns == edge.columns
    assert importance.resample(edge, labels, k=0).where("selected").count() == 0


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x % 97) + (1e-12 if x % 2 else 0),) for x in range(500)] + [(None,)], "v double")
    want = sorted((r["v"] for r in df.collect() if r["v"] is not None), reverse=True)
    for k in (1, 2, 77, 250, 500):
        assert importance.kth_largest(df, "v", k, bins=8) == want[k - 1]
    assert importance.kth_largest(df, "v", 501) is None


def test_languages(docs, edge, none):
    out = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge).collect()}
    assert len(got) == len({r["doc_id"] for r in edge.collect()})
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_learning_ignores_held_out_labels(docs):
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert a == {r["doc_id"]: r["lang_pred"] for r in language_id.identify(other).collect()}
