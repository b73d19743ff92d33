"""Language identification in two steps: the family of languages, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.rows import arrow_map, text_input

#: Families of closely related languages; a language that is not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
WIDTH = 2_048
ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
_ODD = np.uint32(0x9E3779B1)


def features(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashed shares of 1-, 2- and 3-character runs, square-rooted and scaled to length 1 (so that long texts count alike).

    Lower case; what is neither letter nor apostrophe is one blank. Texts of any length are counted whole.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(width, dtype=np.float64)
    for at in range(0, len(chars), 1 << 18):
        part = chars[max(0, at - 2) : at + (1 << 18)]
        letter = ((part >= 97) & (part <= 122)) | (part >= 0xAA)
        part = np.where(letter, part, np.uint32(32))
        part = part[np.concatenate([[True], (part[1:] != 32) | (part[:-1] != 32)])] if len(part) else part
        run = part
        for k in ORDERS:
            if k > 1:
                run = run[:-1] * _ODD + part[k - 1 :] if len(part) >= k else run[:0]
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * k)
            total += np.bincount((mixed >> np.uint32(16)) % np.uint32(width), minlength=width)
    total = np.sqrt(total)
    norm = np.sqrt((total * total).sum())
    return (total / norm if norm else total).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, c: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a linear SVM, labels +1 and -1, by stochastic sub-gradients averaged over epochs."""
    order, w, kept = np.random.default_rng(seed), np.zeros(x.shape[1] + 1), []
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    step = 0
    for _ in range(epochs):
        for own in np.array_split(order.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            rate = 1 / (c * (step + 1 / c / 4))
            miss = own[y[own] * (x[own] @ w) < 1]
            w *= 1 - rate * c
            w += rate / len(own) * ((y[miss] * weight[miss]) @ x[miss])
        kept.append(w.copy())
    return np.mean(kept[len(kept) // 2 :], axis=0)


@dataclass(frozen=True)
class Model:
    """families: family of each language; by_family: its languages; pairs: weights by (first, second)."""

    by_family: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def _vote(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row among ``names`` by one-versus-one votes, ties by margin; and its surest doubt."""
        votes, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), 30.0)
        for i, j in combinations(range(len(names)), 2):
            w = self.pairs[names[i], names[j]]
            margin = np.clip(x @ w[:-1] + w[-1], -30, 30)
            votes[:, i] += (margin >= 0) + margin * 1e-6
            votes[:, j] += (margin < 0) - margin * 1e-6
            least[:, i], least[:, j] = np.minimum(least[:, i], margin), np.minimum(least[:, j], -margin)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: sureness of the family times that of the language) of each row of features."""
        families = sorted(self.by_family)
        family, score = self._vote(x, families)
        out = np.empty(len(x), dtype=object)
        for k, name in enumerate(families):
            own = np.flatnonzero(family == k)
            langs = self.by_family[name]
            best, sure = self._vote(x[own], langs)
            out[own] = np.array(langs, dtype=object)[best] if len(own) else []
            score[own] *= sure
        return out.tolist(), score


def train(docs: DataFrame, families: Mapping[str, str] = FAMILIES, per_language: int = 2_000, in_all: int = 40_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Model:
    """Fit on at most ``per_language`` texts of each language, those with the least hash of their id: a bounded sample.

    All languages together have at most ``in_all`` texts (of 4 KB as vectors, some 160 MB). Rows without a language, a
    text or an id are left out. ``docs`` must hold the rows to learn from only.
    """
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in some.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    per_language = max(1, min(per_language, in_all // max(1, len(sizes))))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):  # about a tenth more than asked for is drawn, and cut below
        chosen = chosen | ((F.col(lang_col) == lang) & (draw < int(min(1.0, 1.1 * per_language / n + 50 / n) * (1 << 20))))
    rows = text_input(some.where(chosen), id_col, text_col, F.col(lang_col).alias("lang"), draw.alias("draw"))

    def vectors(part: pa.RecordBatch) -> dict:
        texts = [t.as_py() for t in part.column("text")]
        return {"doc_id": part.column("doc_id"), "lang": part.column("lang"), "draw": part.column("draw"), "x": [features(t).astype(np.float16).tobytes() for t in texts], "letter": [bool(LETTER.search(t)) for t in texts]}

    sample = arrow_map(rows, "doc_id long, lang string, draw long, x binary, letter boolean", vectors).where("letter").select("doc_id", "lang", "draw", "x").collect()
    by_lang: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["draw"], r["doc_id"], r["x"])):
        by_lang.setdefault(r["lang"], []).append(r["x"])
    x_of = {k: np.frombuffer(b"".join(v[:per_language]), dtype=np.float16).astype(np.float32).reshape(-1, WIDTH) for k, v in by_lang.items()}
    by_family: dict[str, list[str]] = {}
    for lang in sorted(x_of):
        by_family.setdefault(families.get(lang, f"only {lang}"), []).append(lang)
    pairs = {}
    for a, b in combinations(sorted(by_family), 2):
        pairs[a, b] = _fit([x_of[k] for k in by_family[a]], [x_of[k] for k in by_family[b]], seed)
    for langs in by_family.values():
        for a, b in combinations(langs, 2):
            pairs[a, b] = _fit([x_of[a]], [x_of[b]], seed)
    return Model(by_family, pairs)


def _fit(plus: list[np.ndarray], minus: list[np.ndarray], seed: int) -> np.ndarray:
    x = np.concatenate([*plus, *minus])
    y = np.concatenate([np.ones(sum(map(len, plus))), -np.ones(sum(map(len, minus)))])
    return train_svm(x, y, seed).astype(np.float32)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), one row per input row; ``und`` with score 0 if the text is null or has no letter, or nothing was learned."""

    def run(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if LETTER.search(t)] if model.by_family else []
        if own:
            names, sure = model.predict(np.stack([features(texts[i]) for i in own]))
            score[own] = sure
            for i, name in zip(own, names, strict=True):
                lang[i] = name
        return {"doc_id": part.column("doc_id"), "lang_pred": lang, "score": score}

    return arrow_map(text_input(docs, id_col, text_col), "doc_id long, lang_pred string, score double", run)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4. Null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, families: Mapping[str, str] = FAMILIES, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from rows that are not held out, predict all.

    One row per input row: a null text, or one without letters, is ``und`` with score 0; rows without an id are not held
    out and not learned from; repeated rows repeat; an empty table gives no rows; texts of any length are read whole.
    """
    model = train(docs.where(~held_out(id_col)), families, lang_col=lang_col, id_col=id_col, text_col=text_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
