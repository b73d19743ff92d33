"""Token counts: exact count of every prefix by dynamic programming.

In byte-pair encoding each prefix of a word has exactly one last token, and a sequence of tokens is an encoding if and
only if every two neighbours encode to themselves. So a table over prefixes holds for position ``i`` its last token
``t`` and ``count[i] = count[i - len(t)] + 1``. Texts are chains of separately encoded words, so their prefix counts
are the running sum over words plus the table of the word that the prefix ends in; tables of words are memoised.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.rows import arrow_map, text_input

#: Words, and pairs of tokens, that a worker remembers; beyond that it starts afresh. Results don't depend on it.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter(dict):
    """Maps a word (one match of the split pattern) to its number of tokens; ``row`` has the count of every prefix."""

    def __init__(self, tokenizer_file: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = tokenizer.model
        self.split = regex.compile(pattern).findall
        self.find = regex.compile(pattern).finditer
        back = {c: b for b, c in enumerate(byte_characters())}
        self.special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.name = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in t) and t not in self.special}
        self.token = {bytes(back[c] for c in t): i for i, t in self.name.items()}
        self.ends = {t[k:]: -1 for t in self.token for k in range(1, len(t))} | self.token  # -1: only ends a token
        self.fits: dict[int, bool] = {}
        self.old: dict[str, int] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` side by side encode to themselves; ``a`` is -1 at a word's start."""
        names = [self.name[x] for x in (a, b) if x >= 0]
        ok = [t.id for t in self.model.tokenize("".join(names))] == [x for x in (a, b) if x >= 0]
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[a << 20 | b] = ok
        return ok

    def _extend(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Fill the table from the first prefix that it lacks."""
        ends, fits = self.ends.get, self.fits.get
        for i in range(len(last), len(word) + 1):
            for j in range(i - 1, -1, -1):
                t = ends(word[j:i])
                if t is None:
                    break
                if t >= 0:
                    ok = fits(last[j] << 20 | t)
                    if ok or ok is None and self._fits(last[j], t):
                        last.append(t)
                        count.append(count[j] + 1)
                        break

    def row(self, word: bytes) -> list[int]:
        """Token count of every prefix of ``word``, by bytes; entry 0 is 0."""
        last, count = [-1], [0]
        self._extend(word, last, count)
        return count

    def learn(self, words: set[str]) -> None:
        """Count words in sorted order, so that a word takes over the table of the prefix it shares with the last one."""
        for w in words.intersection(self.old):
            self[w] = self.old[w]
        words = words.difference(self.old)
        if len(self) > REMEMBERED // 2:  # words that are met again move on from the older half, the others go
            self.old = dict(self)
            self.clear()
        last, count, before = [-1], [0], b""
        for word in sorted(w.encode() for w in words):
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self._extend(word, last, count)
            self[word.decode()] = count[-1]
            before = word

    def forget(self) -> None:
        self.clear()
        self.old = {}
        self.fits.clear()

    def __missing__(self, word: str) -> int:
        return self.old.get(word) or self.row(word.encode())[-1]

    def counts(self, texts: list[str]) -> list[int]:
        words = [self.split(t) for t in texts]
        self.learn({w for w in set().union(*words).difference(self) if len(w) <= 64})
        return [sum(map(self.__getitem__, w)) for w in words]

    def longest_within(self, text: str, limit: int, total: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens; ``total`` is what the whole text has.

        Sums over words lead to the word that exceeds the limit; only prefixes that end there are counted one by one.
        """
        if total <= limit:
            return len(text)
        ends, sums, n = [0], [0], 0
        for m in self.find(text):
            n += self[m[0]]
            ends.append(m.end())
            sums.append(n)
            if len(sums) > 1 and sums[-2] > limit:  # the word after the one that exceeds the limit is needed too
                break
        over = bisect.bisect_right(sums, limit)  # words before it are within the limit
        start = max(0, over - 2)
        best = ends[over - 1]
        for at in range(ends[over - 1] + 1, ends[min(over + 1, len(ends) - 1)] + 1):
            if sums[start] + sum(self[w] for w in self.split(text[ends[start] : at])) <= limit:
                best = at
        return best

    def _by_character(self, word: str) -> np.ndarray:
        """Counts of the prefixes of one word, by characters, first (empty) prefix left out."""
        row = np.array(self.row(word.encode()), dtype=np.int32)
        if len(word) == 3 and word[0] == "'" and word[1:].isalpha():
            row[2] = row[1] + 1  # cut before its last letter, a contraction is split into the apostrophe and a letter
        return row[np.cumsum([len(c.encode()) for c in word])]

    def prefixes(self, text: str) -> np.ndarray:
        """int32 array of length len(text) + 1: tokens of text[:i] for every i."""
        out, done = np.zeros(len(text) + 1, dtype=np.int32), 0
        for m in self.find(text):
            out[m.start() + 1 : m.end() + 1] = done + self._by_character(m[0])
            done += self[m[0]]
        for m in regex.finditer(r"\s+", text):  # a prefix that ends in white space has all of that run as one word
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + self._by_character(m[0])
        return out


@lru_cache(maxsize=4)
def prefix_counter(tokenizer_file: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(tokenizer_file, pattern)


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chars_within, one row per input row.

    ``n_chars_within``: characters of the longest prefix of at most ``limit`` tokens, from the same sums and tables of
    prefixes; null where a text over the limit has special strings. A null text counts as empty: no bytes, no tokens.
    Special strings inside texts are ordinary text where the library encodes them so, else their own token. Null ids
    stay, repeated rows give repeated results, an empty table gives none; texts of any length are counted whole, other
    columns are not read. There is no shuffle; a task keeps at most REMEMBERED words and token pairs.
    """

    def count(part: pa.RecordBatch) -> dict:
        counter, texts = prefix_counter(tokenizer_file, pattern), part.column("text").to_pylist()
        n = _with_special(counter, texts)
        within = [None if x > limit and any(k in t for k in counter.special) else counter.longest_within(t, limit, x) for t, x in zip(texts, n, strict=True)]
        return {"doc_id": part.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n], "n_chars_within": within}

    return arrow_map(text_input(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long", count, lambda: prefix_counter(tokenizer_file, pattern).forget())


def _with_special(counter: PrefixCounter, texts: list[str]) -> list[int]:
    """Counts where special strings inside the texts are single tokens, as the library does by default."""
    has = re.compile("|".join(map(re.escape, sorted(counter.special, key=len, reverse=True))) or r"(?!)")
    parts = [has.split(t) for t in texts]
    n = iter(counter.counts([p for own in parts for p in own]))
    return [sum(next(n) for _ in own) + len(own) - 1 for own in parts]


def prefix_tables(docs: DataFrame, tokenizer_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, prefix_counts: the count of every prefix by code points, as little-endian int32 (entry 0 is 0).

    One row per input row, 4 bytes a character. A null or empty text has a table of one entry; repeated rows repeat, null
    ids stay, an empty table gives no rows, other columns are not read.
    """

    def build(part: pa.RecordBatch) -> dict:
        counter, texts = prefix_counter(tokenizer_file, pattern), part.column("text").to_pylist()
        return {"doc_id": part.column("doc_id"), "n_chars": [len(t) for t in texts], "prefix_counts": [counter.prefixes(t).astype("<i4").tobytes() for t in texts]}

    return arrow_map(text_input(docs, id_col, text_col), "doc_id long, n_chars long, prefix_counts binary", build, lambda: prefix_counter(tokenizer_file, pattern).forget())


def count_at(prefix_counts: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters (all, if there are fewer), from a stored table."""
    table = np.frombuffer(prefix_counts, dtype="<i4")
    return int(table[min(n_chars, len(table) - 1)])


def fit_budget(prefix_counts: bytes, budget: int) -> int:
    """The longest prefix, in characters, of at most ``budget`` tokens, from a stored table."""
    return int(np.flatnonzero(np.frombuffer(prefix_counts, dtype="<i4") <= budget)[-1])


def truncation_points(tables: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, budget, n_chars kept: each stored table answers every budget without a text being encoded again."""

    def ask(part: pa.RecordBatch) -> dict:
        asked = [(i, b, fit_budget(t, b)) for i, t in zip(part.column("doc_id").to_pylist(), part.column("prefix_counts").to_pylist(), strict=True) for b in budgets]
        return {"doc_id": [x[0] for x in asked], "budget": [x[1] for x in asked], "n_chars": [x[2] for x in asked]}

    return arrow_map(tables.select("doc_id", "prefix_counts"), "doc_id long, budget long, n_chars long", ask)
