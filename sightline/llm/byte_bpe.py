"""Byte-level BPE encoding and decoding with the tokenizers library, from a file of ranks."""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.rows import arrow_map, text_input
from sightline.llm.token_counts import byte_characters

#: Words whose ids a worker remembers; results don't depend on it.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token: the two parts left of it when only merges of lower rank are applied."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """Ids of texts by ranks, each match of the split pattern on its own; and texts of ids."""

    def __init__(self, rank_file: str, pattern: str):
        from tokenizers import Tokenizer, models

        ranks, char = read_ranks(rank_file), byte_characters()
        self.to_chars = {b: c for b, c in enumerate(char)}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = np.zeros(max(self.bytes_of, default=-1) + 1, dtype=np.int64)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        name = {t: "".join(map(char.__getitem__, t)) for t in ranks}
        merges = [(name[a], name[b]) for a, b in merges_of(ranks)]
        self.model = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ranks.items()}, merges=merges)).model
        self.whole = {t: np.uint32(i).astype("<u4").tobytes() for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one match as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        if raw in self.whole:
            return self.whole[raw]
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.to_chars))], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        words = [self.split(t) for t in texts]
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        young, old, passing = self.young, self.old, {}
        for w in set().union(*words).difference(young):
            ids = old.get(w) or self._word(w)
            (young if len(w) <= 64 else passing)[w] = ids
        find = {**young, **passing}.__getitem__ if passing else young.__getitem__
        return [b"".join(map(find, w)) for w in words]

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int], errors: str = "replace") -> str:
        """Text of ids; a character whose bytes are incomplete becomes U+FFFD, or raises with errors="strict"."""
        return self.decode_bytes(ids).decode("utf-8", errors)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text piece by piece: a character that is split over several ids comes out with its last one."""
        waiting = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield waiting.decode(self.bytes_of[i])
        yield waiting.decode(b"", final=True)

    def offsets(self, text: str, ids: Iterable[int]) -> list[tuple[int, int]]:
        """(start, end) in characters for each id: from the character with its first byte to past that with its last."""
        return list(zip(*(x.tolist() for x in self.spans(text, np.fromiter(ids, np.int64))), strict=True))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``offsets`` as an array of starts and one of ends."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        owner = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[ids])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return owner[starts], owner[ends - 1] + 1


@lru_cache(maxsize=4)
def byte_bpe(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def forgetting(rank_file: str, pattern: str) -> Callable[[], None]:
    """What a task does at its end: the coder stays in the worker, its words go."""
    return lambda: byte_bpe(rank_file, pattern).forget()


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), and with ``offsets`` also starts and ends in characters.

    One row per input row; a null or empty text has no ids, an empty table gives no rows, ids may be null or repeat, and
    repeated rows give repeated results. Texts of any length are encoded whole, and other columns, whatever their names,
    are not read. There is no shuffle; a task remembers at most REMEMBERED words, and forgets them at its end.
    """
    more = ", starts array<int>, ends array<int>" if offsets else ""

    def encode(part: pa.RecordBatch) -> dict:
        coder, texts = byte_bpe(rank_file, pattern), part.column("text").to_pylist()
        packed = [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in coder.encode(texts)]
        out = {"doc_id": part.column("doc_id"), "n_tokens": [len(p) for p in packed], "ids": _lists(packed)}
        if offsets:
            spans = [coder.spans(t, p) for t, p in zip(texts, packed, strict=True)]
            out |= {"starts": _lists([s for s, _ in spans]), "ends": _lists([e for _, e in spans])}
        return out

    return arrow_map(text_input(docs, id_col, text_col), f"doc_id long, n_tokens long, ids array<int>{more}", encode, forgetting(rank_file, pattern))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: ids back to text, incomplete characters become U+FFFD.

    One row per input row: a null or empty list becomes the empty text, repeated rows repeat, an empty table gives no
    rows, other columns are not read.
    """

    def decode(part: pa.RecordBatch) -> dict:
        coder = byte_bpe(rank_file, pattern)
        return {"doc_id": part.column("doc_id"), "text": [coder.decode(x or ()) for x in part.column("ids").to_pylist()]}

    rows = encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids")
    return arrow_map(rows, "doc_id long, text string", decode)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the decoded bytes), n_split.

    ``n_split``: tokens whose offsets overlap the token before, as a character's bytes are split between the two. One
    row per input row: a null or empty text has no ids and the digests of nothing, repeated rows repeat, null ids stay,
    an empty table gives no rows, texts of any length are encoded whole, other columns are not read.
    """

    def digest(part: pa.RecordBatch) -> dict:
        coder, texts = byte_bpe(rank_file, pattern), part.column("text").to_pylist()
        packed = coder.encode(texts)
        ids = [np.frombuffer(p, dtype="<u4") for p in packed]
        spans = (coder.spans(t, p) for t, p in zip(texts, ids, strict=True))
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": [len(p) for p in ids],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(coder.decode_bytes(p.tolist())).hexdigest() for p in ids],
            "n_split": [int((starts[1:] < ends[:-1]).sum()) for starts, ends in spans],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
    return arrow_map(text_input(docs, id_col, text_col), schema, digest, forgetting(rank_file, pattern))
