import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sightline.llm import byte_bpe, token_counts
from tests.llm.conftest import EDGE

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n, seed=3):
    r = random.Random(seed)
    kinds = [lambda: chr(r.randrange(32, 127)), lambda: r.choice(" \n\t 　'"), lambda: chr(r.randrange(0xA0, 0x2FF)), lambda: chr(r.choice([r.randrange(0x370, 0xD7FF), r.randrange(0x1F300, 0x1F600)])), lambda: r.choice(["'s", "'re", "'ll", "12", "the"])]
    return ["".join(r.choice(kinds)() for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_counts_equal_library(docs, edge, none, library):
    for df in (docs, edge):
        want = sorted((r["doc_id"] is None, r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts.token_counts(df, JSON, P.PATTERN, limit=100).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.token_counts(none, JSON, P.PATTERN).count() == 0


def test_special_strings(frame, library):
    texts = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "x <|endoftext|><|endoftext|> y"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(list(enumerate(texts))), JSON, P.PATTERN).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_every_prefix(library):
    counter = token_counts.PrefixCounter(JSON, P.PATTERN)
    for text in odd_texts(60) + ["it're  don't \n\n x", "'?!v", "    ", ""]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, text


def test_stored_tables_answer_budgets(frame):
    texts = dict(enumerate(odd_texts(8)))
    tables = token_counts.prefix_tables(frame(list(texts.items())), JSON, P.PATTERN)
    rows = {r["doc_id"]: r for r in tables.collect()}
    counter = token_counts.PrefixCounter(JSON, P.PATTERN)
    for r in token_counts.truncation_points(tables, [0, 3, 10_000]).collect():
        text = texts[r["doc_id"]]
        fits = [i for i in range(len(text) + 1) if counter.prefixes(text)[i] <= r["budget"]]
        assert r["n_chars"] == fits[-1]
        assert token_counts.count_at(rows[r["doc_id"]]["prefix_counts"], 10**6) == counter.prefixes(text)[-1]


def test_longest_prefix_within_the_limit(frame, library):
    texts = odd_texts(40, seed=5) + ["a  b   c    d\n\n  e", "it're  don't", "    x", "", "one two three four five"]
    for limit in (0, 1, 3, 7):
        got = token_counts.token_counts(frame(list(enumerate(texts))), JSON, P.PATTERN, limit=limit).collect()
        for r in got:
            text = texts[r["doc_id"]]
            assert r["n_chars_within"] == max(i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= limit), (text, limit)


def test_round_trip_equals_reference(docs, edge, none, reference):
    for df in (docs, edge):
        want = []
        for r in df.collect():
            ids = reference.encode_ordinary(r["text"] or "")
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(df, RANKS, P.PATTERN).collect()]
        assert sorted(got) == sorted(want)
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_encode_offsets_and_decode(edge):
    encoded = byte_bpe.encode_texts(edge, RANKS, P.PATTERN, offsets=True)
    texts = sorted(t or "" for _, t in EDGE)
    assert sorted(r["text"] for r in byte_bpe.decode_ids(encoded, RANKS, P.PATTERN).collect()) == texts
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for text in odd_texts(40, seed=9):
        ids = np.frombuffer(coder.encode([text])[0], dtype="<u4").tolist()
        assert coder.decode(ids) == text and "".join(coder.decode_stream(ids)) == text
        spans = coder.offsets(text, ids)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (s, e), i in zip(spans, ids, strict=True):
            assert coder.bytes_of[i] in text[s:e].encode()
    smile = np.frombuffer(coder.encode(["🙂"])[0], dtype="<u4").tolist()
    assert len(smile) > 1 and coder.decode(smile[:1]) == "�"
    with pytest.raises(UnicodeDecodeError):
        coder.decode(smile[:1], errors="strict")
