"""BPE against the tokenizers library, token counts and length buckets against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparktext.llm import bpe, length_buckets, token_counts
from sparktext.llm.common import identified

WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    "", " ", None, "a<|startoftext|>b <|endoftext|>", "<|STARTOFTEXT|>", "ΣΑΣ Σ. Σ's I'LL we'Re", "é å Å ﬁ İstanbul ẞ", "x\x1cy\x1fz\x85w\xa0q",
    "日本語テキスト 👍🏽 ١٢٣ ½", "a" * 5000, "\x00\x01", "don't'll''s 's", "﻿abc ͅᾳ", "__init__ a_b ǅ", "the " * 3000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = "aaeeiou thsnrd'.,!?0123éßñ中\n\t ́Σ"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]


def test_encoding_and_decoding_equal_the_library(spark, texts):
    library = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    encoded = bpe.encode(docs, WORDS)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert ids == want
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, WORDS).collect()}
    assert decoded == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}
    for r in bpe.encode_digests(docs, WORDS).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()


def test_merges_pick_the_lowest_rank_then_the_left():
    ranks = {("a", "a"): 1, ("aa", "a"): 0, ("b", "c"): 2, ("aa", "aa"): 3}
    assert bpe.merge_symbols(list("aaaa"), ranks) == ["aaa", "a"]
    assert bpe.merge_symbols(list("aabc"), ranks) == ["aa", "bc"]
    assert bpe.merge_symbols([], ranks) == []


def test_context_limits(spark, monkeypatch, texts):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, docs int, n_tokens int")
    path, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    lengths = sorted(len(token_counts._encoding(path, pattern).encode_ordinary(t or "")) for t in texts)
    got = token_counts.context_limits(token_counts.length_histogram(docs, path, pattern)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs) for r in got] == sorted(Counter(lengths).items())
    for r in got:
        above = [x for x in lengths if x > r.n_tokens]
        assert (r.docs_above, r.tokens_above) == (len(above), sum(above))
        assert (r.docs_upto, r.tokens_upto) == (len(lengths) - len(above), sum(lengths) - sum(above))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.share_upto == pytest.approx(r.docs_upto / len(lengths))
    empty = docs.limit(0)
    assert token_counts.context_limits(token_counts.length_histogram(empty, path, pattern)).collect() == []


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_have_the_least_padding():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(60, n, replace=False)).astype(np.int64)
        counts = rng.integers(1, 20, n)
        for buckets in (1, 2, 3, 9):
            ends = length_buckets.best_boundaries(lengths, counts, buckets)
            choices = (c for k in range(1, buckets + 1) for c in itertools.combinations(lengths.tolist(), k) if c[-1] == lengths[-1])
            assert len(ends) <= buckets
            assert padding(lengths, counts, ends) == min(padding(lengths, counts, c) for c in choices)
    assert length_buckets.best_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 4) == []


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_batches(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(length_buckets, "SLICE_ROWS", slice_rows)
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.choice([0, 3, 3, 3, 9, 40])))) for i in range(300)]
    rows += [(900, None), (901, "x " * 500), (None, "a b"), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, bucket int, batch int")
    got = length_buckets.pack(length_buckets.word_lengths(identified(docs)), buckets=4, token_budget=100).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len((t or "").split()) + 1) for i, t in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_length and r.padding == r.bucket_length - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    last = {b: max(x for c, x in batches if c == b) for b, _ in batches}
    for (bucket, batch), held in batches.items():
        room = max(1, 100 // held[0].bucket_length)
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert len(held) == room or (batch == last[bucket] and len(held) < room)
    ordered = sorted(got, key=lambda r: (r.bucket, r.batch, r.slot))
    assert [r.n_tokens for r in ordered] == sorted(r.n_tokens for r in got)


def test_missing_lengths_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 6, 4)], "doc_id bigint, text_hash bigint, n_tokens bigint")
    got = {r.doc_id: r for r in length_buckets.pack(rows).collect()}
    assert got[1].bucket is None and got[1].batch is None
    assert (got[2].bucket_length, got[2].padding, got[2].batch, got[2].slot) == (4, 0, 0, 0)
    assert length_buckets.pack(rows.limit(0)).collect() == []


def test_counts_equal_encoded_lengths():
    known = bpe.Vocabulary(str(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(3)
    texts = ["", "Hello  world's", "a<|endoftext|>b", "ab" * 500, "日本語のテキスト", "\x1c x"]
    texts += ["".join(rng.choice("abcdefgh iéß'1") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    for text in texts:
        assert known.count(text) == len(known.encode(text).split())
