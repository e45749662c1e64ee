"""Repeated strings against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from sparktext.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, first int, lead string"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeéñ ") for _ in range(n))
    shared = [word(rng.randint(30, 300)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(word(rng.randint(1, 120)))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(len(s))
                parts.append(s[a:] if rng.random() < 0.5 else s)
        texts.append("".join(parts))
    texts += ["a" * 500, "ab" * 200, texts[3], texts[3], "", None, word(35), "x" * 39, "x" * 40, shared[0] * 3]
    texts += [word(20) + shared[1] + word(20) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("seed", "key_segments"), [(1, 50_000), (2, 50_000), (3, 4), (4, 1)])
def test_spans_equal_brute_force(spark, seed, key_segments):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "extra") for i, t in enumerate(texts)], SCHEMA)
    rows = suffix_dedup.remove_repeated(docs, length=40, key_segments=key_segments).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_null_ids_and_repeated_rows(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(90))
    docs = spark.createDataFrame([(None, text), (None, "short"), (7, text), (7, text), (8, None)], "doc_id bigint, text string")
    rows = suffix_dedup.remove_repeated(docs, length=40).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in rows) == [(-1, 0), (-1, 90), (7, 90), (7, 90), (8, 0)]


def test_empty_table_and_short_length(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeated(empty).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.repeated_strings(empty, length=10)


WORD = re.compile(r"[\u3000-\u9fff]|[^\x20\x09-\x0d\u3000-\u9fff]+")


def brute_words(texts, length):
    found = [list(WORD.finditer(t or "")) for t in texts]
    words = [[m.group() for m in f] for f in found]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for t, f, w in zip(texts, found, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept, at = "", 0
        for i, m in enumerate(f):
            if gone[i]:
                kept += (t or "")[at : m.start()] if not (i and gone[i - 1]) else ""
                at = m.end()
        out.append(kept + (t or "")[at:])
    return out


def word_corpus(seed):
    rng = random.Random(seed)
    glue = lambda ws: "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in ws)
    word = lambda: rng.choice(["a", "bé", "to", "of", "漢字", "x漢y", "it", "カナ", "we", "no"])
    shared = [[word() for _ in range(rng.randint(10, 60))] for _ in range(6)]
    texts = [glue([word() for _ in range(rng.randint(0, 30))] + rng.choice(shared)[rng.randint(0, 5) :] + [word() for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    return [*texts, "a " * 80, "", None, "  ", texts[4], texts[4], "漢" * 30, "漢字" * 30, "one"]


@pytest.mark.parametrize(("seed", "key_segments"), [(1, 50_000), (2, 3), (3, 1)])
def test_repeated_words_equal_brute_force(spark, seed, key_segments):
    texts = word_corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "extra") for i, t in enumerate(texts)], SCHEMA)
    windows = {r.doc_id: r.windows for r in suffix_dedup.windows_by_document(docs, 14, unit="words", key_segments=key_segments).collect()}
    got = [suffix_dedup.kept_bytes((t or "").encode(), windows[i], 14, "words")[1].decode() if i in windows else t or "" for i, t in enumerate(texts)]
    assert got == brute_words(texts, 14)
