"""Lattice language model and multiple-instance classifier."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sparktext.llm import lattice_lm, mil_quality

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def splits(word):
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_word_probability_sums_all_segmentations():
    first, later = lattice_lm.read_pieces(PIECES)
    pieces = lattice_lm.Pieces.weighted(first, later)
    assert sum(map(math.exp, pieces.first.values())) == pytest.approx(1)
    assert sum(map(math.exp, pieces.later.values())) == pytest.approx(1)
    for word in ("the", "nation", "é", "x", "日本x"):
        total = 0.0
        for parts in splits(word):
            for empty_start in (False, True):
                if empty_start:
                    p, rest = pieces.first[""], parts
                elif parts[0] in pieces.first:
                    p, rest = pieces.first[parts[0]], parts[1:]
                else:
                    continue
                for part in rest:
                    if part in pieces.later:
                        p += pieces.later[part]
                    elif len(part) == 1:
                        p += sum(pieces.later[f"<0x{b:02X}>"] for b in part.encode())
                    else:
                        p = -math.inf
                total += math.exp(p + pieces.later[lattice_lm.END_OF_WORD])
        assert lattice_lm.word_log_probability(word, pieces, pieces.longest()) == pytest.approx(math.log(total))


def test_many_words_at_once_equal_single_words():
    rng = random.Random(5)
    pieces = lattice_lm.Pieces.weighted(*lattice_lm.read_pieces(PIECES))
    words = ["".join(rng.choice("etaonéñ日x1\x1c") for _ in range(rng.choice([1, 2, 3, 8, 15, 41, 60]))) for _ in range(120)] + ["the", "the"]
    lattice = lattice_lm.Lattice(pieces)
    assert lattice.log_probabilities(words) == pytest.approx([lattice_lm.word_log_probability(w, pieces, pieces.longest()) for w in words])
    want, got = (Counter(), Counter()), (Counter(), Counter())
    for w in words:
        lattice_lm._uses(w, pieces, pieces.longest(), *want)
    lattice.uses(words, *got)
    for a, b in zip(want, got, strict=True):
        assert all(a[k] == pytest.approx(b[k], abs=1e-3) for k in {*a, *b})
    assert lattice.log_probabilities([]).tolist() == []


def test_scores_and_base(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "Nation", f"w{rng.randint(0, 40)}", f"u{i}x{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "a\x1cb \x85"), (503, "z" * 3000), (503, "z" * 3000), (None, "the the")]
    docs = spark.createDataFrame([(*r, True, "w", 9) for r in rows], "doc_id bigint, text string, held_out boolean, word string, n int")
    got = lattice_lm.score_documents(docs, PIECES).collect()
    assert len(got) == len(rows)
    count, tokens = Counter(), lambda t: [*(t or "").encode().lower().split(), b""]
    out = {r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows}
    for r in rows:
        if not out[r]:
            count.update(tokens(r[1]))
    n, v = sum(count.values()), len(count)
    by_id = {r.doc_id: r for r in got}
    for r in set(rows):
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r[1]))
        row = by_id[r[0]]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (out[r], len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), n)
        assert row.base_score == pytest.approx(want)
        assert row.score < 0 and math.isfinite(row.score)


def test_rare_and_frequent_words_score_alike(spark, monkeypatch):
    rows = [(i, "the of the nation w%d w%d" % (i % 7, i % 7)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    every = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, PIECES).collect()}
    monkeypatch.setattr(lattice_lm, "FREQUENT_WORDS", 2)
    few = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, PIECES).collect()}
    assert few == pytest.approx(every)


def test_nothing_learned_and_empty_table(spark):
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = lattice_lm.score_documents(spark.createDataFrame([(lone, "a bc")], "doc_id bigint, text string"), PIECES).collect()
    assert rows[0].train_tokens == 0 and rows[0].base_score == pytest.approx(0) and math.isfinite(rows[0].score)
    assert lattice_lm.score_documents(spark.createDataFrame([], "doc_id bigint, text string"), PIECES).collect() == []


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, mil_quality.FEATURES)) for n in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    model = mil_quality.fit(bags, y, hidden=4, epochs=1)
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        s = model.score(x, starts)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in model.gradients(x, starts, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-5
        up = loss()
        model.p[name][at] = kept - 1e-5
        down = loss()
        model.p[name][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def quality_rows(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 400))]
        bad = rng.random() < 0.25
        if bad:
            a = rng.randrange(len(words))
            words[a:] = [w.upper() + "!!" for w in words[a:]] if rng.random() < 0.5 else [words[a]] * (len(words) - a + 20)
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_held_out_accuracy_and_attention(spark):
    rows = quality_rows(1)
    docs = spark.createDataFrame([(i, t, 0.5, "l") for i, t, _ in rows], "doc_id bigint, text string, score double, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = mil_quality.train(docs, labels)
    got = mil_quality.score(docs, model).collect()
    right = [(r.score >= 0.5) == rows[r.doc_id][2] for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(right) > 60 and sum(right) / len(right) > 0.93
    column = docs.select("doc_id", mil_quality.score_column(model, docs["text"]).alias("s")).collect()
    assert {r.doc_id: r.s for r in column} == pytest.approx({r.doc_id: r.score for r in got})


def test_odd_rows_have_scores(spark):
    rows = quality_rows(2, 60)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, ""), (901, " \n"), (901, " \n"), (902, "a" * 200_000)], "doc_id bigint, text string")
    model = mil_quality.train(docs, labels)
    got = mil_quality.score(docs, model).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert mil_quality.score(empty, mil_quality.train(empty, labels.limit(0))).collect() == []
