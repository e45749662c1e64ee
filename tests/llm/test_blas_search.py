"""Best documents by blocked products, against whole-number arithmetic term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparktext.llm import blas_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, asked in items:
        scores = []
        for (i, c), size in zip(counted, sizes, strict=True):
            m = 25 + (75 * size * n // words if words else 0)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(asked))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(str(item), rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["Aa", "b", "c_", "é", "d9", "x" * 30, "the"]) for _ in range(n))
    same = some(12)
    docs = [(i, some(rng.randint(0, 40))) for i in range(60)] + [(100 - i, same) for i in range(20)]
    docs += [(None, same), (None, same), (80, same), (200, None), (201, ""), (202, "?!_"), (203, "the " * 200_000), (204, "unique")]
    items = [(1, "aa b"), (2, same + " " + same), (3, None), (4, "-"), (None, "unique the"), (1, "nowhere"), (5, "é\u00e9 É d9 D9 d9"), (6, "the"), (6, "the")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, item_id int, score string").repartition(5)
    return docs, items, df, spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, rank int")


@pytest.mark.parametrize("k, item_bytes, tile", [(10, 1 << 20, 64), (3, 600, 2)])
def test_ranks_equal_plain_sums(data, monkeypatch, k, item_bytes, tile):
    docs, items, df, asked = data
    monkeypatch.setattr(search, "TILE_ITEMS", tile)
    got = search.top_documents(df, asked, k, item_bytes=item_bytes).collect()
    assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, k)


def test_empty_tables(data):
    _, _, df, asked = data
    assert search.top_documents(df.limit(0), asked).collect() == []
    assert search.top_documents(df, asked.limit(0)).collect() == []
    assert search.top_documents(df.where("doc_id IN (200, 201)"), asked).collect() == []


def test_sums_stay_exact():
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 9_000_000_000, (3, 40)).astype(np.float64)
    parts = search.exact_parts(weights)
    assert len(parts) > 1 and [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == 40
    impact = rng.integers(0, search.MOST_IMPACT, (40, 7)).astype(np.float64)
    got = sum((weights[:, p] @ impact[p]).astype(np.int64) for p in parts)
    want = weights.astype(np.int64).astype(object) @ impact.astype(np.int64).astype(object)
    assert (got == want.astype(np.int64)).all()
    with pytest.raises(ValueError):
        search.exact_parts(np.full((1, 1), 1e10))


def test_lengths_beyond_64_bits():
    lengths = np.array([10**13, 1])
    got = search.impacts(np.array([2, 1]), lengths, 10**12, 10**15)
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * int(n) * 10**12 // 10**15)) for t, n in ((2, 10**13), (1, 1))]
    assert got.tolist() == want
