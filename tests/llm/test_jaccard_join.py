"""Components of near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from sparktext.llm import jaccard_join

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        lowered = lowered.replace(b, " ")
    return [w for w in lowered.split(" ") if w]


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = []
    passage = text(40)
    for _ in range(12):
        base = text(rng.randint(3, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    base = text(100)
    for i in range(60):  # a crowded region, with a chain along it
        copy = list(base)
        for k in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = f"e{i}{k}"
        out.append(" ".join(copy))
    for i in range(100, 140):
        out.append(" ".join(base[: 100 - (i - 100) * 2] + [f"c{k}" for k in range((i - 100) * 2)]))
    out += [" ".join(text(10) + passage + text(rng.randint(1, 30))) for _ in range(40)]
    out += ["", None, "  \n", "One  two", "one two", "one two three", out[0].upper(), out[0], "é \x1c é", "a\x85b c d e f"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 5000), (2, 12), (3, 4)])
def test_components_equal_brute_force(spark, seed, limit):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, region string")
    rows = jaccard_join.linked_components(docs, region_limit=limit).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_no_link_is_lost_between_pivots():
    rng = np.random.default_rng(4)
    base = np.arange(200)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.1, 0.2]), rng.integers(1000, 9000, 200), base)) for _ in range(150)]
    region = jaccard_join.Region(np.array([len(s) for s in sets]), sets, 80)
    got = jaccard_join.region_components(region)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    pairs = lambda c: {(i, j) for i in range(len(c)) for j in range(i) if c[i] == c[j]}
    assert pairs(list(got)) == pairs(root)


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "")], "doc_id bigint, text string")
    rows = jaccard_join.linked_components(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    assert jaccard_join.linked_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
