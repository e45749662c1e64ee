"""Windows of test items found in documents, against plain search."""

import random
import re

import pytest

from sparktext.llm import positional_index as index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, size, slack=0):
    """{item: [(first word, length)]} of windows whose every word is within slack of its place."""
    doc, out = words(text), {}
    for item, asked in items:
        own = words(asked)
        wide = min(size, len(own))
        for j in range(len(own) - wide + 1) if wide else ():
            for s in range(len(doc) - wide + 1):
                near = (own[j + i] in doc[max(0, s + i - slack) : s + i + slack + 1] for i in range(wide))
                if all(near):
                    out.setdefault("" if item is None else str(item), set()).add((s, wide))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d1", "e", "日本"]) for _ in range(n))
    items = [(1, some(9)), (2, "a-b"), (3, None), (4, ""), (None, some(6)), (5, "Zz"), (5, "e e e e"), (12, some(30))]
    docs = [(i, some(rng.randint(0, 60))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "?!"), (None, items[0][1]), (53, items[7][1].replace(" ", "\n")), (53, items[7][1].replace(" ", "\n"))]
    docs += [(54, (some(3000) + " zz ") * 60), (55, "ab cd" + items[0][1]), (56, items[0][1][:-1]), (57, "zZ")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, hits string, n_words int").repartition(3)
    return docs, items, df, spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id int")


def found(rows):
    out = []
    for r in rows:
        hits = {}
        for h in r.hits:
            hits.setdefault(h.item_id, set()).update((s, h.length) for s in h.first)
        out.append((str(r.doc_id), r.n_words, sorted((k, tuple(sorted(v))) for k, v in hits.items())))
    return sorted(out)


@pytest.mark.parametrize("slack, item_bytes", [(0, 1 << 20), (0, 400), (1, 1 << 20)])
def test_windows_equal_plain_search(spark, data, slack, item_bytes):
    docs, items, df, asked = data
    short = [d for d in docs if len(d[1] or "") < 2000] if slack else docs
    df = df.where("length(text) < 2000 OR text IS NULL") if slack else df
    got = found(index.match_items(index.index_documents(df), asked, window=4, slack=slack, item_bytes=item_bytes).collect())
    want = sorted((str(i), len(words(t)), sorted((k, tuple(sorted(v))) for k, v in brute(t, items, 4, slack).items())) for i, t in short)
    assert got == want


def test_words_covered_and_ids(spark, data):
    docs, items, df, asked = data
    out = index.match_items(index.index_documents(df), asked, window=4)
    rows = out.select("doc_id", "text_hash", index.covered_words(out.hits).alias("n"), index.item_ids(out.hits).alias("ids")).collect()
    got = sorted((str(r.doc_id), r.n, r.ids) for r in rows)
    want = []
    for i, t in docs:
        hits = brute(t, items, 4)
        covered = {p for spans in hits.values() for s, n in spans for p in range(s, s + n)}
        want.append((str(i), len(covered), sorted(hits)))
    assert got == sorted(want)


def test_empty_tables(spark, data):
    docs, _, df, asked = data
    assert index.match_items(index.index_documents(df.limit(0)), asked).collect() == []
    rows = index.match_items(index.index_documents(df), asked.limit(0)).collect()
    assert len(rows) == len(docs) and all(r.hits == [] for r in rows)


def test_terms_end_with_their_text(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, None), (4, "ef gh")], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([("x", "abcd"), ("y", "cdef"), ("z", "ab"), ("w", "cd ef")], "item_id string, text string")
    rows = index.match_items(index.index_documents(df), items).collect()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in rows} == {1: ["z"], 2: [], 3: [], 4: []}
