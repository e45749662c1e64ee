"""The subset walk and the document cells, against counting."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sparktext.llm import filter_audit as audit


def test_walk_equals_counting():
    rng = np.random.default_rng(5)
    for k in range(1, 7):
        cells = rng.integers(0, 50, (1 << k, 3))
        states = audit.walk(cells)
        for subset in range(1 << k):
            assert (states[subset] == cells[(np.arange(1 << k) & subset) == 0].sum(0)).all()


def flags(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | any(c in "#$%&*|" for c in text) << 3


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice([f"w{rng.randint(0, 90)}", "Up", "é#", "x"]) for _ in range(rng.choice([3, 60, 49, 50]))) for _ in range(30)]
    texts += ["", None, "ABC", "a" * 20 + "B", "a" * 19 + "B", "lone\tword " * 30_000, "\n"]
    docs = [(rng.randint(0, 60), t, rng.choice(["s", "t", None, ""])) for t in texts for _ in range(rng.choice([1, 1, 2, 5]))]
    docs += [(7, texts[0], "s"), (7, texts[0], "s"), (None, texts[0], "s"), (None, texts[0], "t"), (None, None, None), (1000, "once", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return docs, labels


def brute(docs, labels):
    """Masks by part, then every order step by step."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marked = [(s or "", flags(t or "") | (i is not None and i > first[t or ""]) << 4, i in good, i in toxic) for i, t, s in docs]
    removed, out = Counter(), {}
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                lost = [m for m in left if m[1] >> f & 1]
                left = [m for m in left if not m[1] >> f & 1]
                failing = sum(m[1] >> f & 1 for m in own)
                removed[part, f] += len(lost)
                key = (part, "".join("ABCDE"[i] for i in order), step)
                out[key] = [f, len(left), len(lost), failing - len(lost), sum(m[1] == 1 << f for m in own), sum(m[2] for m in lost), sum(m[3] for m in lost)]
    return {k: (*v[1:], removed[k[0], v[0]]) for k, v in out.items()}


def test_audit_equals_counting(spark, rows):
    docs, labels = rows
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, mask string, good int")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit_orders(audit.document_cells(table.repartition(4), known), "ABCDE").collect()
    assert len(got) == len({(d[2] or "") for d in docs}) * 600
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(docs, labels)


def test_empty_tables_and_too_many_filters(spark, rows):
    docs, labels = rows
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert audit.audit_orders(audit.document_cells(table.limit(0), known), "ABCDE").collect() == []
    cells = audit.document_cells(table, known.limit(0))
    assert all(r.good == 0 and r.toxic == 0 for r in cells.collect())
    with pytest.raises(ValueError):
        audit.audit_orders(cells, "ABCDEFGHI")
