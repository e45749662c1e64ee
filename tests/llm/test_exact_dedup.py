"""Groups of equal texts against a dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest

from sparktext.llm import exact_dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups(spark, keep):
    rng = random.Random(1)
    texts = [rng.choice(["hot", "hot", f"t{rng.randint(0, 60)}", "T1", "t1 ", "é", "", None]) for _ in range(300)]
    ids = rng.sample(range(1000), 300)
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, run string, n int")
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    want = {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "c"), (None, "c")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == [(-1, -1, 1, True), (-1, -1, 2, True), (-1, -1, 2, True), (-1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError, match="keep"):
        exact_dedup.exact_duplicates(docs, keep="any")


def test_only_spark_operations_run(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))
