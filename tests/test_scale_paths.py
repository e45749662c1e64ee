"""The paths for large or skewed inputs give the same results as plain computation."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import joins, ranking, sampling, tfidf
from sparktext.operators.evaluate import auc
from sparktext.operators.profile import box_plot, describe


@pytest.fixture(scope="module")
def skewed(spark):
    """2000 rows; one group holds two thirds, ids have gaps and clusters."""
    rng = random.Random(7)
    ids = rng.sample(range(100), 60) + rng.sample(range(10_000, 10_000_000), 1940)
    rows = [(i, "hot" if rng.random() < 0.67 else f"g{rng.randrange(20)}", rng.randrange(50)) for i in ids]
    return spark.createDataFrame(rows, "doc_id bigint, label string, x int").repartition(5), rows


@pytest.fixture
def large(monkeypatch):
    """Treat every table as too large for one task and for broadcasting."""
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 1)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1)


def by_group(rows):
    groups = defaultdict(list)
    for i, g, x in rows:
        groups[g].append((i, x))
    return {g: sorted(v) for g, v in groups.items()}


def test_ranked(skewed):
    df, rows = skewed
    out = ranking.ranked(df, "doc_id", ["label"], running={"upto": "x"}, totals={"all": "x"})
    got = {r["doc_id"]: (r["row_number"], r["upto"], r["all"]) for r in out.collect()}
    for members in by_group(rows).values():
        total, upto = sum(x for _, x in members), 0
        for n, (i, x) in enumerate(members, 1):
            upto += x
            assert got[i] == (n, upto, total)


def test_ranked_descending_without_groups(skewed):
    df, rows = skewed
    got = {r["doc_id"]: r["row_number"] for r in ranking.ranked(df, "doc_id", descending=True).collect()}
    assert got == {i: n for n, i in enumerate(sorted((r[0] for r in rows), reverse=True), 1)}


def test_ranked_orders_structs_and_nulls(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("c",)], "k string")
    assert {r["k"]: r["row_number"] for r in ranking.ranked(df, "k").collect()} == {None: 1, "a": 2, "b": 3, "c": 4}


def test_ranges_stay_even(spark, skewed):
    df, _ = skewed
    cuts = ranking._cut_points(df, "doc_id", 8)
    sizes = df.crossJoin(cuts).groupBy(ranking._range_of(F.col("doc_id"), F.col("_cuts")).alias("r")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 500


def test_percentiles(skewed, large):
    df, rows = skewed
    got = {(r["label"], r["p"]): r["value"] for r in ranking.exact_percentiles(df, "x", [0.05, 0.5, 0.95], ["label"]).collect()}
    for g, members in by_group(rows).items():
        for p in (0.05, 0.5, 0.95):
            assert got[(g, p)] == pytest.approx(np.percentile([x for _, x in members], 100 * p))


def test_describe_and_box_plot(skewed):
    df, rows = skewed
    hot = np.array([x for _, g, x in rows if g == "hot"])
    d = describe(df, "x", ["label"]).where("label = 'hot'").first()
    assert d["n"] == len(hot) and d["std"] == pytest.approx(hot.std(ddof=1)) and d["q25"] == np.percentile(hot, 25)
    b = box_plot(df, "x", ["label"]).where("label = 'hot'").first()
    assert (b["whisker_low"], b["whisker_high"], b["outliers"]) == (hot.min(), hot.max(), 0)


def test_carry_forward(spark):
    rows = [(i, i if i % 37 == 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(4)
    got = {r["k"]: r["c"] for r in ranking.carry_forward(df, "k", "v", "c").collect()}
    last = None
    for k, v in rows:
        last = v if v is not None else last
        assert got[k] == last


def test_salted_join_matches_plain_join(skewed):
    df, rows = skewed
    table = df.groupBy("label").agg(F.sum("x").alias("total")).where("label <> 'g3'")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, df.join(table, ["label"], how).select("doc_id", "total").collect()))
        salted = joins.salted_join(df, table, ["label"], how, "doc_id", hot_parts=10)
        assert sorted(map(tuple, salted.select("doc_id", "total").collect())) == plain


def test_salted_join_spreads_the_hot_key(skewed):
    df, _ = skewed
    table = df.groupBy("label").agg(F.sum("x").alias("total"))
    out = joins.salted_join(df, table, ["label"], spread_on="doc_id", hot_parts=20)
    plan = out._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_lookup_switches_on_size(skewed, large):
    df, _ = skewed
    table = df.groupBy("label").agg(F.count("*").alias("n"))
    assert joins.lookup(df, table, ["label"], spread_on="doc_id").count() == df.count()


def test_tfidf_is_the_same_on_large_paths(spark, tiny, large):
    got = {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in tfidf.fit_tfidf(tiny).transform(tiny).collect()}
    assert got[(3, "fish")] == 0.795961 and got[(1, "cat")] == 0.707107


def test_auc_is_the_same_on_large_paths(spark, large):
    rows = [(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.65, 0.35]), (1, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "label int, scores array<double>")
    assert {r["class"]: r["auc"] for r in auc(df, 2).collect()} == {0: 0.75, 1: 0.75}


def hash_order(rows, seed=42):
    import hashlib

    return sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))


@pytest.mark.parametrize("digits", [1, 5])
def test_hash_split_is_exact(skewed, monkeypatch, digits):
    monkeypatch.setattr(ranking, "HASH_DIGITS", digits)
    df, rows = skewed
    assert {r["doc_id"] for r in sampling.sample_n(df, 123).collect()} == {r[0] for r in hash_order(rows)[:123]}
    got = {r["doc_id"]: r["split"] for r in sampling.train_test_split(df, 0.2).collect()}
    assert len(got) == len(rows)
    assert {i for i, s in got.items() if s == "test"} == {r[0] for r in hash_order(rows)[:400]}


def test_samples_per_class(skewed, large):
    df, rows = skewed
    groups = defaultdict(list)
    for r in hash_order(rows):
        groups[r[1]].append(r[0])
    got = {r["doc_id"] for r in sampling.balanced_sample(df, 40).collect()}
    assert got == {i for g in groups.values() for i in g[:40]}
    least = min(len(g) for g in groups.values())
    got = {r["doc_id"] for r in sampling.balance_to_smallest(df, 1000).collect()}
    assert got == {i for g in groups.values() for i in g[:least]}
    assert sampling.sample_n(df, 10**9).count() == len(rows)
    assert sampling.sample_n(df, 0).count() == 0


def test_folds_and_chunks(skewed):
    df, rows = skewed
    folds = {r["doc_id"]: r["fold"] for r in sampling.stratified_folds(df, 5).collect()}
    for members in by_group(rows).values():
        assert [folds[i] for i, _ in members] == [n % 5 for n in range(len(members))]
    chunks = {r["doc_id"]: r["chunk_id"] for r in sampling.row_chunks(df, 300).collect()}
    assert [chunks[i] for i in sorted(chunks)] == [n // 300 for n in range(len(rows))]


def test_first_n_per_class(skewed):
    df, rows = skewed
    got = {r["doc_id"] for r in sampling.first_n_per_class(df, 30).collect()}
    assert got == {i for members in by_group(rows).values() for i, _ in members[:30]}


def test_positions(skewed):
    df, rows = skewed
    got = {r["doc_id"]: (r["line_number"], r["total_lines"]) for r in sampling.with_positions(df, "label", "doc_id").collect()}
    for members in by_group(rows).values():
        assert [got[i] for i, _ in members] == [(n, len(members) - 1) for n in range(len(members))]


def test_partition_count_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    results = []
    for parts in (1, 8):
        df = docs.repartition(parts, "doc_id")
        rows = tfidf.fit_tfidf(df, tfidf.TermOptions(max_features=200)).transform(df)
        results.append(sorted((r["doc_id"], r["term"], round(r["weight"], 9)) for r in rows.collect()))
    assert results[0] == results[1]


def test_encode_needs_no_wide_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = tfidf.fit_tfidf(docs, tfidf.TermOptions(max_features=200))
    plan = model.transform(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_word_count_reads_one_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.where("lang = 'en'").select(text.word_count("text"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<text:string,lang:string>" in plan
