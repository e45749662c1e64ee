"""Stages on odd rows and the registered queries on the given tables."""

import random

import duckdb
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from sparktext.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage, base = prose(70), prose(200)
    rows = [(i, prose(rng.randint(20, 120)), "en", "s", 0) for i in range(120)]
    rows += [(200 + i, prose(60).upper().replace(" ", "!! "), None, "s", 0) for i in range(60)]
    rows += [(300 + i, f"{prose(80)} {passage} {prose(80)}", "en", None, 0) for i in range(10)]
    rows += [(400 + i, base + (f" extra{i}" if i else ""), "de", "s", 0) for i in range(5)]
    rows += [(500, rows[0][1], "en", "s", 0), (501, "", "en", "s", 0), (502, None, "en", "s", 0), (None, prose(50), "en", "s", None), (7, rows[7][1], "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    rows = [(i, t, lang, s, n if n is None else len(t or "")) for i, t, lang, s, n in rows]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, windows string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 200 <= i < 260), 0) for i, *_ in rows if i is not None and i < 300]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, passage


def test_stages(spark, folder, tmp_path):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    kept = [{r.doc_id for r in s} for s in seen]
    assert not kept[0] & set(range(200, 260)) and kept[0] >= set(range(120)) | set(range(300, 310)) | set(range(400, 405)) | {None, 500}
    assert kept[1] == kept[0] - {0, 501} if 502 in kept[0] else kept[1] == kept[0] - {0}
    assert len(seen[1]) == len(kept[1])
    assert kept[2] == kept[1] - {401, 402, 403, 404}
    assert kept[3] == kept[2] and len(seen[3]) == len(seen[2])
    before, after = ({r.doc_id: r for r in s} for s in seen[2:4])
    for i, r in after.items():
        if i in range(300, 310):
            assert passage not in r.text and r.n_chars == len(r.text) < before[i].n_chars
        else:
            assert r.text == before[i].text and r.n_chars == before[i].n_chars
    assert len(seen[4]) == len(seen[3]) and {r.doc_id for r in seen[4]} == kept[3]


def test_stages_on_an_empty_table(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_passages_are_measured_in_words(spark):
    rng = random.Random(3)
    short = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(2)) for _ in range(n))
    long = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(12)) for _ in range(n))
    passage, below = short(51), long(50)
    texts = [f"{long(20)} {passage} {long(20)}" for _ in range(3)] + [f"{long(20)} {below} {long(20)}" for _ in range(2)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, SF).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == t.replace(passage, "") and got[i].n_chars == len(got[i].text)


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.partition("_")[0] for n in names} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want)


def test_batches_hold_encoded_tokens(spark, tmp_path):
    known = bpe.Vocabulary(str(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdef0123456789") for _ in range(40_000)) for _ in range(6)] + ["two words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op7(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        rows = out.collect()
        assert {r.doc_id: r.n_tokens for r in rows} == {i: len(known.encode(t or "").split()) + 1 for i, t in enumerate(texts)}
        batches = {}
        for r in rows:
            batches.setdefault((r.bucket, r.batch), []).append(r.bucket_length)
        assert all(sum(b) <= 65_536 for b in batches.values())
