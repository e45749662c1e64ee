"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparktext.functions import arrays, html, text
from sparktext.functions.words import porter_stem
from sparktext.operators import bayes, catfreq, evaluate, tfidf, vectors, wordvec
from sparktext.operators.cleaning import CleanOptions, clean_text, drop_empty, drop_null_columns, lemmatize
from sparktext.operators.joins import common_column_join, common_rows, require_columns
from sparktext.operators.labels import encode_labels, label_codes, recode


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in cols.items()))
    return df.select(column.alias("v")).first()["v"]


def weights(df):
    return {(r["doc_id"], r["term"]): round(r["weight"], 6) for r in df.collect()}


def test_cleaning_order(spark):
    df = spark.createDataFrame([(1, "The <b>CAT</b> sat, 42 times!"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in clean_text(df).collect()}
    assert got == {1: "bcatb sat times", 2: None}


def test_tags_go_when_punctuation_stays(spark):
    df = spark.createDataFrame([(1, "a <b>bold</b> word")], "doc_id bigint, text string")
    options = CleanOptions(True, False, False, False, False, True)
    assert clean_text(df, options=options).first()["text"] == "a bold word"


def test_clean_options_alias_and_unknown():
    assert CleanOptions.from_config({"lemmatize": True}).lemma
    with pytest.raises(ValueError):
        CleanOptions.from_config({"lowercase": True})


def test_drop_empty(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "x")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in drop_empty(df).collect()] == [4]


def test_drop_null_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b string, c string")
    assert drop_null_columns(df).columns == ["a", "c"]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"),
        ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("triplicate", "triplic"),
        ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("adjustable", "adjust"),
        ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"),
        ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"),
    ],
)
def test_porter_stem(word, stem):
    assert porter_stem(word) == stem


def test_stemmed_text_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(1, "running cats running"), (2, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in clean_text(df, options=CleanOptions(stem=True)).collect()}
    assert got == {1: "run cat run", 2: ""}


def test_lemma_table_wins_over_suffix_rules(spark):
    words = spark.createDataFrame([("mice",), ("cities",), ("glass",)], "word string")
    table = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    got = {r["word"]: r["mapped"] for r in lemmatize(words, table).collect()}
    assert got == {"mice": "mouse", "cities": "city", "glass": "glass"}


def test_article_numbers(spark):
    t = "Violation of Art. 6-1; no violation of article 8; Article 8"
    assert value(spark, text.article_numbers("t"), t=t) == ["6-1", "8"]


@pytest.mark.parametrize("n, sizes", [(1, [1]), (512, [512]), (513, [500, 13]), (1000, [500, 500])])
def test_pieces(spark, n, sizes):
    got = value(spark, text.pieces("t"), t=" ".join(["w"] * n))
    assert [len(p.split()) for p in got] == sizes


def test_ngrams_and_counts(spark):
    got = value(spark, text.term_counts(text.ngrams(text.words("t"), 1, 2)), t="a b a b")
    assert {(r["term"], r["tf"]) for r in got} == {("a", 2), ("b", 2), ("a b", 2), ("b a", 1)}
    assert value(spark, text.term_counts(text.words("t")), t="") == []


def test_scalar_members(spark):
    got = value(spark, text.scalar_members("t"), t='{"a": 1, "b": [1], "c": {"d": 2}, "e": "x"}')
    assert got == {"a": "1", "e": "x"}


def test_visible_text(spark):
    page = "<p>A &amp;lt; B&nbsp;&#233;&#x4E2D;</p><!-- x --><script>var a='<p>';</script>&unknown;"
    assert value(spark, html.visible_text("t"), t=page) == "A &lt; B\u00a0é中&unknown;"
    assert value(spark, html.visible_text("t"), t="&frac12; &hearts; &CounterClockwiseContourIntegral;") == "½ ♥ ∳"


def test_tfidf(tiny):
    model = tfidf.fit_tfidf(tiny)
    idf = {r["term"]: (r["term_id"], round(r["idf"], 6)) for r in model.vocabulary.collect()}
    assert idf == {"cat": (0, 1.287682), "dog": (1, 1.287682), "fish": (2, 1.693147)}
    assert weights(model.transform(tiny)) == {
        (1, "cat"): 0.707107, (1, "dog"): 0.707107, (2, "cat"): 1.0, (3, "dog"): 0.605349, (3, "fish"): 0.795961,
    }


def test_unknown_documents_give_empty_rows(spark, tiny):
    new = spark.createDataFrame([(9, "zebra"), (10, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["terms"] for r in tfidf.fit_tfidf(tiny).encode(new).collect()} == {9: [], 10: []}


def test_document_frequency_bounds(tiny):
    kept = tfidf.fit_tfidf(tiny, tfidf.TermOptions(min_df=2)).vocabulary
    assert {r["term"] for r in kept.collect()} == {"cat", "dog"}
    rare = tfidf.fit_tfidf(tiny, tfidf.TermOptions(max_df=0.5)).vocabulary
    assert {r["term"] for r in rare.collect()} == {"fish"}
    top = tfidf.fit_tfidf(tiny, tfidf.TermOptions(max_features=2)).vocabulary
    assert {r["term"] for r in top.collect()} == {"cat", "dog"}


def test_category_model(spark, tiny):
    model = catfreq.fit_category_model(tiny, tfidf.TermOptions())
    assert {(r["label"], r["term"]): r["cf"] for r in model.cf.collect()} == {
        (0, "cat"): 1.0, (0, "dog"): 0.5, (1, "dog"): 1.0, (1, "fish"): 1.0,
    }
    assert weights(model.encode_with_labels(tiny)) == {
        (1, "cat"): 0.894427, (1, "dog"): 0.447214, (2, "cat"): 1.0, (3, "dog"): 0.605349, (3, "fish"): 0.795961,
    }
    rows = model.tfidf.transform(tiny)
    p = spark.createDataFrame([(i, {0: 0.8, 1: 0.2}) for i in (1, 2, 3)], "doc_id bigint, probabilities map<int,double>")
    got = weights(catfreq.weight_probabilistic(rows, p, model.cf))
    assert got[(1, "dog")] == pytest.approx(0.707107 * 0.6, abs=1e-6)
    assert got[(1, "cat")] == 0.707107
    assert weights(catfreq.weight_max(rows, model.cf)) == weights(rows)
    hard = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, prediction int")
    got = weights(catfreq.weight_hard(rows, hard, model.cf))
    assert got[(1, "cat")] == 0.707107 and got[(3, "fish")] == 0.795961
    assert got[(3, "dog")] == pytest.approx(0.605349 * 0.5, abs=1e-6)


def test_unseen_pair_weight(spark, tiny):
    model = catfreq.fit_category_model(tiny, tfidf.TermOptions())
    new = spark.createDataFrame([(7, "cat fish", 1)], "doc_id bigint, text string, label int")
    got = weights(model.encode_with_labels(new))
    assert got[(7, "fish")] == 1.0 and 0 < got[(7, "cat")] < 1e-5


def test_inverse_category_frequency(tiny):
    counts = tfidf.doc_terms(tiny, tfidf.TermOptions(), keep=["label"])
    got = {r["term"]: round(r["icf"], 6) for r in catfreq.inverse_category_frequency(counts).collect()}
    assert got == {"cat": 0.405465, "dog": 0.0, "fish": 0.405465}


def test_consensus(spark):
    names = "predicted_class_hard int, predicted_class_prob int, predicted_class_maxcf int, confidence_hard double, confidence_prob double, confidence_maxcf double"
    df = spark.createDataFrame([(2, 2, 2, 0.9, 0.6, 0.6), (2, 1, 2, 0.5, 0.5, 0.5)], names)
    a, b = catfreq.consensus(df).collect()
    assert (a["consensus"], a["high_confidence"], round(a["avg_confidence"], 6)) == (2, True, 0.7)
    assert (b["consensus"], b["high_confidence"]) == (None, False)


def test_quantisation(spark):
    v = [0.5, -1.0, 0.25]
    scale = F.lit(1 / 127)
    assert value(spark, arrays.binary_quantize("v"), v=v) == [1, 0, 1]
    assert value(spark, arrays.int8_quantize("v", scale), v=v) == [63, -127, 31]
    back = value(spark, arrays.int8_dequantize(arrays.int8_quantize("v", scale), scale), v=v)
    assert [round(x, 6) for x in back] == [0.496063, -1.0, 0.244094]
    assert value(spark, arrays.int8_quantize("v", F.lit(1 / 1270)), v=v) == [127, -127, 127]


def test_vector_functions(spark):
    assert value(spark, arrays.binary_cosine_distance("a", "b"), a=[1.0, 1.0, 0.0], b=[1.0, 0.0, 1.0]) == pytest.approx(0.5)
    assert value(spark, arrays.l2_normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert value(spark, arrays.l2_normalize("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert value(spark, arrays.arg_max("a"), a=[0.1, 0.7, 0.7]) == 1


def test_one_hot(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "c int")
    assert [r[0] for r in df.select(arrays.one_hot("c", 3)).collect()] == [[0, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_report(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1)]
    pairs = spark.createDataFrame(rows, "doc_id bigint, label int, prediction int")
    got = {r["class"]: [round(r[c], 6) for c in ("precision", "recall", "f1", "support")] for r in evaluate.classification_report(pairs).collect()}
    assert got["0"] == [1.0, 0.5, 0.666667, 2]
    assert got["1"] == [0.666667, 1.0, 0.8, 2]
    assert got["macro avg"][2] == got["weighted avg"][2] == 0.733333
    assert got["accuracy"][2] == 0.75
    cells = {(r["label"], r["prediction"]): r["n"] for r in evaluate.confusion_matrix(pairs, [0, 1]).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_auc(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.65, 0.35]), (1, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "label int, scores array<double>")
    assert {r["class"]: r["auc"] for r in evaluate.auc(df, 2).collect()} == {0: 0.75, 1: 0.75}
    last = evaluate.roc_points(df, 2).where("class = 1").orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_label_encoding(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "doc_id bigint, label_text string")
    assert {r["doc_id"]: r["label"] for r in encode_labels(df).collect()} == {1: 1, 2: 0, 3: -1, 4: 1}
    saved = label_codes(df.where("doc_id = 2"))
    assert {r["doc_id"]: r["label"] for r in encode_labels(df, codes=saved).collect()} == {1: -1, 2: 0, 3: -1, 4: -1}
    assert [r[0] for r in df.orderBy("doc_id").select(recode("label_text", {"a": 5})).collect()] == [None, 5, None, None]


def test_common_rows(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", 3)], "t string, n int")
    b = spark.createDataFrame([("x", 1), (None, 2), ("y", 4)], "t string, n int")
    assert common_column_join(a, b).count() == 3
    assert common_column_join(a, b, null_safe=False).count() == 2
    assert {(r["t"], r["left_rows"], r["right_rows"]) for r in common_rows(a, b).collect()} == {("x", 2, 1), (None, 1, 1)}


def test_require_columns(spark):
    with pytest.raises(ValueError, match="text"):
        require_columns(spark.range(1), "text")


def test_document_vectors(spark):
    vecs = spark.createDataFrame([("cat", [3.0, 4.0]), ("dog", [0.0, 2.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "bird")], "doc_id bigint, text string")
    got = {r["doc_id"]: ([round(x, 6) for x in r["vector"]], r["is_error"]) for r in wordvec.document_vectors(docs, vecs, 2).collect()}
    assert got == {1: ([0.4, 0.866667], False), 2: ([0.0, 0.0], True)}


def test_unknown_word_vector(spark):
    known = spark.createDataFrame([("cats", [1.0, 0.0]), ("cars", [0.0, 1.0])], "word string, vector array<double>")
    unknown = spark.createDataFrame([("cat",), ("zzzz",)], "word string")
    got = {r["word"]: r["vector"] for r in wordvec.unknown_word_vectors(unknown, wordvec.gram_vectors(known, 2, 3, 4), 2, 3, 4).collect()}
    # "cat" and "<cat" come from cats alone, "<ca" from both words; the other n-grams are unknown.
    assert set(got) == {"cat"} and got["cat"] == pytest.approx([5 / 6, 1 / 6])


def test_encoder_pieces_and_empty_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, " ".join(["a"] * 1000))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["embedding"] for r in vectors.encode_texts(docs, lambda: vectors.hashing_encoder(8), 8).collect()}
    assert got[2] == [0.0] * 8 and any(got[1])
    assert sorted(abs(x) for x in got[3])[-1] == 500.0


def test_bayes_prefers_the_class_of_its_terms(tiny):
    rows = tfidf.fit_tfidf(tiny).transform(tiny, keep=["label"])
    got = {r["doc_id"]: r["prediction"] for r in bayes.fit_bayes(tiny, rows, [0, 1]).predict(tiny, rows).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_padded_sequences(spark):
    docs = spark.createDataFrame([(1, "the cat the"), (2, "the"), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["sequence"] for r in tfidf.padded_sequences(docs, 4, 100).collect()}
    assert got == {1: [2, 3, 2, 0], 2: [2, 0, 0, 0], 3: [0, 0, 0, 0]}
    capped = {r["doc_id"]: r["sequence"] for r in tfidf.padded_sequences(docs, 2, 3).collect()}
    assert capped == {1: [2, 1], 2: [2, 0], 3: [0, 0]}
