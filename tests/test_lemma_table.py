"""The distinct-word route of a user's lemma table keeps order, repeats and blanks."""

from sparktext.operators.cleaning import CleanOptions, clean_text


def test_lemma_table_on_texts(spark):
    docs = spark.createDataFrame([(1, "mice cities mice"), (2, ""), (3, None)], "doc_id bigint, text string")
    table = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    got = {r["doc_id"]: r["text"] for r in clean_text(docs, options=CleanOptions(lemma=True), lemmas=table).collect()}
    assert got == {1: "mouse city mouse", 2: "", 3: None}
