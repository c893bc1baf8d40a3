"""Needles that are no whole words of a text, and begin alike."""

from tessera.operators.retrieval import _candidates, containing


def test_needles_with_the_same_first_letters_meet_few_texts(spark):
    hay = spark.range(2000).selectExpr("id", "concat('s/src/doc_', id, '.ts') AS a")
    needles = spark.range(2000).selectExpr("id AS j", "concat('doc_', id, '.') AS b")
    assert _candidates(hay, needles, "a", "b").count() == 2000
    assert containing(hay, needles, "a", "b").filter("id = j").count() == 2000


def test_needles_by_the_ends_of_words_and_within_them(spark):
    texts = ["xfoo.bar", "foo.barx", "a foo", "foo", "..", "a.. b", "barfoob", "é.foo-", None, ""]
    needles = ["foo.", ".bar", "foo.bar", "oo", "..", "rfo", "foo", ".", "é.", "-", "o.b", " ", None, ""]
    left = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    right = spark.createDataFrame(list(enumerate(needles)), "j int, b string")
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if x and y and y in x}
    got = [(r.i, r.j) for r in containing(left, right, "a", "b").collect()]
    assert set(got) == want and len(got) == len(want)
