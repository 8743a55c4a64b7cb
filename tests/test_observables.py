"""match_observables has one meaning for any number of terms: the term stands anywhere in the text."""

from auditloom.operators import identity as I


def test_terms_match_as_substrings_whatever_their_number(spark):
    texts = [(1, "The straße runs; x-ray/y z"), (2, "Übermensch WORD0007word"), (2, "Übermensch WORD0007word"), (None, "a word0007word 😀b"), (4, ""), (5, None), (6, "ab"), (7, "q")]
    terms = [f"word{i:04d}" for i in range(2500)] + ["ord0007wo", "ße", "x-ray/y", "y z", "q", " AB ", "überm", "😀b", "7w", "", None, "runs;", "ab"]
    for few in (terms[-13:], terms):
        got = sorted(map(tuple, I.match_observables(spark.createDataFrame(texts, "event_id long, text string"), spark.createDataFrame([(x,) for x in few], "term string")).collect()), key=str)
        plain = {x.strip(" ").lower() for x in few if x and x.strip(" ")}
        assert got == sorted(((i, x) for i, t in texts if t is not None for x in plain if x in t.lower()), key=str)
    assert I.match_observables(spark.createDataFrame(texts, "event_id long, text string"), spark.createDataFrame([], "term string")).count() == 0


def test_few_terms_are_sought_where_the_texts_lie(spark):
    texts = spark.createDataFrame([(1, "A wget b"), (1, "A wget b"), (2, None), (3, "curl")], "event_id long, text string")
    terms = spark.createDataFrame([(x,) for x in ("Wget", "get ", "curl", None)], "term string")
    out = I.match_observables(texts, terms)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, I.match_observables(texts, terms, few=0).collect())) == [(1, "get"), (1, "get"), (1, "wget"), (1, "wget"), (3, "curl")]
