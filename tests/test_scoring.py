import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import literature as L
from folioscan.functions import scoring as S
from folioscan.operators import evaluation as V
from tests.conftest import rows

c = F.col


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return df.select(expr.alias("x")).first()[0]


def test_minmax(spark):
    df = spark.createDataFrame([("p", 2.0), ("p", 2.0), ("q", 0.0), ("q", 4.0), ("q", 1.0)], "g string, v double")
    got = rows(df.select("g", S.minmax(c("v"), "g")))
    assert got == [("p", 1.0), ("p", 1.0), ("q", 0.0), ("q", 0.25), ("q", 1.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_minmax_bounds(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    assert all(0 <= r[0] <= 1 for r in df.select(S.minmax(c("v"), "g")).collect())


@pytest.mark.parametrize(
    ("query", "label"),
    [("history of the world", "medium"), ("weather tomorrow", "low"), ("flat morphism", "high"), ("special next", "high"), ("movie recipe scheme flat", "low")],
)
def test_relevance(spark, query, label):
    assert one(spark, S.relevance(c("q")), q=query)["label"] == label


def test_confidence(spark):
    df = spark.createDataFrame([("stacks_only_degraded", 3, 0, 3)], "r string, l int, p int, n int")
    score = df.select(S.source_confidence(c("r"), c("l"), c("p"), F.lit(False), F.lit(None).cast("double"), c("n"), F.array(F.lit("no_matches"))).alias("x")).first()[0]
    assert score == 0.485
    assert spark.range(1).select(S.quality_band(F.lit(score))).first()[0] == "medium"


@pytest.mark.parametrize(("l", "p", "want"), [(3, 2, "ag_retrieval"), (3, 0, "stacks_only_degraded"), (0, 2, "papers_only_degraded"), (0, 0, "retrieval_unavailable")])
def test_route(spark, l, p, want):
    assert spark.range(1).select(S.route(F.lit("high"), F.lit(l), F.lit(p))).first()[0] == want


@pytest.mark.parametrize(
    ("code", "message", "want"),
    [("TLS_ERROR", "", "tls_restricted"), ("HTTP_429", "", "timeout"), ("HTTP_404", "", "error"), ("PARSE_ERROR", "", "parse_error"), ("", "Timed out", "timeout"), ("NO_MATCHES", "", "no_matches"), (None, None, "error")],
)
def test_degrade(spark, code, message, want):
    assert one(spark, S.degrade_reason(c("a"), c("b")), a=code, b=message) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [('"2020-01-01T00"', "2020"), ('{"date-parts": [[2019, 1]]}', "2019"), ('"n/a"', ""), ("2018", "2018"), ('{"date-parts": [["2017-02"]]}', "2017"), ("x{", ""), (None, "")],
)
def test_year(spark, value, want):
    assert (one(spark, L.year_of_json(c("a")), a=value) or "") == want


def test_canonical_key(spark):
    key = L.canonical_key(c("d"), c("a"), c("u"), c("t"))
    assert one(spark, key, d=None, a="", u="https://arxiv.org/abs/2101.00001v2", t="T") == "arxiv:2101.00001v2"
    assert one(spark, key, d="10.1/X", a="", u="", t="T") == "doi:10.1/x"
    assert one(spark, key, d="", a="", u="u", t="A  b!") == "title:a b"
    assert one(spark, key, d="", a="", u="U", t="!") == "url:u"
    assert one(spark, key, d="", a="", u="", t=None) == ""


def test_inverted_abstract(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({"x": [6000]},), (None,)], "m map<string, array<int>>")
    assert [r[0] for r in df.select(L.abstract_of_index(c("m"))).collect()] == ["a b a", "", ""]


def test_item_scores(spark):
    df = spark.createDataFrame([("arxiv", 2, "2024"), ("x", 1, "1800"), ("wikipedia", 1, "")], "s string, r int, y string")
    got = [(round(a, 6), b) for a, b in df.select(L.source_rank_score(c("s"), c("r")), L.recency(c("y"), 2025)).collect()]
    assert got == [(round(1 / 1.12, 6), 1.0), (0.5, 0.0), (0.58, 0.0)]


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, id string, rank int")
    wanted = spark.createDataFrame([("q", "b"), ("q", "z"), ("n", "a")], "qid string, id string")
    got = {r.qid: r for r in V.query_metrics(ranking, wanted, [2, 1]).collect()}
    assert (got["q"]["recall@2"], got["q"]["mrr@2"], got["q"]["mrr@1"]) == (0.5, 0.5, 0.0)
    assert got["n"]["recall@2"] == 0.0
    with pytest.raises(ValueError):
        V.query_metrics(ranking, wanted, [])
    whole = V.aggregate_metrics(V.query_metrics(ranking, wanted, [2]).withColumn("cat", F.lit("")), "cat")
    assert {r.category for r in whole.collect()} == {"(all)", "uncategorized"}
