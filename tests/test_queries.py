"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscan.operators.vector import densify, hash_vectors, vector_top_k
from folioscan.queries import reference
from folioscan.queries.reference import current_corpus
from tests.conftest import rows
from verify import canonical

SQL = entry.oracle_sql()
CORE = sorted(n for n in SQL if not entry.queries()[n].__module__.startswith("folioscan.llm"))


@pytest.fixture(scope="module")
def con(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, tiny, con, name):
    got, want = entry.queries()[name](spark, tiny).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(entry.queries())


def test_evaluation_asks_every_titled_tag(spark, tiny):
    titled = current_corpus(spark, tiny).filter("title <> ''")
    got = {r.category: r.query_count for r in entry.queries()["hybrid_evaluation"](spark, tiny).collect()}
    assert got.pop("(all)") == titled.count() > titled.select("chapter_key").distinct().count()
    assert sum(got.values()) == titled.count()


def test_hash_embeddings_have_the_default_dimension(spark, tiny):
    """The reference's build and the operators' own defaults use 1536."""
    vectors = reference._stored(spark, tiny, "hash").vectors
    assert {r.n for r in vectors.select(F.size("embedding").alias("n")).distinct().collect()} == {1536}
    made = hash_vectors(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", F.col("text"))
    dense = made.select("doc_id", densify(F.col("indices"), F.col("values"), 1536).alias("embedding"))
    want = vector_top_k(dense, dense.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "embedding"), 5, "doc_id")
    assert rows(entry.queries()["hash_embedding_topk"](spark, tiny)) == rows(want)
