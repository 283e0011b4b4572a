"""What must not grow with the tables: plans, and columns that nobody asked for."""

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F

from loamgrid.operators import models, ranking
from loamgrid.plans.queries import ORACLE_SQL, QUERIES


def test_kd_plan_does_not_grow_with_the_leaves(spark, tmp_path):
    """Four times the customers give four times the leaves, the same plan, and the leaves of the SQL."""
    sizes = []
    for n in (6_000, 24_000):
        folder = tmp_path / str(n)
        spark.range(1, n + 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{folder}/customer.parquet")
        found = QUERIES["kd_cells"](spark, str(folder))
        sizes.append(len(found._jdf.queryExecution().toString()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
        assert difference(found, con, ORACLE_SQL["kd_cells"]) == ""
    assert sizes[1] < 1.5 * sizes[0]


def test_scores_need_only_the_grams_of_the_documents(spark):
    """Global probabilities of the test documents' words give all cells the scores that those of all words give."""
    train = spark.createDataFrame([("c0", "a", 3.0), ("c0", "b", 1.0), ("c1", "b", 2.0), ("c1", "d", 2.0), ("c2", "e", 5.0)], "cell string, gram string, cnt double")
    cells = spark.createDataFrame([("c0", 1, 1.0), ("c1", 1, 1.0), ("c2", 1, 1.0)], "cell string, n_docs long, salience double")
    tests = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "z", 1.0)], "doc long, gram string, cnt double")
    stats = models.global_counts(train).withColumn("g", F.col("cnt") / 13)
    names = ["naive-bayes", "full-cosine-similarity", "average-cell-probability"]
    got = [
        {r.cell: tuple(r)[2:] for r in ranking.scores(tests, train, cells, s, models.Smoothing("dirichlet", 10.0), names).collect()}
        for s in (stats, stats.filter("gram in ('a', 'b')"))
    ]
    assert set(got[0]) == set(got[1]) == {"c0", "c1", "c2"}
    for cell, row in got[0].items():
        assert got[1][cell] == pytest.approx(row)


def odd_documents(spark, tmp_path, missing):
    """A folder whose documents have repeated and perhaps missing ids, no words, and one long text."""
    texts = [(1, "a", "b a b"), (1, "b", "b c"), (2, "a", "  "), (3, "a", None), (None, "b", "x x"), (None, "b", "x y"), (4, "b", "d " * 300 + "a"), (5, "a", "Ünï c C")]
    df = spark.createDataFrame([t for t in texts if missing or t[0]], "doc_id long, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["count_strings", "tfidf_norms", "topic_model_lines", "word_counts"])
@pytest.mark.parametrize("most", [0, 2])
def test_words_of_odd_documents(spark, tmp_path, monkeypatch, name, most):
    """Rows counted alone and together, grams joined by broadcast and by shuffle: the rows of the SQL.

    Places of a topic model are numbered with nulls first, in the SQL with nulls last, so there ids are not missing.
    """
    folder, con = odd_documents(spark, tmp_path, name != "topic_model_lines")
    monkeypatch.setattr(models, "LONG_TEXT", 100)
    monkeypatch.setattr(models, "FREQUENT", most)
    assert difference(QUERIES[name](spark, folder), con, ORACLE_SQL[name]) == ""


def test_words_of_a_document_are_not_shuffled(spark, sf_dir):
    """Tokens of documents are counted in their rows: what is left of the plan has no exchange."""
    assert "Exchange" not in QUERIES["count_strings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
