"""Large tables are dealt to tasks whose rows do not grow with the tables; the rows stay the same."""

from pyspark.sql import functions as F

from tidemark.operators import graph, mining
from tidemark.sources import io

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_edges_are_dealt_by_their_rows(spark, monkeypatch):
    plain = sorted(map(tuple, graph.degrees(io.edges(spark, SF)).collect()))
    monkeypatch.setattr(io, "TASK_ROWS", 100)
    edges = io.edges(spark, SF)
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert f", {parts})" in _plan(edges)
    many = graph.degrees(edges)
    # the edges are made once, not once for each end
    assert _plan(many).count("Join") == 1
    assert sorted(map(tuple, many.collect())) == plain


def test_dealt_graph_queries_keep_their_rows(spark, monkeypatch):
    import __spark_entry__

    run = lambda name: sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).collect()))
    names = ("gr6_spider", "gr10_sync")
    plain = [run(n) for n in names]
    monkeypatch.setattr(io, "TASK_ROWS", 500)
    assert [run(n) for n in names] == plain and all(plain)


def test_ngrams_are_dealt_once_and_not_written(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("written")

    monkeypatch.setattr(io, "settle", fail)
    monkeypatch.setattr(mining, "TASK_ROWS", 2)
    df = spark.createDataFrame([(1, "a b c", True), (2, "a b d", True), (3, "x y", False), (4, None, True)], "doc_id long, text string, positive boolean")
    got = mining.contrast_levels(df, "doc_id", F.split("text", " "), 2)
    assert [(r.feature, r.df_pos, r.df_neg) for r in got.collect()] == [("a b", 2, 0)]
