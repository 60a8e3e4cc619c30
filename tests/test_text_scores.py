import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import commercial, text

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_intent_reads_each_word_once(spark):
    """nine words, nine searches; none counts to the text's end, none begins with a border."""
    plan = plan_of(spark, "sc17_intent")
    assert plan.count("RLIKE") == 9 and "regexp_count" not in plan and "RLIKE (?<!" not in plan


@pytest.mark.parametrize("word", ["gold", "ذهب", "a b", "x+"])
def test_has_word_is_count_above_zero(spark, word):
    edges = ["", " ", "_", "9", "Z", "م", "é", "-", "\n", "\U0001f600", word]
    rows = [(a + word.upper() + b,) for a in edges for b in edges] + [(word[:-1],), ("",), (None,)]
    out = spark.createDataFrame(rows, "t string").select("t", text.has_word(F.col("t"), word).alias("has"), text.word_count_of(F.col("t"), word).alias("n")).collect()
    edge = re.compile("[A-Za-z0-9_\u0600-\u06ff]")
    for r in out:
        low = None if r.t is None else r.t.lower()
        places = [] if low is None else [m.start() for m in re.finditer(f"(?={re.escape(word)})", low)]
        whole = [i for i in places if not edge.match(low[i - 1 : i]) and not edge.match(low[i + len(word) :][:1])]
        assert (r.has, r.n is not None and r.n > 0) == (None if low is None else bool(whole), bool(whole)), r


def test_has_any_is_a_substring(spark):
    df = spark.createDataFrame([("gold Rush",), ("a.c",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(commercial.has_any(F.col("t"), ["RUSH", "a.c"])).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(commercial.has_any(F.col("t"), [])).collect()] == [False] * 4
