import re

from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import relevance

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_relevance_reads_the_text_once(spark):
    """the rules of the score share one search for set-ups and each of its terms."""
    plan = plan_of(spark, "sc16_relevance")
    assert plan.count("isolated") == 1 and "regexp_count" not in plan
    assert len(re.findall(r"Contains\([^,]*, usdjpy\)", plan)) == 1


def test_terms_in_normalised_text(spark):
    """Texts are normalised only where that changes a letter, or for terms with white space."""
    rows = [("ذَهَب",), ("الفـوركس",), ("gold\u00a0  rush",), ("أخبار",), (None,), ("plain",)]
    df = spark.createDataFrame(rows, "t string")
    found = [r[0] for r in df.select(relevance.first_term(F.col("t"), ["ذهب", "gold rush", "اخبار"])).collect()]
    assert found == ["ذهب", None, "gold rush", "اخبار", None, None]
    signs = [tuple(r[0]) for r in df.select(relevance.text_signs(F.col("t"))).collect()]
    assert signs == [(True, False, False), (True, False, False), (True, False, False), (False, False, False), (False, False, False), (False, False, False)]
