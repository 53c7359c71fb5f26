"""What two columns read is computed once for a letter."""

from pyspark.sql import functions as F

from parchment.operators import rules
from parchment.plans import catalog


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_put_together_once(spark, sf):
    assert optimized(catalog.QUERIES["report_page"](spark, sf)).count("<html><h1>") == 1


def test_an_answer_is_spelled_once_to_tell_whether_it_was_read(spark):
    df = spark.createDataFrame([('{"text_tampering_score": 7}',), ("{}",), ("[1]",), ("null",), ("no {json",), (None,)], "r string").coalesce(1)
    out = df.select(rules.parse_scores(F.col("r"), F.lit(True)).alias("a"))
    assert "schemaofvariant" not in optimized(out).lower()
    assert [(r.failed, r.text_score) for r in out.select("a.failed", "a.text_score").collect()] == [(False, 7), *[(True, None)] * 5]
