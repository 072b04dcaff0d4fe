"""The accident filter reads a text once."""

from pyspark.sql import functions as F

from incidence.functions import text


def test_a_text_is_read_once_whatever_the_number_of_words(spark):
    rows = spark.createDataFrame([(1, "Наезд, водитель ПОГИБ на месте"), (2, "наезд; мошенник"), (3, None), (4, "дтп")], "id long, text string")
    told = rows.select("id", text.incident_filter(F.col("text")).alias("k")).select("id", "k.is_match", "k.keywords")
    found = {r["id"]: (r["is_match"], r["keywords"]) for r in told.collect()}
    low = "наезд, водитель погиб на месте"
    assert found == {1: (True, [w for w in text.INCIDENT_STRONG + text.INCIDENT_WEAK if w in low]), 2: (False, []), 3: (False, []), 4: (False, ["дтп"])}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains" not in plan and "lambda" not in plan
