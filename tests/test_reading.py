"""Texts are read once, and for the wanted fields only."""

import pytest
from pyspark.sql import functions as F

from incidence.functions import entities
from incidence.plans import registry

SF = "/root/testdata/sf0.001"
TEXT = "В 07:15 на 12 км трассы в Уссурийске на ул. Светланской 40-летний водитель, стаж вождения - 7 лет, автомобиль Toyota Prado, допустил столкновение, погиб"


@pytest.mark.parametrize("text", [TEXT, "", None, "возраст 5", "стаж 3 года", "12:", "пр-", "ул", "7"])
def test_single_fields_are_those_of_the_whole(text):
    whole = entities.read_text(text)
    assert set(whole) == set(entities.READ)
    for name in whole:
        assert entities.read_text(text, only=(name,)) == {name: whole[name]}
    assert text != TEXT or whole["experience"] == [7] and whole["kilometres"] == [12] and whole["streets"] == ["ул Светланской"] and whole["is_match"]


@pytest.mark.parametrize("name, sources", [("ner_statistics", 3), ("post_volume", 1)])
def test_texts_are_read_once(spark, name, sources):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("told(") == sources and "streets:" not in plan


def test_many_texts(spark):
    rows = spark.range(2 * entities.TEXTS + 1).select(F.concat(F.col("id") % 90 + 10, F.lit("-летний водитель")).alias("t")).coalesce(1)
    assert [r[0] for r in rows.select(entities.ages(F.col("t"))[0]["age"]).collect()] == [i % 90 + 10 for i in range(2 * entities.TEXTS + 1)]
