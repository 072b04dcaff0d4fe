"""Entities over whole tables, and over five posts made for it."""

from incidence.operators.matching import assign_ages, settled
from incidence.plans import matching, registry

SF = "/root/testdata/sf0.001"
POSTS = [
    (1, "В 23:20 на 599 км автодороги 63-летний водитель Toyota Corolla допустил столкновение, погиб на месте. Стаж вождения 5 лет."),
    (2, "Около 23.45 на улице Шилкинская 23-летняя женщина, наезд на пешехода, госпитализирована. В возрасте 47 лет мужчина получил травмы."),
    (3, "По ст. 12.27 КоАП; на 82 км и 120 км автомобиль Нисан совершил опрокидывание. 25:00 и 12:75 не время. Водительский стаж составляет 28 лет."),
    (4, ""),
    (5, "8 лет мальчик и 35-летний водитель Honda Fit на проспекте Океанский, съехал в кювет, скончался."),
]
PEOPLE = [(1, 11, "driver", "M"), (1, 12, "passenger", "F"), (2, 21, "pedestrian", "F"), (2, 22, "driver", "M"), (5, 51, "pedestrian", "M"), (5, 52, "driver", None)]


def size(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_all_texts_are_read(spark):
    found = registry.QUERIES["ner_posts"](spark, SF).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"document": size(spark, "documents").count(), "conversation": size(spark, "conversations").count(), "report": size(spark, "lineitem").select("l_orderkey").distinct().count()}


def test_statistics_count_every_participant(spark):
    rows = registry.QUERIES["ner_statistics"](spark, SF).collect()
    lineitems = size(spark, "lineitem").count()
    assert sum(r["n"] for r in rows if r["field"] == "context") == lineitems == sum(r["n"] for r in rows if r["field"] == "brand")


def test_ages_are_those_of_the_table(spark):
    ages = {r["participant_id"]: r["age"] for r in matching.people(spark, SF).collect()}
    found = registry.QUERIES["age_assignment"](spark, SF).collect()
    assert len(found) > 6 and all(ages[r["participant_id"]] == r["age"] for r in found if r["participant_id"] % 8 <= 3)


def test_five_posts(spark):
    rows = spark.createDataFrame(POSTS, "post_id long, text string")
    found = {r["post_id"]: r for r in matching.entities_of(rows).collect()}
    assert [v["brand"] for v in found[1]["vehicles"]] == ["TOYOTA"] and found[1]["kilometers"] == [599] and found[5]["severity"] == "dead" and found[4]["ages"] == []
    told = settled(assign_ages(matching.ages_of(rows), spark.createDataFrame(PEOPLE, "post_id long, participant_id long, role string, sex string")))
    assert {r["participant_id"]: r["age"] for r in told.collect()} == {11: 63, 21: 23, 22: 47, 51: 8, 52: 35}
