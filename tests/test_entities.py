"""Golden cases of the post rules."""

import pytest
from pyspark.sql import functions as F

from incidence.functions import entities
from incidence.functions.geo import haversine
from incidence.functions.text import flattened, keyword_filter
from incidence.model import severity_of
from incidence.operators.matching import match_posts


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_ages():
    assert [(a, c) for a, c, _ in entities.find_ages("63-летний водитель и 23-летняя женщина")] == [(63, "водитель"), (23, "женщина")]
    assert entities.find_ages("в возрасте 47 лет")[0][:2] == (47, "?")
    assert entities.find_ages("150-летний водитель") == []
    assert entities.find_ages(None) == []


@pytest.mark.parametrize("text, want", [("в 23:20", [(23, 20)]), ("В 7:00 и 23:45", [(7, 0), (23, 45)]), ("около 12.30 на трассе", [(12, 30)]), ("25:00", []), ("12:75", []), ("в 12.27 КоАП", [])])
def test_times(spark, text, want):
    assert [(t["hour"], t["minute"]) for t in one(spark, text, entities.times)] == want


def test_numbers(spark):
    assert one(spark, "стаж вождения 5 лет", entities.experience) == [5]
    assert one(spark, "водительский стаж составляет 28 лет", entities.experience) == [28]
    assert one(spark, "на 82 км и 120 км", entities.kilometres) == [82, 120]


def test_ages_five_characters_apart():
    found = entities.find_ages("5-летняя 9 лет девушка")
    assert [(a, c) for a, c, _ in entities.find_ages("5 лет парень 9 лет девушка")] == [(5, "парен"), (9, "девушк")]
    assert [(a, c) for a, c, _ in found] == [(9, "девушк")]


def test_incident_keywords(spark):
    from incidence.functions.text import incident_filter

    assert one(spark, "Допустил СТОЛКНОВЕНИЕ с автомобилем", incident_filter)["keywords"] == ["столкновени", "допустил столкнов", "автомобил"]
    assert not one(spark, "столкновение, мошенник", incident_filter)["is_match"] and not one(spark, "автомобиль и водитель", incident_filter)["is_match"]
    assert one(spark, "", incident_filter)["keywords"] == []


def test_locations(spark):
    from incidence.functions.places import locations, place_names

    rows = spark.createDataFrame([(["Владивостоке", "Владивосток", "Уссурийске", "Москва", None],)], "n array<string>")
    assert rows.select(locations(F.col("n")).alias("x")).first()["x"] == ["г Владивосток", "г Уссурийск"]
    assert one(spark, "в Большом Камне и Артёме, не Артеменко", lambda c: locations(place_names(c))) == ["г Артем", "г Большой Камень"]


def test_brand_models():
    find = entities.find_brands
    assert find("Toyota Land Cruiser 200, шевроле нива") == [("TOYOTA", "Toyota Land Cruiser 200", 0), ("CHEVROLET", "шевроле", 25), ("LADA", "нива", 33)]
    assert find("Mercedes-Benz E200 и Форд который ехал") == [("MERCEDES-BENZ", "Mercedes-Benz", 0), ("FORD", "Форд", 21)]
    assert entities.brand_finder(("Yutong",))("автобус YUTONG ZK6")[0][:2] == ("YUTONG", "YUTONG ZK6")


def test_persons(spark):
    rows = spark.createDataFrame([("Иванов Пётр Сергеевич и А. Петров, ул. Ольгина, Тойота", ["Иванов Пётр Сергеевич", "А. Петров", "Ольгина", "Ия", "Нет Такого"], ["Тойота"])], "t string, s array<string>, v array<string>")
    assert rows.select(entities.persons(F.col("s"), F.col("t"), F.col("v")).alias("x")).first()["x"] == ["Иванов Пётр Сергеевич", "А. Петров"]
    assert one(spark, "Иванов Пётр Сергеевич и А. Петров", entities.name_spans) == ["Иванов Пётр Сергеевич", "А. Петров"]


def test_brands():
    assert [b for b, _, _ in entities.find_brands("Нисан и тойота")] == ["NISSAN", "TOYOTA"]
    assert entities.find_brands("") == []


def test_what_a_post_says(spark):
    assert one(spark, "погиб на месте, госпитализирован", entities.expected_severity) == "dead"
    assert one(spark, "мотоциклист", entities.expected_em_type) is None
    assert one(spark, "допустил столкновение", entities.expected_em_type) == "Столкновение"


def test_keywords(spark):
    assert one(spark, "some ENMENT text", keyword_filter)["is_match"]
    veto = one(spark, "enment moron", keyword_filter)
    assert not veto["is_match"] and veto["keywords"] == []


def test_flattened(spark):
    assert one(spark, '["a ", {"type": "bold", "text": "b"}, " c"]', flattened) == "a b c"
    assert one(spark, '"plain"', flattened) == "plain"


def test_severity(spark):
    rows = spark.createDataFrame([(1, 0), (0, 5), (0, 2), (0, 1), (0, 0)], "lost long, suffer long")
    assert [r[0] for r in rows.select(severity_of(F.col("lost"), F.col("suffer"))).collect()] == ["dead", "severe_multiple", "severe", "light", "no_injuries"]


def test_haversine(spark):
    d = spark.range(1).select(haversine(F.lit(43.0), F.lit(131.0), F.lit(43.0), F.lit(132.0)).alias("d")).first()["d"]
    assert abs(d - 81323) < 50


def test_match_scores(spark):
    post = [(1, "2024-05-10", ["г Владивосток"], [599], ["ул Светланская"], ["TOYOTA", "NISSAN", "HONDA"], "Столкновение", "dead")]
    posts = spark.createDataFrame(post, "post_id long, post_date string, post_locations array<string>, post_kilometers array<int>, post_streets array<string>, post_brands array<string>, post_em_type string, post_severity string").withColumn("post_date", F.to_date("post_date"))
    rows = [
        (1, "2024-05-09 10:00:00", "г Владивосток", 600.0, "ул Светланская", "dead", "Столкновение", ["TOYOTA", "nissan", "Honda"]),
        (2, "2024-05-09 10:00:00", "г Владивосток", 100.0, None, "light", None, []),
        (3, "2024-04-01 10:00:00", "г Владивосток", 600.0, "ул Светланская", "dead", "Столкновение", ["TOYOTA"]),
    ]
    accidents = spark.createDataFrame(rows, "id long, datetime string, np string, road_km double, street string, severity string, em_type string, vehicle_marks array<string>").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    got = {r["id"]: r for r in match_posts(posts, accidents).collect()}
    assert set(got) == {1, 2}
    assert got[1]["score"] == 30 + 30 + 20 + 15 + 50 + 10 and got[1]["place"] == 1
    assert got[2]["score"] == 30 and got[2]["score_breakdown"] == {"np": 30}
    assert {r["id"] for r in match_posts(posts, accidents, threshold=60).collect()} == {1}


def test_reading_equals_the_column_rules(spark):
    """One pass of the automaton finds what the rules over columns find, word by word."""
    import random

    from incidence.functions.places import LOCATIONS, place_names
    from incidence.functions.text import INCIDENT_NEGATIVE, INCIDENT_STRONG, INCIDENT_WEAK, first_group, incident_filter

    rng = random.Random(9)
    words = [*INCIDENT_NEGATIVE[:6], *INCIDENT_STRONG, *INCIDENT_WEAK, *LOCATIONS, *(w for _, g in entities.EM_TYPES + entities.SEVERITIES for w in g), "и", "Камень-", "xx", "Ёлка", "İ", "-", ",", "сбил"]
    texts = ["", None] + ["".join(rng.choice(words).capitalize() + rng.choice([" ", " ", "", ", ", "-"]) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    text = F.coalesce("t", F.lit(""))
    r = entities.read(F.col("t"))
    pairs = {
        "is_match": incident_filter(text)["is_match"], "keywords": incident_filter(text)["keywords"], "place_names": place_names(text),
        "em_type": first_group(text, entities.EM_TYPES), "severity": first_group(text, entities.SEVERITIES),
    }
    out = rows.select("t", r.alias("r"), *[c.alias(f"{k}_c") for k, c in pairs.items()]).collect()
    for row in out:
        assert {k: row["r"][k] for k in pairs} == {k: row[f"{k}_c"] for k in pairs}, row["t"]


def test_listed_brands():
    assert len(set(entities.LISTED_BRANDS)) == len(entities.LISTED_BRANDS) == 199
    find = entities.brand_finder(entities.LISTED_BRANDS)
    for brand in entities.LISTED_BRANDS:
        assert find(f"автомобиль {brand.lower()}, столкновение")[0][0] == brand.upper()
    assert [b for b, _, _ in find("Land Rover и Rover, Мазда; тойота")] == ["LAND ROVER", "ROVER", "ROVER", "MAZDA", "TOYOTA"]
    assert find("мотоциклист Аско") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("63-летний водитель", [(63, "водитель")]), ("47 лет водитель ехал", [(47, "водитель")]), ("44 года женщина", [(44, "женщин")]), ("Пострадавший в возрасте 47 лет был", [(47, "?")]),
        ("150-летний дед, 0-летний малыш", []), ("12 - летний мальчик", []), ("1234-летний дуб", []), ("7‐летняя и 9-летнего Ученика", [(7, "?"), (9, "ученика")]), ("в возрасте", []), ("5 лет стажа", []),
    ],
)
def test_age_grammar(text, want):
    assert [(a, c) for a, c, _ in entities.find_ages(text)] == want


@pytest.mark.parametrize(
    "text, times, experience, kilometres",
    [
        ("В 7:00 и 23:45, 24:00, 10:20:30, 1:5", [(7, 0), (23, 45), (24, 0), (10, 20)], [], []),
        ("около 12.30; в 12.27 КоАП, в 12.24 ч. 1, в 8.15 ч утра; 9.40", [(12, 30), (8, 15)], [], []),
        ("стаж - 5 лет, стажем 28 лет; стаж вождения составил 12 лет. Стаж 100 лет, стаж большой, 3 года", [], [5, 28, 12], []),
        ("599 км, 82 КМ и 120км, 12345 км, 5 километров", [], [], [599, 82, 120]),
    ],
)
def test_number_grammar(text, times, experience, kilometres):
    found = entities.read_text(text)
    assert [(t["hour"], t["minute"]) for t in found["times"]] == times and found["experience"] == experience and found["kilometres"] == kilometres


def test_street_grammar():
    found = entities.read_text("на улице Шилкинская, ул. Светланской, пр-кт 100 лет, пр. Красного Знамени, переулке Тихий и шоссе Северное; улица без имени; бульвара Гагарина-Южный Второй Третий Четвёртый")
    assert found["streets"] == ["б-р Гагарина-Южный Второй Третий", "пер Тихий", "пр-кт Красного Знамени", "ул Светланской", "ул Шилкинская", "ш Северное"]


@pytest.mark.parametrize(
    "text, want",
    [(None, None), ("null", None), ("[]", []), ('["a", 1, null, true, {"k": 2}]', ["a", "1", "true", '{"k":2}']), ('"x"', ["x"]), ("5", ["5"]), ('{"k": "v"}', ['{"k":"v"}']), ("Дождь", ["Дождь"]), ("[broken", ["[broken"]), ("", [""]), ('[["a"], []]', ['["a"]', "[]"])],
)
def test_json_strings(spark, text, want):
    from incidence.functions.text import json_strings

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(json_strings(F.col("t")).alias("x")).first()["x"] == want


def test_streets_meet_by_parts_of_their_names(spark):
    """Candidates lose no pair that all pairs of a day would give, whatever part of a name the other one is."""
    from incidence.operators.matching import holding

    names = ["ул Светланская", "ул Новосветланская улица", "ул Све", "ул С", "ул ", "ш Северное", "пер Северное-2", "", None]
    posts = spark.createDataFrame([(i, "2024-05-10", [], [], [n], [], None, None) for i, n in enumerate(names) if n is not None], "post_id long, post_date string, post_locations array<string>, post_kilometers array<int>, post_streets array<string>, post_brands array<string>, post_em_type string, post_severity string").withColumn("post_date", F.to_date("post_date"))
    accidents = spark.createDataFrame([(i, "2024-05-09 10:00:00", None, None, n, None, None, []) for i, n in enumerate(names)], "id long, datetime string, np string, road_km double, street string, severity string, em_type string, vehicle_marks array<string>").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    bare = lambda s: s.split(" ", 1)[1].lstrip().lower() if " " in s else s.lower()
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a is not None and b is not None and bare(b) and (bare(a) in bare(b) or bare(b) in bare(a))}
    got = {(r["post_id"], r["id"]) for r in match_posts(posts, accidents, threshold=30).collect()}
    assert got == want and {(r["post_id"], r["id"]) for r in match_posts(posts, accidents, threshold=25).collect()} == want
    long, short = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("a", ["abcd", "ab", "", "xabcx"]), ("b", ["abc", "b", "", "abcde"])))
    assert {tuple(r) for r in holding(long, short, "a", "b").collect()} == {("abcd", "abc"), ("abcd", "b"), ("ab", "b"), ("xabcx", "abc"), ("xabcx", "b")}
