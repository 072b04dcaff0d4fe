"""Place names in posts brought to the form of the accident table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and their case forms, and the table's name of each.
LOCATIONS: dict[str, str] = {
    "владивосток": "г Владивосток",
    "уссурийск": "г Уссурийск",
    "находка": "г Находка",
    "артем": "г Артем",
    "артём": "г Артем",
    "партизанск": "г Партизанск",
    "лесозаводск": "г Лесозаводск",
    "арсеньев": "г Арсеньев",
    "дальнегорск": "г Дальнегорск",
    "спасск-дальний": "г Спасск-Дальний",
    "большой камень": "г Большой Камень",
    "фокино": "г Фокино",
    "дальнереченск": "г Дальнереченск",
    "трудовое": "п Трудовое",
    "чугуевка": "с Чугуевка",
    "вольно-надеждинское": "с Вольно-Надеждинское",
    "раздольное": "п Раздольное",
    "кавалерово": "пгт Кавалерово",
    "тавричанка": "п Тавричанка",
    "пограничный": "пгт Пограничный",
    "славянка": "пгт Славянка",
    "уссурийска": "г Уссурийск",
    "уссурийске": "г Уссурийск",
    "уссурийску": "г Уссурийск",
    "владивостока": "г Владивосток",
    "владивостоке": "г Владивосток",
    "владивостоку": "г Владивосток",
    "находки": "г Находка",
    "находке": "г Находка",
    "находку": "г Находка",
    "артеме": "г Артем",
    "артёме": "г Артем",
    "арсеньева": "г Арсеньев",
    "арсеньеве": "г Арсеньев",
    "партизанска": "г Партизанск",
    "партизанске": "г Партизанск",
    "лесозаводска": "г Лесозаводск",
    "лесозаводске": "г Лесозаводск",
    "дальнегорска": "г Дальнегорск",
    "дальнегорске": "г Дальнегорск",
    "спасска": "г Спасск-Дальний",
    "спасске": "г Спасск-Дальний",
    "большом камне": "г Большой Камень",
    "дальнереченска": "г Дальнереченск",
    "дальнереченске": "г Дальнереченск",
}
_WORD = "А-Яа-яЁё"


def locations(names: Column) -> Column:
    """Sorted distinct table names of an array of place names; unknown ones and nulls are left out."""
    table = F.create_map(*[F.lit(x) for pair in LOCATIONS.items() for x in pair])
    found = F.transform(names, lambda n: F.try_element_at(table, F.lower(F.trim(n))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def place_names(text: Column) -> Column:
    """The known names in a text, as whole words, in order; of names at one place the longest."""
    longest = "|".join(sorted(LOCATIONS, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![{_WORD}-])(?:{longest})(?![{_WORD}-])"), F.lit(0))
