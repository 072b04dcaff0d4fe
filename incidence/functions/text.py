"""Text rules as Column expressions, with their SQL where DuckDB has the same."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from incidence.functions.tagger import Tagger, lowered

#: The keyword lists of the demonstration texts.
NEGATIVE = ("worthless", "moron")
STRONG = ("thernt", "enment", "keitung")
WEAK = ("the", "der", "les", "los")


#: Phrases that rule a post out, words that make it one on an accident, and words that go with them.
INCIDENT_NEGATIVE = (
    "мошенник", "обманом", "обманул", "обманула", "обманули", "доверившись", "под предлогом", "позвонил", "позвонила",
    "поздравляю вас", "поздравляем вас", "при исполнении служебных", "при исполнении служебного", "погибших сотрудников",
    "погибшим сотрудникам", "погибших коллег", "погибшим коллегам", "ветераны", "ветеран", "день сотрудника", "день полиции",
    "день памяти", "минута молчания", "светлая память", "вечная память",
)
INCIDENT_STRONG = (
    "наезд", "наехал", "наехала", "опрокидыван", "опрокинул", "опрокинулся", "съехал", "съехала", "съезд с дороги",
    "выехал на встреч", "выехала на встреч", "вылетел", "вылетела", "врезал", "врезалась",
    "столкновени", "допустил столкнов", "совершил столкнов", "столкнулся с автомоб", "столкнулся с автомаш", "столкнулся с встречн",
    "получил травмы", "получила травмы", "получил телесные", "травмирован", "пострадал в дтп", "пострадала в дтп", "пострадали в дтп",
    "госпитализирован", "скончал", "смертельн", "погиб на месте", "погибл на месте", "погиб в дтп", "погибла в дтп", "погибли в дтп",
    "мотоциклист", "велосипедист", "сбил", "сбила",
)
INCIDENT_WEAK = (
    "дтп", "дорожно-транспортн", "пдд", "правил дорожного движени", "автомобил", "автомашин", "водитель", "водительниц", "пешеход",
    "погиб", "погибш", "пострадал", "пострадала",
)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """The words that the lower-cased text holds, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))


@lru_cache(maxsize=8)
def _tagger(negative: tuple[str, ...], strong: tuple[str, ...], weak: tuple[str, ...]) -> Tagger:
    out = Tagger()
    for kind, words in (("negative", negative), ("strong", strong), ("weak", weak)):
        for word in words:
            out.add(kind, word, word)
    return out.close()


def found_words(text: str | None, negative: tuple[str, ...], strong: tuple[str, ...], weak: tuple[str, ...]) -> tuple[bool, list[str]]:
    """What `keyword_filter` says of a text."""
    tags = _tagger(negative, strong, weak).tags(lowered(text or ""))
    if "negative" in tags:
        return False, []
    held = lambda kind: {note for *_, note in tags.get(kind, ())}
    most, more = held("strong"), held("weak")
    return bool(most), [w for w in strong if w in most] + [w for w in weak if w in more]


def keyword_filter(text: Column, negative: tuple[str, ...] = NEGATIVE, strong: tuple[str, ...] = STRONG, weak: tuple[str, ...] = WEAK) -> Column:
    """struct(is_match, keywords): a negative word vetoes; a strong one matches; the keywords are the strong and weak hits.

    A text is read once by an automaton over all words, and not once for every word.
    """

    @F.arrow_udf("struct<is_match:boolean,keywords:array<string>>")
    def told(texts: pa.Array) -> pa.Array:
        rows = [found_words(t, negative, strong, weak) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["is_match", "keywords"])

    return told(text)


def incident_filter(text: Column) -> Column:
    """`keyword_filter` by the words for accidents."""
    return keyword_filter(text, INCIDENT_NEGATIVE, INCIDENT_STRONG, INCIDENT_WEAK)


def first_group(text: Column, groups: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The name of the first group that has a word in the lower-cased text, else null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for name, words in reversed(groups):
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = F.when(test, name).otherwise(out)
    return out


def normalized(text: Column) -> Column:
    """Without links, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"\s+", " "))


def json_strings(text: Column) -> Column:
    """A JSON text of any form as an array of strings: a list's elements, or the one value; null for null, SQL's or JSON's.

    Strings come bare, other values as JSON writes them; null elements are left out. What is no JSON is one string.
    """
    value = F.try_parse_json(text)
    string = lambda v: F.try_variant_get(v, "$", "string")
    many = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), string), lambda x: x.isNotNull())
    return F.when(value.isNull(), F.when(text.isNotNull(), F.array(text))).when(~F.is_variant_null(value), F.coalesce(many, F.array(string(value))))


def flattened(text: Column) -> Column:
    """A message's text from JSON: a string, or a list of strings and segments with a text, put together; else empty."""
    value = F.try_parse_json(text)
    part = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$", "string"))
    many = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), "")
    return F.trim(F.coalesce(many, F.try_variant_get(value, "$", "string"), F.lit("")))
