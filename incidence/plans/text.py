"""Posts and topics: keyword rules, counts, words that tell topics apart, vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidence.functions.text import NEGATIVE, STRONG, WEAK, json_strings, keyword_filter, normalized
from incidence.model import table
from incidence.operators.vectors import nearest
from incidence.plans.base import query

_ANY = lambda words: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(f"select doc_id, not {_ANY(NEGATIVE)} and {_ANY(STRONG)} as is_match, case when {_ANY(NEGATIVE)} then '' else array_to_string(list_filter([" + ", ".join(f"case when contains(lower(text), '{w}') then '{w}' end" for w in STRONG + WEAK) + "], lambda x: x is not null), ',') end as keywords from documents")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", keyword_filter(F.col("text")).alias("k"))
    return rows.select("doc_id", F.col("k.is_match").alias("is_match"), F.array_join("k.keywords", ",").alias("keywords"))


@query("select w as keyword, count(*) as n from documents, (select unnest([" + ", ".join(f"'{w}'" for w in STRONG + WEAK) + f"]) as w) where contains(lower(text), w) and not {_ANY(NEGATIVE)} group by w")
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(keyword_filter(F.col("text"))["keywords"]).alias("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query(f"select {_ANY(STRONG)} as is_match, count(*) as n, min(length(text)) as least, round(avg(length(text)), 4) as mean, max(length(text)) as most from documents group by 1")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.char_length("text").cast("long")
    strong = F.size(F.filter(F.array(*[F.lower("text").contains(w) for w in STRONG]), lambda x: x)) > 0
    return table(spark, sf_dir, "documents").groupBy(strong.alias("is_match")).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.round(F.avg(size), 4).alias("mean"), F.max(size).alias("most"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r\f\v]+', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) as text_md5 from documents")
def corpus_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalized(F.col("text")).cast("binary")).alias("text_md5"))


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars, round(100e0 * count(*) / sum(count(*)) over (), 4) as pct from documents group by all")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return rows.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def words_of(text: Column) -> Column:
    """Lower-cased runs of three letters a to z at least."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1))


@query(r"""
with words as (select lang as topic, unnest(regexp_extract_all(lower(text), '([a-z]{3,})', 1)) as word from documents),
tf as (select topic, word, count(*) as n from words group by all),
sizes as (select avg(n) as mean from (select topic, sum(n) as n from tf group by topic)),
scored as (select topic, word, round(n * ln(1 + mean / sum(n) over (partition by word)), 5) as score from tf, sizes)
select topic, word, place, score from (select *, row_number() over (partition by topic order by score desc, word) as place from scored) where place <= 10""")
def ctfidf_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten words that tell a topic apart: frequency in the topic, damped by frequency over all."""
    tf = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), F.explode(words_of(F.col("text"))).alias("word")).groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n"))
    mean = tf.groupBy("topic").agg(F.sum("n").alias("n")).agg(F.avg("n").alias("mean"))
    whole = tf.groupBy("word").agg(F.sum("n").alias("whole"))
    scored = tf.join(whole, "word").crossJoin(F.broadcast(mean)).select("topic", "word", F.round(F.col("n") * F.log1p(F.col("mean") / F.col("whole")), 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place.cast("long")).where("place <= 10")


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@query("""
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id in (0, 7, 42)),
sims as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 5) as similarity from embeddings, q where vec_id <> query_id)
select query_id, vec_id, place, similarity from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as place from sims) where place <= 10""")
def vector_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of three queries by cosine."""
    units = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("v"))
    asked = units.where(F.col("vec_id").isin(0, 7, 42)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))  # three rows
    sims = units.crossJoin(F.broadcast(asked)).where("vec_id <> query_id").select("query_id", "vec_id", F.round(dot(F.col("v"), F.col("q")), 5).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return sims.withColumn("place", place.cast("long")).where("place <= 10")


@query("""
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
sims as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 5) as similarity from embeddings, q where vec_id <> query_id)
select query_id, vec_id, place, similarity from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as place from sims) where place <= 10""")
def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by cosine of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("""
with parts as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
centres as (select label, i, avg(x) as x from parts group by all)
select a.label as label, b.label as other, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 4) as similarity from centres a join centres b on a.i = b.i and a.label < b.label group by all""")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each pair of topic centres."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    centres = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    other = centres.select(F.col("label").alias("other"), "i", F.col("x").alias("y"))
    pairs = centres.join(other, "i").where("label < other").groupBy("label", "other")
    return pairs.agg(F.round(F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))), 4).alias("similarity"))


@query("""
with pairs as (select quality as a, toxic as b from labels), cells as (select a, b, count(*) as n from pairs group by all),
s as (select sum(n * (n - 1) / 2e0) as s, sum(n) as n from cells), ra as (select sum(n * (n - 1) / 2e0) as s from (select sum(n) as n from cells group by a)), rb as (select sum(n * (n - 1) / 2e0) as s from (select sum(n) as n from cells group by b)),
e as (select s.s as index, ra.s * rb.s / (s.n * (s.n - 1) / 2e0) as expected, (ra.s + rb.s) / 2e0 as most from s, ra, rb)
select round((index - expected) / nullif(most - expected, 0), 6) as ari from e""")
def ari_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted Rand index of two labellings, from their contingency table."""
    return adjusted_rand(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """`pairs` has labels a and b of the same things."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2.0)
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(two("m").alias(f"s_{c}"))
    whole = cells.agg(two("n").alias("s"), F.sum("n").alias("n")).crossJoin(side("a")).crossJoin(side("b"))  # single rows
    expected, most = F.col("s_a") * F.col("s_b") / (F.col("n") * (F.col("n") - 1) / 2.0), (F.col("s_a") + F.col("s_b")) / 2.0
    return whole.select(F.round(F.try_divide(F.col("s") - expected, most - expected), 6).alias("ari"))


@query("""
with cells as (select label % 5 as topic, quality, count(*) as n from embeddings join labels on vec_id = doc_id group by all)
select topic, coalesce(sum(n) filter (where quality = 0), 0)::bigint as low, coalesce(sum(n) filter (where quality = 1), 0)::bigint as high,
       round(100e0 * coalesce(sum(n) filter (where quality = 0), 0) / sum(n), 2) as low_pct, arg_max(quality, n * 10 + quality) as dominant from cells group by topic""")
def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics against classes with row shares and the dominant class."""
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels"), F.col("vec_id") == F.col("doc_id")).groupBy((F.col("label") % 5).alias("topic"))
    low, n = F.count_if(F.col("quality") == 0), F.count(F.lit(1))
    high = F.count_if(F.col("quality") == 1)
    return rows.agg(low.alias("low"), high.alias("high"), F.round(low * 100.0 / n, 2).alias("low_pct"), F.when(high >= low, 1).otherwise(0).alias("dominant"))


@query("""
select conv_id, md5(string_agg(coalesce(text, ''), '' order by turn)) as whole_md5, count(*) as n, sum(length(text))::bigint as chars from conversations group by conv_id""")
def flatten_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments put together in order, as a post's text is from its parts."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    return rows.select("conv_id", F.md5(F.array_join("parts.text", "").cast("binary")).alias("whole_md5"), F.size("parts").cast("long").alias("n"), "chars")


_MIXED = """
mixed as (select event_id, case event_id % 8 when 0 then null when 1 then '[]' when 2 then '["' || event_type || '", ' || user_id || ', null, true]' when 3 then '"' || event_type || '"' when 4 then user_id::varchar
  when 5 then props when 6 then 'null' else event_type || ' [no JSON' end as v from events)"""


@query("with " + _MIXED + """
select event_id, case when v is null or v = 'null' then null when not json_valid(v) then v
  when json_type(v) = 'ARRAY' then array_to_string(list_filter(v::json ->> '$[*]', lambda x: x is not null), '|') when json_type(v) = 'VARCHAR' then v::json ->> '$' else replace(v, ' ', '') end as strings from mixed""")
def normalized_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of many forms as lists of strings."""
    kind, who, what = F.col("event_id") % 8, F.col("user_id").cast("string"), F.col("event_type")
    mixed = F.when(kind == 1, "[]").when(kind == 2, F.concat(F.lit('["'), what, F.lit('", '), who, F.lit(", null, true]"))).when(kind == 3, F.concat(F.lit('"'), what, F.lit('"'))).when(kind == 4, who)
    mixed = mixed.when(kind == 5, F.col("props")).when(kind == 6, "null").when(kind == 7, F.concat(what, F.lit(" [no JSON")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(json_strings(mixed), "|").alias("strings"))
