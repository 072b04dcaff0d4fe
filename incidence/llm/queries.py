"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidence.llm import attention, audit, chat, decontamination, lines, packing, quality, repair, sharding, simhash, substring, urls, warc

#: The url rules.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.find_repeats(_table(spark, sf_dir, "documents"), window=50)
    kept = F.sha2(substring.without_spans(F.col("text"), F.col("spans")), 256)
    cut = found.spans.select("doc_id", "_id", substring.removed_words(F.col("spans")).alias("n_removed"), kept.alias("cut_sha256"))
    return found.documents.join(cut, ["doc_id", "_id"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "words_sha256").alias("kept_sha256")
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back_turns(chat.format_turns(turns.unionByName(extra)))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    mined = urls.mine_rules(urls.page_labels(pages, _table(spark, sf_dir, "labels")))
    return urls.filter_urls(pages, mined, URL_RULES)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), bits=4, shingle=4)
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = lines.repeated_lines(docs, min_words=1).select("doc_id", "_id", "removed")
    text = F.coalesce("text", F.lit(""))
    whole = docs.withColumn("_id", F.xxhash64(text)).join(gone.hint("merge"), ["doc_id", "_id"], "left")
    kept = lines.without_lines(text, F.col("removed"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return whole.select("doc_id", F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"), F.size(removed).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(_table(spark, sf_dir, "conversations")))


def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that fixed rules decide."""
    pages = _table(spark, sf_dir, "pages")
    host, path = urls.split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fixed", urls.fixed_rule(F.col("host"), F.col("path"), URL_RULES))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("verdict"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rule of op7."""
    out = quality.with_statistics(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.STATS, quality.base_failed().alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_url_filters": op3_url_filters,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sharding": op10_sharding,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_conversation_repair": op13_conversation_repair,
    "url_fixed_rules": url_fixed_rules,
    "quality_base": quality_base,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
with words as (
  select doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w,
         generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) as i
  from documents),
runs as (
  select doc_id, i, w, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 49 following) as run,
         count(*) over (partition by doc_id order by i rows between current row and 49 following) as n from words),
owners as (select run, min(doc_id) as first_doc from runs where n = 50 group by run),
hits as (select r.doc_id, r.i from runs r join owners o on r.run = o.run where r.n = 50 and o.first_doc < r.doc_id),
marked as (
  select w.doc_id, w.i, w.w, max(h.i) over (partition by w.doc_id order by w.i rows between 49 preceding and current row) is not null as gone
  from words w left join hits h on w.doc_id = h.doc_id and w.i = h.i),
cut as (
  select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
         sha256(coalesce(string_agg(w, ' ' order by i) filter (where not gone), '')) as kept_sha256 from marked group by doc_id)
select d.doc_id, coalesce(c.n_words, 0)::bigint as n_words, coalesce(c.n_removed, 0)::bigint as n_removed, coalesce(c.kept_sha256, sha256('')) as kept_sha256
from documents d left join cut c on d.doc_id = c.doc_id
""",
    "op2_chat_formatting": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized as (
  select *, length(role || text) * 2 - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) + 21 as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id
""",
    "op6_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
f as (select payload_digest, min(page_id) as first_page from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when page_id > first_page then 'revisit' else 'response' end as record_type,
       case when page_id > first_page then first_page end as refers_to
from p left join f on p.payload_digest = f.payload_digest
""",
    "op8_line_dedup": r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as number from documents),
worded as (select doc_id, number, line, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as words from split),
sets as (select words, len(words) as n, min((doc_id, number)) as first, row_number() over (order by words) as s from worded where len(words) > 0 group by words),
tokens as (select s, n, unnest(words) as w from sets),
counts as (select w, count(*) as c from tokens group by w),
ranked as (select s, n, w, row_number() over (partition by s order by c, w) as place from tokens join counts using (w)),
prefixes as (select s, n, w from ranked where place <= n - ceil(4 * n / 5.0) + 1),
met as (select distinct a.s as x, b.s as y from prefixes a join prefixes b on a.w = b.w and a.s <> b.s and 4 * a.n <= 5 * b.n and 4 * b.n <= 5 * a.n),
alike as (select m.x, b.first from met m join sets a on m.x = a.s join sets b on m.y = b.s where 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n)),
earliest as (select s, min(first) as first from (select s, first from sets union all select x, first from alike) group by s),
judged as (
  select w.doc_id, w.number, w.line, coalesce((w.doc_id, w.number) > e.first, false) as gone
  from worded w left join sets s on w.words = s.words left join earliest e on s.s = e.s)
select doc_id, coalesce(string_agg(number::varchar, ',' order by number) filter (where gone), '') as removed_lines, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by number) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
""",
    "op12_filter_interaction_audit": r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body),
    'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) over (partition by body), false)} as t
  from d left join l on d.doc_id = l.doc_id),
bits as (select part, good, toxic, [t.A, t.B, t.C, t.D, t.E] as fails, count(*) as n from f group by all),
n5 as (from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) x(k, letter)),
orders as (
  select a.letter || b.letter || c.letter || e.letter || g.letter as filter_order, [a.k, b.k, c.k, e.k, g.k] as ks
  from n5 a, n5 b, n5 c, n5 e, n5 g where len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5),
steps as (select filter_order, step, ks[step] as k, ks[1 : step - 1] as earlier from orders, range(1, 6) s(step)),
told as (
  select part, filter_order, step, k, good, toxic, n, fails[k] as failing, len(list_filter(earlier, lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 and fails[k] as alone
  from bits, steps),
summed as (
  select part, filter_order, step, k, coalesce(sum(n) filter (where not failing and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where failing and not gone), 0)::bigint as removed,
         coalesce(sum(n) filter (where failing and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where alone), 0)::bigint as unique_fails,
         coalesce(sum(n) filter (where failing and not gone and good), 0)::bigint as good_lost, coalesce(sum(n) filter (where failing and not gone and toxic), 0)::bigint as toxic_lost
  from told group by part, filter_order, step, k)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, k)::bigint as shapley from summed
""",
    "op13_conversation_repair": r"""
with recursive bits as (select n, n::bigint as c, 0 as i from range(256) t(n) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bits where i < 8),
tbl as (select list(c order by n) as t from bits where i = 8),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hashed as (
  select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as hit from named, tbl),
rows as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, range(case hit when 0 then 0 when 3 then 2 else 1 end) copy),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from rows),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final from placed),
turns as (
  select conv_id, i, turn, role, text, substr(role, 1, 1) as initial, case when final = '' then 'B' when again then 'D' when final not in ('.', '!', '?') then 'T' else '-' end as fault,
         lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from seen),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 'B') as blank, count(*) filter (where fault = 'D') as duplicate,
         count(*) filter (where fault = 'T') as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from turns group by conv_id),
inserts as (from (values (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])) x(a, b, letters, said)),
follows as (from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) x(a, initial, b)),
edits as (
  select conv_id, i, a, b, cost, letter, said from (
    select conv_id, i, s.a as a, s.a as b, 4 as cost, 'D' as letter, [] as said from turns, (from (values (0), (1), (2), (3)) x(a)) s
    union all select conv_id, i, f.a, f.b, case when fault = 'T' then 3 else 0 end, 'K', [role || ':' || text] from turns join follows f using (initial) where fault not in ('B', 'D')
    union all select conv_id, i, s.a, s.b, case when fault = 'T' then 6 else 3 end, 'R', [s.name || ':' || text] from turns, (from (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) x(a, b, name)) s where fault not in ('B', 'D'))),
moves as (
  select conv_id, i, n.a, e.b, e.cost + 3 * length(letters) as cost, letters || letter as audit, list_concat(n.said, e.said) as said from edits e join inserts n on e.a = n.b),
paths as (
  select conv_id, 0::bigint as i, 0 as state, {'cost': 0::bigint, 'audit': ''} as best, []::varchar[] as said from (select distinct conv_id from turns)
  union all
  select p.conv_id, p.i + 1, m.b, min({'cost': p.best.cost + m.cost, 'audit': p.best.audit || m.audit}), arg_min(list_concat(p.said, m.said), {'cost': p.best.cost + m.cost, 'audit': p.best.audit || m.audit})
  from paths p join moves m on p.conv_id is not distinct from m.conv_id and m.i = p.i + 1 and m.a = p.state group by p.conv_id, p.i, m.b),
ends as (
  select p.conv_id, {'cost': best.cost + 3 * length(letters), 'audit': best.audit || letters} as best, list_concat(p.said, n.said) as said
  from paths p join inserts n on n.a = p.state and n.b in (0, 3) where p.i = (select count(*) from turns t where t.conv_id is not distinct from p.conv_id)),
chosen as (select conv_id, min(best) as best, arg_min(said, best) as said from ends group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(h.best.cost, 0)::bigint as cost, coalesce(h.best.audit, '') as audit, sha256(coalesce(array_to_string(h.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id left join chosen h on o.conv_id is not distinct from h.conv_id
""",
    "url_fixed_rules": r"""
with cut as (select page_id, url, position('://' in url) as pos from pages),
parts as (
  select page_id, case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*') else '' end as named,
         case when pos > 0 then substr(url, pos + 3) else '' end as rest from cut),
split as (
  select page_id, translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(named) + 1), '^[^?#]*') as path from parts),
rules as (from (values ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
  ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')) r(name, start, rule, verdict)),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from split join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by page_id)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, verdict from split left join best using (page_id)
""",
    "quality_base": r"""
with texts as (select doc_id, coalesce(text, '') as body from documents),
worded as (select *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from texts),
places as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from worded),
windows as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as times from places),
repeats as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from windows where times > 1) group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(body, chr(10))) as line from texts) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counted as (
  select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from worded w left join lines l on w.doc_id = l.doc_id left join repeats r on w.doc_id = r.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
""",
}
