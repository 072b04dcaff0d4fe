"""URL filters: fixed host and path rules, then association rules mined by FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.llm.common import materialize

BLOCK = "=block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    known = url.isNotNull() & (at > 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(known, F.translate(host, upper, lower)).otherwise(""), F.when(known, path).otherwise("")


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (`host/path`) that fits, else null.

    A rule fits its host and all its subdomains where the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: the host and its parent domains, path words, file endings and query keys.

    Numbers are no tokens, as they name single pages.
    """
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(F.lower(path), "[/.]"), lambda x: ~x.rlike(r"^\d*$")), lambda x: F.concat(F.lit("path:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    scheme = F.filter(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-z]+)://", 1)), lambda x: x != "")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(domains)
    return F.array_sort(F.array_distinct(F.concat(hosts, words, keys, F.transform(scheme, lambda x: F.concat(F.lit("scheme:"), x)))))


def held_out(labelled: DataFrame) -> Column:
    """Whether a labelled row is kept from mining to confirm the rules: one in three, chosen by a hash of its key."""
    return F.pmod(F.xxhash64(labelled["sample_key"], F.lit("held out")), F.lit(3)) == 0


def lower_bound(hits: Column, rows: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share of `hits` in `rows`."""
    share, spread = hits / rows, F.lit(z * z) / rows
    return (share + spread / 2 - z * F.sqrt(share * (1 - share) / rows + spread / (4 * rows))) / (1 + spread)


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of `rows` (with a column tokens) beside each rule of `rules` whose tokens they all have.

    An inverted index: a row meets a rule under the rule's anchor only, then the other tokens are checked.
    """
    met = rows.withColumn("anchor", F.explode("tokens")).join(rules, "anchor")
    return met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)


def _without_implied(rules: DataFrame) -> DataFrame:
    """The rules but for those of which another one with fewer tokens and no less confidence says at least as much."""
    less = rules.select("anchor", "rule_tokens", F.col("confidence").alias("_least"))
    wide = rules.select(F.col("rule_tokens").alias("tokens"), "confidence")
    implied = matches(wide, less).where((F.size("rule_tokens") < F.size("tokens")) & (F.col("_least") >= F.col("confidence")))
    return rules.join(implied.select(F.col("tokens").alias("rule_tokens")).distinct(), "rule_tokens", "left_anti")


def mine_rules(
    labelled: DataFrame, min_rows: int = 20, min_support: float = 0.0005, min_confidence: float = 0.5, min_lift: float = 1.5, z: float = 1.28, max_rows: int = 50_000
) -> DataFrame:
    """rule_tokens, confidence, support, anchor: token combinations that foretell blocking.

    `labelled` has sample_key, tokens array<string> and blocked boolean. FP-growth mines the combinations in two thirds
    of the rows; rules stay that hold for `min_rows` rows and a share of `min_support` at least and reach the
    confidence and the lift. The other third confirms them: there the share of blocked rows must reach the confidence
    too, and the lower end of its interval (`z` standard errors) the share of all rows. A rule goes only if another
    one with a part of its tokens has its confidence. `max_rows` bounds the rows that the classifier is fitted on: where
    there are more, about that many are chosen by a hash of sample_key. anchor is the rule's rarest token, under which
    the index has it. No labelled rows, or none in either part: no rules. Rows without tokens don't count.
    """
    rows = labelled.where(F.size("tokens") > 0)
    total = rows.count()
    none = labelled.sparkSession.createDataFrame([], "rule_tokens array<string>, confidence double, support double, anchor string")
    if not total:
        return none
    if total > max_rows:
        share = int(max_rows / total * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("sample_key"), F.lit(1 << 30)) < share)
    rows = materialize(rows.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce(held_out(rows), F.lit(False)).alias("held")), "labelled-urls")
    fitted, held = rows.where("not held"), rows.where("held")
    n = fitted.count()
    if not n:
        return none
    baskets = fitted.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= min_lift))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = (
        rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    )
    rules = materialize(rules.join(anchors, "antecedent").select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support", "anchor"), "url-rules")
    seen = matches(held, rules).groupBy("rule_tokens").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("blocked").alias("_hits"))
    base = held.agg(F.avg(F.col("blocked").cast("double"))).first()[0]
    confirmed = seen.where((F.col("_hits") >= min_confidence * F.col("_rows")) & (lower_bound(F.col("_hits"), F.col("_rows"), z) > F.lit(base)))
    return materialize(_without_implied(rules.join(confirmed.select("rule_tokens"), "rule_tokens", "left_semi")), "url-rules")


def filter_urls(pages: DataFrame, mined: DataFrame, fixed: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, mined_confidence: one row per row of `pages`.

    The longest fitting rule of `fixed` decides; else a mined rule blocks that holds all its tokens, and the rest is
    allowed. Mined rules are found by inverted index (see `matches`). Equal urls are judged once. Null urls have an empty host and path and are allowed.
    """
    rows = pages.select(pages[key].alias(key), pages[url].alias("_url"))
    host, path = split_url(F.col("_url"))
    judged = rows.select("_url").where(F.col("_url").isNotNull()).distinct()
    judged = judged.select("_url", url_tokens(F.col("_url"), host, path).alias("tokens"))
    best = matches(judged, mined).groupBy("_url").agg(F.max("confidence").alias("mined_confidence"))
    out = rows.join(best, "_url", "left").withColumns({"host": host, "path": path})
    out = out.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    method = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return out.select(key, "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", method).alias("verdict"), "mined_confidence")


def page_labels(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """tokens, blocked, sample_key for pages whose last numeric path part names a labelled document.

    A document blocks its page if it is toxic or of low quality; unlabelled pages are left out.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(pages[key].alias("sample_key"), pages[url].alias("_url"))
    rows = rows.select("sample_key", url_tokens(F.col("_url"), host, path).alias("tokens"), F.expr("try_cast(nullif(regexp_extract(_url, '/([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$', 1), '') as bigint)").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    return rows.join(known, "doc_id").select("sample_key", "tokens", "blocked")
