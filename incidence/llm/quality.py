"""Quality rules: text statistics and a learned decision list, all in column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidence.llm.common import WHITES, let, materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares of the rows of either label at which thresholds may lie.
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(WHITES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are compared by 64-bit hash. Only texts with a repeated hash sort (hash, place); equal neighbours are
    repeats, and places in order add up to 3 words each, less what the next window shares.
    """

    def covered(places: Column) -> Column:
        parts = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    def repeats(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), covered)

    def windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeats))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, windows))


def _dup_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITES)) != "")
    return let(full, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_upper, which the rules also use.

    Words are runs without space and tab to carriage return; a null text has none. Clashing columns are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = let(_words(body), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    out = df.withColumn("_counted", counted)
    return out.withColumns(
        {
            "n_words": F.col("_counted.n").cast("long"),
            "word_chars": F.length(_without(body, WHITES)).cast("long"),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
            "n_dup_lines": _dup_lines(body).cast("long"),
            "n_repeat_words": F.col("_counted.r").cast("long"),
            "n_upper": (F.length(body) - F.length(_without(body, UPPER))).cast("long"),
        }
    ).drop("_counted")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression of a decision list: true keeps."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(df: DataFrame, labels: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """Labelled rows with boolean low; of more than `max_rows` labels about that many, chosen by a hash of the key."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias(key)).agg((F.min("quality") == 0).alias("low"))
    total = known.count()
    chosen = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, max_rows / max(total, 1)) * (1 << 30))
    return df.where(chosen).join(known, key)


def fit_rules(sample: DataFrame, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_rows: int = 5) -> list[Rule]:
    """Learn a decision list for `low` by sequential covering.

    `sample` has the statistics and boolean low. Spark bins every feature at quantiles of either label and midway between, and counts
    labels by bin vector and fold: the driver sees one cell per row of the bounded sample at most. A rule grows on the
    larger fold by the condition with the highest information gain (of equal ones, the threshold farthest from the
    other rows), loses its last conditions as long as the other fold says so and those that turn no row away, and is kept
    if its precision on both folds holds; its rows leave both. A rule that doesn't hold bars its first condition, and
    the next best one is grown, so that one weak rule doesn't end the list. No or one-sided labels: no rules.
    """
    named = features()
    rows = materialize(sample.select("low", F.pmod(F.hash(*STATS, "n_upper"), F.lit(3)).alias("fold"), *[c.alias(k) for k, c in named.items()]), "labelled")
    points = rows.groupBy("low").agg(*[F.percentile_approx(k, list(QUANTILES), 10_000).alias(k) for k in named]).collect()
    found = {k: sorted({float(x) for r in points for x in r[k] or []}) for k in named}
    cuts = {k: sorted({*v, *((a + b) / 2 for a, b in zip(v, v[1:], strict=False))}) for k, v in found.items()}
    bins = [sum(((F.col(k) > x).cast("int") for x in cuts[k]), F.lit(0)).alias(k) for k in named]
    counted = rows.select((F.col("fold") == 0).alias("test"), "low", *bins).groupBy("test", *named)
    cells = [
        ({k: r[k] for k in named}, r["test"], r["low_rows"], r["n"] - r["low_rows"])
        for r in counted.agg(F.count_if("low").alias("low_rows"), F.count(F.lit(1)).alias("n")).collect()
    ]

    def fits(cell: dict, rule: list[tuple[str, bool, int]]) -> bool:
        return all((cell[k] > at) == above for k, above, at in rule)

    def hits(rule: list, test: bool) -> tuple[int, int]:
        inside = [c for c in cells if c[1] == test and fits(c[0], rule)]
        return sum(c[2] for c in inside), sum(c[3] for c in inside)

    def bits(p: float, n: float) -> float:
        return math.log2((p + 1e-9) / (p + n + 1e-9))

    barred: set[tuple[str, bool, int]] = set()

    def next_condition(grown: list) -> tuple[str, bool, int] | None:
        inside = [c for c in cells if not c[1] and fits(c[0], grown)]
        p0, n0 = sum(c[2] for c in inside), sum(c[3] for c in inside)
        best, gain = None, 1e-6
        for k in named if p0 and n0 else ():
            low, high = [0] * (len(cuts[k]) + 1), [0] * (len(cuts[k]) + 1)
            for cell, _, p, n in inside:
                low[cell[k]] += p
                high[cell[k]] += n
            p = n = 0
            for at in range(len(cuts[k])):
                p, n = p + low[at], n + high[at]
                for above, a, b in ((True, p0 - p, n0 - n), (False, p, n)):
                    if not grown and (k, above, at) in barred:
                        continue
                    g = a * (bits(a, b) - bits(p0, n0)) if a else 0.0
                    if g > gain or above and g == gain:
                        best, gain = (k, above, at), g
        return best

    rules: list[Rule] = []
    while len(rules) < max_rules:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < max_conditions and (found := next_condition(grown)):
            grown.append(found)
        if not grown:
            break
        worth = lambda pn: (pn[0] - pn[1]) / max(pn[0] + pn[1], 1)
        rule = max((grown[:i] for i in range(len(grown), 0, -1)), key=lambda r: worth(hits(r, True)))
        both = lambda r: (*hits(r, False), *hits(r, True))
        for condition in list(rule):
            if len(rule) > 1 and both(shorter := [c for c in rule if c != condition]) == both(rule):
                rule = shorter
        p, n, q, m = both(rule)
        if p + q < min_rows or (precision := (p + q) / (p + q + n + m)) < min_precision:
            barred.add(grown[0])
            continue
        rules.append(Rule(tuple(Condition(k, above, cuts[k][at]) for k, above, at in rule), precision))
        cells = [c for c in cells if not fits(c[0], rule)]
    return rules


def quality_verdicts(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = 20_000) -> DataFrame:
    """All columns of `df`, the statistics, base_failed and kept (false if base_failed, else the learned list's verdict).

    `max_labelled` bounds the labelled rows that the list is learned from; of these, rows that pass the base rule count.
    Without labels only the base rule rejects.
    """
    rules = fit_rules(with_statistics(labelled_sample(df.select(key, text), labels, max_labelled, key), text).where(~base_failed()))
    out = with_statistics(df, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = 20_000) -> DataFrame:
    """The rows and columns of `df` that `quality_verdicts` keeps, whatever the columns' names."""
    whole = df.select(df[key].alias(key), df[text].alias(text), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    return quality_verdicts(whole, labels, text, key, max_labelled).where("kept").select("_row.*")
