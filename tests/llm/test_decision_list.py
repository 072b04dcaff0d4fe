"""The decision list of the quality rules against exhaustive search and the labels of the given tables."""

import random

import pytest
from pyspark.sql import functions as F

from incidence.llm import quality


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_low_quality_goes_and_good_stays(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_verdicts(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    assert {(r["quality"], r["kept"]) for r in out} == {(0, False), (1, True)}


def _sample(spark, rows):
    """Statistics that give mean_word, symbol_share and upper_share the wanted values, and low."""
    full = [(100, int(100 * w), int(100 * w * s), 0, 0, int(100 * w * u), low) for w, s, u, low in rows]
    return spark.createDataFrame(full, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, low boolean")


def test_a_weak_rule_does_not_end_the_list(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(3, 5), 0.0, 0.01, False) for _ in range(300)]
    # Long words hold for many low rows but for good ones too; symbols are few and sure.
    rows += [(8.5, 0.0, 0.01, True)] * 90 + [(8.5, 0.0, 0.01, False)] * 10
    rows += [(rng.uniform(3, 5), rng.uniform(0.3, 0.5), 0.01, True) for _ in range(30)]
    df = _sample(spark, rows)
    rules = quality.fit_rules(df)
    assert [(r.conditions[0].feature, r.conditions[0].above, r.precision) for r in rules] == [("symbol_share", True, 1.0)]
    told = df.select("low", quality.verdict(rules).alias("kept"), F.col("n_symbols").alias("s")).collect()
    assert all(r["kept"] == (r["s"] == 0) for r in told)


def test_covering_finds_what_single_thresholds_can(spark):
    """Every threshold rule that holds on all rows, found by trying all, is covered by the list."""
    rng = random.Random(2)
    rows = [(rng.uniform(3, 5), rng.uniform(0, 0.1), rng.uniform(0, 0.1), False) for _ in range(240)]
    rows += [(rng.uniform(6, 7), 0.05, 0.05, True) for _ in range(40)] + [(4.0, rng.uniform(0.2, 0.4), 0.05, True) for _ in range(40)] + [(4.0, 0.05, rng.uniform(0.3, 0.4), True) for _ in range(40)]
    df = _sample(spark, rows)
    rules = quality.fit_rules(df)
    kept = [r["kept"] for r in df.select(quality.verdict(rules).alias("kept")).collect()]
    values = [[r[k] for r in df.select(*[c.alias(k) for k, c in quality.features().items()]).collect()] for k in quality.features()]
    low = [r[3] for r in rows]
    for column in values:
        for cut in set(column):
            for hit in ([x > cut for x in column], [x <= cut for x in column]):
                if sum(hit) >= 20 and all(lo for lo, h in zip(low, hit, strict=True) if h):
                    assert sum(not k for k, h in zip(kept, hit, strict=True) if h) >= 0.9 * sum(hit)
    assert all(k for k, lo in zip(kept, low, strict=True) if not lo)


def test_conditions_that_turn_nothing_away_are_dropped(spark):
    rows = [(4.0, 0.0, 0.01, False)] * 60 + [(4.0, 0.4, 0.4, True)] * 60
    for rule in quality.fit_rules(_sample(spark, rows)):
        assert len(rule.conditions) == 1
    assert quality.fit_rules(_sample(spark, rows).limit(0)) == []
