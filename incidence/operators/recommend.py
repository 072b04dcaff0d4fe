"""Countermeasures: a profile of a place and a catalogue of rules over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidence.functions.stats import share

#: How the driver's five order priorities stand for accident types.
KINDS = {"1-URGENT": "PED", "2-HIGH": "COLLISION", "3-MEDIUM": "ROADSIDE", "4-NOT SPECIFIED": "ROLLOVER", "5-LOW": "BIKE"}
MIN_POINTS = 10


@dataclass(frozen=True)
class CountermeasureRule:
    """`applies` and `priority` are SQL expressions over the columns of a profile, which Spark and DuckDB both read."""

    name: str
    applies: str
    priority: str
    effect: float
    low: float
    high: float
    confidence: float
    cost: str


#: The catalogue.
RULES = [
    CountermeasureRule("R01_speed_limit_30", "top_kind = 'PED' and is_in_city and pct_dead >= 0.03", "1", -0.40, -0.24, -0.63, 0.85, "low"),
    CountermeasureRule("R02_speed_cameras", "pct_severe_or_dead >= 0.20 and (is_highway or top_np in ('CHINA', 'FRANCE', 'BRAZIL'))", "case when pct_dead >= 0.05 then 1 else 2 end", -0.19, -0.08, -0.44, 0.80, "medium"),
    CountermeasureRule("R03_rumble_strips", "false", "2", -0.30, -0.20, -0.60, 0.75, "low"),
    CountermeasureRule("R04_speed_humps", "is_in_city and top_kind = 'PED' and n_points >= 30", "2", -0.50, -0.30, -0.70, 0.70, "low"),
    CountermeasureRule("R05_pedestrian_lighting", "top_kind = 'PED' and n_points >= 20 and (has_night_dominant or dominant_light in ('O', 'P'))", "1", -0.77, -0.68, -0.86, 0.85, "medium"),
    CountermeasureRule("R06_highway_lighting", "is_highway and top_kind in ('ROLLOVER', 'ROADSIDE') and (has_night_dominant or dominant_light = 'O')", "2", -0.32, -0.20, -0.45, 0.75, "high"),
    CountermeasureRule("R07_delineators", "is_highway and top_kind = 'COLLISION' and (has_night_dominant or dominant_light in ('O', 'P'))", "3", -0.15, -0.05, -0.25, 0.65, "low"),
    CountermeasureRule("R08_roundabout", "top_kind = 'COLLISION' and is_in_city and n_points >= 50", "2", -0.78, -0.65, -0.90, 0.80, "high"),
    CountermeasureRule("R09_cable_median_barrier", "top_kind = 'COLLISION' and is_highway and pct_dead >= 0.03", "case when pct_dead >= 0.05 then 1 else 2 end", -0.95, -0.85, -0.99, 0.85, "high"),
    CountermeasureRule("R10_high_friction_surface", "top_kind in ('ROLLOVER', 'ROADSIDE', 'COLLISION') and dominant_state in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')", "case when top_kind = 'ROLLOVER' then 1 else 2 end", -0.83, -0.60, -0.93, 0.80, "medium"),
    CountermeasureRule("R11_guardrail", "top_kind = 'ROADSIDE' and is_highway and pct_dead >= 0.04", "1", -0.50, -0.30, -0.65, 0.75, "medium"),
    CountermeasureRule("R12_lpi", "top_kind = 'PED' and is_in_city and n_points >= 100", "1", -0.587, -0.34, -0.78, 0.65, "low"),
    CountermeasureRule("R13_signal_coordination", "top_kind = 'COLLISION' and is_in_city and n_points >= 80", "2", -0.25, -0.10, -0.40, 0.65, "medium"),
    CountermeasureRule("R14_protected_bike_lane", "top_kind = 'BIKE' and is_in_city", "1", -0.50, -0.30, -0.70, 0.75, "high"),
    CountermeasureRule("R15_rrfb", "top_kind = 'PED' and is_in_city and pct_dead >= 0.02 and n_points < 50", "1", -0.47, -0.28, -0.65, 0.80, "low"),
    CountermeasureRule("R16_seatbelt_enforcement", "pct_dead >= 0.04 and top_kind not in ('PED', 'BIKE')", "2", -0.08, -0.04, -0.14, 0.80, "low"),
    CountermeasureRule("R17_rbt", "pct_dead >= 0.05", "2", -0.15, -0.10, -0.20, 0.75, "medium"),
    CountermeasureRule("R18_anti_icing_brine", "dominant_state in ('BUILDING', 'HOUSEHOLD') and (has_winter_spike or top_kind in ('ROLLOVER', 'ROADSIDE'))", "case when has_winter_spike then 1 else 2 end", -0.78, -0.65, -0.87, 0.70, "medium"),
]


def kind_of(em_type: Column) -> Column:
    out = F.lit("OTHER")
    for raw, kind in KINDS.items():
        out = F.when(em_type == raw, kind).otherwise(out)
    return out


def profile(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, shares, most frequent values (ties by value) and flags of the accidents of each key."""
    n = F.count(F.lit(1))
    part = lambda test: share(F.count_if(test), n)
    kind = kind_of(F.col("em_type"))
    sums = rows.groupBy(*keys).agg(
        n.alias("n_points"), part(F.col("severity") == "dead").alias("dead"), part(F.col("severity").isin("dead", "severe", "severe_multiple")).alias("grave"), F.mode(kind, True).alias("top_kind"), F.mode("np", True).alias("top_np"),
        F.mode("light_type", True).alias("dominant_light"), F.mode("place", True).alias("dominant_state"), part(F.col("k") % 2 == 0).alias("highway"), part(F.col("light_type") == "O").alias("night"), part(F.month("datetime").isin(12, 1, 2)).alias("winter"),
    )
    return sums.select(
        *keys, "n_points", F.round("dead", 6).alias("pct_dead"), F.round("grave", 6).alias("pct_severe_or_dead"), "top_kind", "top_np", "dominant_light", "dominant_state", (F.col("highway") >= 0.5).alias("is_highway"), (F.col("highway") < 0.5).alias("is_in_city"),
        (F.col("night") >= 0.5).alias("has_night_dominant"), (F.col("winter") >= 0.35).alias("has_winter_spike"),
    )


def profile_sql(source: str, key: str) -> str:
    kind = "case em_type " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items()) + " else 'OTHER' end"
    part = lambda test: f"count(*) filter (where {test}) * 1e0 / count(*)"
    return f"""profile as (
  select {key}, count(*) as n_points, round({part("severity = 'dead'")}, 6) as pct_dead, round({part("severity in ('dead', 'severe', 'severe_multiple')")}, 6) as pct_severe_or_dead,
         mode({kind} order by {kind}) as top_kind, mode(np order by np) as top_np, mode(light_type order by light_type) as dominant_light, mode(place order by place) as dominant_state,
         {part("k % 2 = 0")} >= 0.5 as is_highway, {part("k % 2 = 0")} < 0.5 as is_in_city, {part("light_type = 'O'")} >= 0.5 as has_night_dominant, {part("month(datetime) in (12, 1, 2)")} >= 0.35 as has_winter_spike
  from {source} group by {key})"""


def recommend(profiles: DataFrame, key: str, top: int, rules: list[CountermeasureRule] = RULES) -> DataFrame:
    """The `top` rules that apply to each profile of MIN_POINTS accidents at least, by score, then in the catalogue's order.

    A rule's score is the weight of its priority times confidence times the size of its effect. All rules are columns
    of one array, so a profile row meets the catalogue without a join.
    """
    entries = [F.when(F.expr(r.applies), F.struct(F.lit(i).alias("at"), F.lit(r.name).alias("rule"), F.expr(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.effect).alias("effect"))) for i, r in enumerate(rules)]
    rows = profiles.where(F.col("n_points") >= MIN_POINTS).select(key, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("r")).select(key, "r.*")
    weight = F.when(F.col("priority") == 1, 3.0).when(F.col("priority") == 2, 1.5).otherwise(1.0)
    scored = rows.withColumn("score", F.round(weight * F.col("confidence") * F.abs("effect"), 6))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "at")))
    return ranked.where(F.col("place") <= top).select(key, F.col("place").cast("long").alias("place"), "rule", F.col("priority").cast("int").alias("priority"), "score")


def recommend_sql(key: str, top: int, rules: list[CountermeasureRule] = RULES) -> str:
    each = " union all ".join(f"select {key}, {i} as nr, '{r.name}' as rule, {r.priority} as priority, {r.confidence}e0 as confidence, {r.effect}e0 as effect from profile where n_points >= {MIN_POINTS} and ({r.applies})" for i, r in enumerate(rules))
    return f"""entries as ({each}),
scored as (select *, round(case priority when 1 then 3e0 when 2 then 1.5e0 else 1e0 end * confidence * abs(effect), 6) as score from entries)
select {key}, place, rule, priority, score from (select *, row_number() over (partition by {key} order by score desc, nr) as place from scored) where place <= {top}"""
