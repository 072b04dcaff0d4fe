"""Forecasts with sparse trend changes."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from incidence.operators import trend

DAYS = np.arange(np.datetime64("2020-01-01"), np.datetime64("2024-01-01"))


def series(seed, bend=0.02, noise=1.0):
    """A level, a trend that bends once, a year's and a week's wave."""
    rng, t = np.random.default_rng(seed), np.arange(len(DAYS), dtype=float)
    y = 40 + 0.01 * t + bend * np.maximum(t - 500, 0) + 6 * np.sin(2 * np.pi * DAYS.astype(float) / 365.25) + 3 * (DAYS.astype(int) % 7 == 2) + rng.normal(0, noise, len(t))
    return np.maximum(y, 0)


def test_bends_are_sparse_and_found():
    y = series(1)
    fit = trend.fit_series(DAYS, y, np.zeros((len(DAYS), 0)))
    deltas = fit.terms[2 : 2 + len(fit.bends)]
    assert (deltas == 0).sum() >= 10
    slope = np.cumsum(np.r_[fit.terms[1], deltas]) * fit.scale / fit.span
    assert abs(slope[0] - 0.01) < 0.006 and abs(slope[-1] - 0.03) < 0.004
    _, told = fit.parts(DAYS, np.zeros((len(DAYS), 0)))
    assert np.sqrt(((told - y) ** 2).mean()) < 1.15 and abs(fit.noise * fit.scale - 1) < 0.15


def test_terms_are_the_minimum():
    """No small step in any term makes the penalised loss smaller."""
    y = series(2)[:400]
    days, extra = DAYS[:400], np.column_stack([np.arange(400) % 11 == 0]).astype(float)
    fit = trend.fit_series(days, y, extra, rounds=1, sweeps=5000)
    t = np.arange(400) / fit.span
    x, z, noise = trend._design(t, days, fit.bends, extra), y / fit.scale, max(float((y / fit.scale).std()), 1e-3)
    sparse = np.zeros(x.shape[1], bool)
    sparse[2 : 2 + len(fit.bends)] = True
    loss = lambda w: ((z - x @ w) ** 2).sum() / (2 * noise**2) + np.abs(w[sparse]).sum() / trend.BEND_SCALE + (w[~sparse] ** 2).sum() / (2 * trend.TERM_SCALE**2)
    for k in range(x.shape[1]):
        for step in (1e-3, -1e-3):
            moved = fit.terms.copy()
            moved[k] += step
            assert loss(moved) > loss(fit.terms) - 1e-6


def frame(spark, series_rows):
    rows = [(name, d.item(), float(v) if v is not None else None, int(i % 50 == 0)) for name, values in series_rows for i, (d, v) in enumerate(zip(DAYS, values, strict=False))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series", "day", "y", "promo"]), "series string, day date, y double, promo int")


def test_all_origins_in_one_job_with_an_honest_band(spark):
    df = frame(spark, [(f"s{i}", series(i, bend=0.0)) for i in range(4)])
    parted = trend.origins(df, ["series"], first=600, every=300, ahead=120)
    assert parted.select("series", "cutoff").distinct().count() == 4 * 3
    told = trend.forecast(parted, "cutoff", ["series"], ["promo"])
    assert told.count() == 4 * 3 * 120
    out = trend.scored(told, ["series", "cutoff"]).collect()
    assert len(out) == 12 and all(r["days"] == 120 and r["mape"] < 15 for r in out)
    assert 0.85 < np.mean([r["coverage"] for r in out]) <= 1
    assert sorted(map(str, told.collect())) == sorted(map(str, trend.forecast(parted, "cutoff", ["series"], ["promo"]).collect()))


def test_bands_widen_where_the_trend_has_bent(spark):
    widths = []
    for bend in (0.0, 0.06):
        fit = trend.fit_series(DAYS[:1000], series(3, bend=bend)[:1000], np.zeros((1000, 0)))
        _, low, high = trend.forecast_series(fit, DAYS[1000:1400], np.zeros((400, 0)), 1)
        widths.append((high - low)[[0, -1]])
    assert widths[1][1] > widths[1][0] * 1.2 and widths[1][1] - widths[1][0] > widths[0][1] - widths[0][0]


def test_short_and_empty_histories(spark):
    df = frame(spark, [("one", [5.0] + [None] * 9), ("none", [None] * 10), ("flat", [3.0] * 10)]).withColumn("cutoff", F.lit("2020-01-06").cast("date"))
    out = {(r["series"], r["day"].day): r for r in trend.forecast(df, "cutoff", ["series"]).collect()}
    assert len(out) == 15 and out["one", 8]["predicted"] == 5 and out["none", 8]["predicted"] == 0 and abs(out["flat", 8]["predicted"] - 3) < 0.2
    assert trend.forecast(df.limit(0), "cutoff", ["series"]).count() == 0 and trend.origins(df.drop("cutoff"), ["series"]).count() == 0
