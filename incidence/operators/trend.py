"""Forecasts of daily series: a trend with sparse changes, weekly and yearly terms, bands from simulated changes to come."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places where the trend may bend, spread over the first part of a history; waves of a year and of a week.
CHANGES, CHANGE_RANGE = 25, 0.8
YEARLY, WEEKLY = 10, 3
#: Scale of the Laplace prior of a bend, and of the normal priors of the other terms, with counts scaled to at most 1.
BEND_SCALE, TERM_SCALE = 0.05, 10.0
#: Simulated futures of a band, and the share that it should hold.
PATHS, SHARE = 500, 0.95


@dataclass
class Fit:
    """Terms of one series; time is scaled so that the history lasts from 0 to 1."""

    first: np.datetime64
    span: float
    scale: float
    bends: np.ndarray  # places
    terms: np.ndarray  # level, slope, bends, seasons, regressors
    noise: float

    def parts(self, days: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = (days - self.first).astype("timedelta64[D]").astype(float) / self.span
        return t, _design(t, days, self.bends, extra) @ self.terms * self.scale


def _design(t: np.ndarray, days: np.ndarray, bends: np.ndarray, extra: np.ndarray) -> np.ndarray:
    day = days.astype("datetime64[D]").astype(float)
    waves = [f(2 * np.pi * k * day / period) for period, n in ((365.25, YEARLY), (7.0, WEEKLY)) for k in range(1, n + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones_like(t), t, *(np.maximum(t - b, 0) for b in bends), *waves, *extra.T])


def fit_series(days: np.ndarray, y: np.ndarray, extra: np.ndarray, rounds: int = 6, sweeps: int = 200) -> Fit:
    """The most probable terms of a history (ascending days, one row each).

    With the noise given, the bends' Laplace prior makes this a lasso on them and a ridge on the others: coordinate descent on
    the normal equations, from the last round's terms, shrinks each bend by a constant and so sets most to exactly 0. The noise is
    taken from what is left and the descent repeated.
    """
    first, span = days[0], max(1.0, float((days[-1] - days[0]).astype("timedelta64[D]").astype(int)))
    scale = max(1.0, float(np.abs(y).max()))
    t, z = (days - first).astype("timedelta64[D]").astype(float) / span, y / scale
    n_bends = min(CHANGES, max(0, int(len(y) * CHANGE_RANGE) - 1))
    bends = np.linspace(0, CHANGE_RANGE, n_bends + 2)[1:-1] if n_bends else np.zeros(0)
    x = _design(t, days, bends, extra)
    gram, target = x.T @ x, x.T @ z
    sparse = np.zeros(x.shape[1], bool)
    sparse[2 : 2 + len(bends)] = True
    terms, noise = np.zeros(x.shape[1]), max(float(z.std()), 1e-3)
    terms[0] = z.mean()
    for _ in range(rounds):
        variance = noise * noise
        ridge = np.where(sparse, 0.0, variance / TERM_SCALE**2)
        bar = variance / BEND_SCALE
        pull = target - gram @ terms
        for _ in range(sweeps):
            most = 0.0
            for k in range(len(terms)):
                if gram[k, k] <= 0:
                    continue
                want = pull[k] + gram[k, k] * terms[k]
                new = np.sign(want) * max(abs(want) - bar, 0.0) / gram[k, k] if sparse[k] else want / (gram[k, k] + ridge[k])
                if new != terms[k]:
                    pull -= gram[:, k] * (new - terms[k])
                    most = max(most, abs(new - terms[k]))
                    terms[k] = new
            if most < 1e-7:
                break
        left = z - x @ terms
        now = max(float(np.sqrt((left * left).mean())), 1e-4)
        if abs(now - noise) < 1e-4 * noise:
            noise = now
            break
        noise = now
    return Fit(first, span, scale, bends, terms, noise)


def forecast_series(fit: Fit, days: np.ndarray, extra: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predicted, low, high) of later days; counts aren't negative.

    After the history the trend may bend as it did within it: as often, and by Laplace steps of the mean size of its
    bends. The band holds SHARE of PATHS such futures with the series' noise.
    """
    t, middle = fit.parts(days, extra)
    rng = np.random.default_rng(seed)
    ahead = np.maximum(t - 1.0, 0.0)
    deltas = fit.terms[2 : 2 + len(fit.bends)]
    size = float(np.abs(deltas).mean()) if len(deltas) else 0.0
    futures = np.tile(middle, (PATHS, 1)) + rng.normal(0, fit.noise * fit.scale, (PATHS, len(days)))
    if size > 0 and len(t) and ahead.max() > 0:
        counts = rng.poisson(len(deltas) / CHANGE_RANGE * ahead.max(), PATHS)
        for path, n in enumerate(counts):
            for place, step in zip(rng.uniform(0, ahead.max(), n), rng.laplace(0, size, n), strict=True):
                futures[path] += step * np.maximum(ahead - place, 0) * fit.scale
    low, high = np.quantile(futures, [(1 - SHARE) / 2, (1 + SHARE) / 2], axis=0)
    return tuple(np.maximum(v, 0.0) for v in (middle, low, high))


FORECAST = "day date, actual double, predicted double, low double, high double"


def forecast(rows: DataFrame, cutoff: str, by: list[str], extra: list[str] | None = None, seed: int = 42) -> DataFrame:
    """by, cutoff, day, actual, predicted, low, high for the rows of each series from its cutoff on.

    `rows` has the series' columns `by`, cutoff, day, y and numeric regressors `extra`, known for all days. A series with a
    cutoff is one group, of as many rows as there are days, and all of them are fitted in one job. Days without y are
    forecast but not learned from; a history of under two days is forecast by its mean. Repeated runs agree.
    """
    names = list(extra or [])

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("day")
        days = part["day"].to_numpy().astype("datetime64[D]")
        end = np.datetime64(part[cutoff].iloc[0], "D")
        past, later = (days < end) & part["y"].notna().to_numpy(), days >= end
        regressors = part[names].to_numpy(float) if names else np.zeros((len(part), 0))
        if past.sum() < 2:
            mean = float(part["y"][past].mean()) if past.any() else 0.0
            told = (np.full(later.sum(), mean),) * 3
        else:
            fit = fit_series(days[past], part["y"].to_numpy(float)[past], regressors[past])
            told = forecast_series(fit, days[later], regressors[later], seed)
        out = part.loc[later, [*by, cutoff, "day"]].copy()
        out["actual"] = part["y"].to_numpy(float)[later]
        for name, values in zip(("predicted", "low", "high"), told, strict=True):
            out[name] = values
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, cutoff)), FORECAST])
    return rows.select(*by, cutoff, "day", F.col("y").cast("double").alias("y"), *names).groupBy(*by, cutoff).applyInPandas(work, schema)


def origins(daily: DataFrame, by: list[str], first: int = 1095, every: int = 365, ahead: int = 180) -> DataFrame:
    """`daily` (by, day, y, ...) once per sliding origin: all days before `cutoff` and the `ahead` days from it on.

    Origins of a series come every `every` days from `first` days on, as long as `ahead` days follow.
    """
    ends = daily.groupBy(*by).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    whole = F.datediff("_last", "_first") + 1
    cuts = F.when(whole - ahead > first, F.sequence(F.lit(first), F.greatest(whole - ahead - 1, F.lit(first)), F.lit(every)))
    places = ends.select(*by, F.explode(F.transform(cuts, lambda d: F.date_add("_first", d))).alias("cutoff"))  # a few per series
    both = daily.join(places, by) if by else daily.crossJoin(F.broadcast(places))
    return both.where(F.col("day") < F.date_add("cutoff", ahead))


def scored(told: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`: days, mae, rmse, mape (over days that aren't 0, in per cent), and coverage: the share of days within the band."""
    gap = F.col("actual") - F.col("predicted")
    held = (F.col("actual") >= F.col("low")) & (F.col("actual") <= F.col("high"))
    return told.where("actual is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (100 * F.avg(F.when(F.col("actual") != 0, F.abs(gap) / F.abs("actual")))).alias("mape"), F.avg(held.cast("double")).alias("coverage")
    )
