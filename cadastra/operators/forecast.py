"""Forecasts of short yearly series: one group of rows per series, fitted with NumPy in its task.

A series is years long, so its group is bounded by the range of years, however many series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Defaults of the two damped trends, the intervals and the alphas tried.
DAMPING, SLOPE_CAP, MIN_POINTS, Z = 0.90, 0.20, 4, 1.96
COUNT_DAMPING, COUNT_PULL, BLEND, BLEND_CLIP = 0.88, 0.25, 0.35, 0.25
ALPHAS = (0.1, 1.0, 10.0, 100.0)
EPSILON = 1.35


def damped_steps(horizon: Column, damping: float) -> Column:
    """damping + damping**2 + ... up to the horizon, in closed form."""
    if abs(damping - 1) < 1e-12:
        total = horizon.cast("double")
    else:
        total = damping * (1 - F.pow(F.lit(damping), horizon)) / (1 - damping)
    return F.when(horizon <= 0, 0.0).otherwise(total)


def damped(h: float, damping: float) -> float:
    if h <= 0:
        return 0.0
    return float(h) if abs(damping - 1) < 1e-12 else damping * (1 - damping**h) / (1 - damping)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    design = np.column_stack([np.ones(len(y)), x.reshape(len(y), -1)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    return float(beta[0]), beta[1:]


def huber(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4, epsilon: float = EPSILON) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise sum(s + s * H((y - fit) / s)) + alpha * |w|**2 over the
    weights and the scale s together, by alternating reweighted least squares and its scale."""
    x = x.reshape(len(y), -1)
    design = np.column_stack([np.ones(len(y)), x])
    penalty = np.diag([0.0] + [alpha] * x.shape[1])
    c, w = ols(x, y)
    beta = np.append(c, w)
    scale = max(float(np.sqrt(np.mean((y - design @ beta) ** 2))), 1e-10)
    for _ in range(500):
        r = y - design @ beta
        far = np.abs(r) > epsilon * scale
        n_far = int(far.sum())
        room = len(y) - n_far * epsilon**2
        near_sum = float((r[~far] ** 2).sum())
        if near_sum <= 1e-20 * max(1.0, float((y**2).sum())):
            break
        if room > 0:
            scale = max(float(np.sqrt(near_sum / room)), 1e-10)
        weight = np.where(far, epsilon * scale / np.maximum(np.abs(r), 1e-300), 1.0)
        left = design.T @ (design * weight[:, None]) + scale * penalty
        new = np.linalg.solve(left + 1e-14 * np.eye(len(left)), design.T @ (weight * y))
        if np.max(np.abs(new - beta)) < 1e-10 * max(1.0, np.max(np.abs(new))):
            beta = new
            break
        beta = new
    return float(beta[0]), beta[1:]


def holt_damped(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Fitted values and forecast of Holt's damped additive trend; smoothing, damping and the
    starting state minimise the squared one-step error."""
    n = len(y)

    def run(alpha: float, beta: float, phi: float) -> tuple[float, np.ndarray, float, float]:
        # the one-step errors are linear in the starting level and trend: solve for them
        fits = np.zeros((3, n))
        for k, (level, trend, use) in enumerate(((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))):
            for t in range(n):
                fits[k, t] = level + phi * trend
                new = alpha * use * y[t] + (1 - alpha) * fits[k, t]
                trend = beta * (new - level) + (1 - beta) * phi * trend
                level = new
        start = np.linalg.lstsq(fits[1:].T, y - fits[0], rcond=None)[0]
        fitted = fits[0] + start @ fits[1:]
        level, trend = start
        for t in range(n):
            new = alpha * y[t] + (1 - alpha) * fitted[t]
            trend = beta * (new - level) + (1 - beta) * phi * trend
            level = new
        return float(((y - fitted) ** 2).sum()), fitted, float(level), float(trend)

    best, step = (0.3, 0.1, 0.95), np.array([0.3, 0.1, 0.1])
    score = run(*best)[0]
    grid = [(a, b * a, p) for a in (0.05, 0.3, 0.6, 0.9) for b in (0.05, 0.3, 0.8) for p in (0.8, 0.9, 0.98)]
    for g in grid:
        if (s := run(*g)[0]) < score:
            best, score = g, s
    while step.max() > 1e-4:  # pattern search around the best grid point
        better = False
        for k in range(3):
            for sign in (1, -1):
                trial = np.array(best)
                trial[k] += sign * step[k]
                trial[0] = min(max(trial[0], 1e-4), 0.9999)
                trial[1] = min(max(trial[1], 0.0), trial[0])
                trial[2] = min(max(trial[2], 0.8), 0.995)
                if (s := run(*trial)[0]) < score - 1e-12:
                    best, score, better = tuple(trial), s, True
        if not better:
            step /= 2
    _, fitted, level, trend = run(*best)
    return fitted, np.array([level + trend * damped(h, best[2]) for h in range(1, horizon + 1)])


def poisson(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Log-link Poisson regression: mean half deviance plus alpha / 2 * |w|**2, by Newton steps."""
    design = np.column_stack([np.ones(len(y)), x])
    penalty = np.diag([0.0] + [alpha] * x.shape[1])
    beta = np.zeros(design.shape[1])
    beta[0] = np.log(max(float(y.mean()), 1e-8))

    def loss(b: np.ndarray) -> float:
        eta = np.clip(design @ b, -50, 50)
        return float(np.mean(np.exp(eta) - y * eta) + alpha / 2 * (b[1:] ** 2).sum())

    for _ in range(200):
        mu = np.exp(np.clip(design @ beta, -50, 50))
        grad = design.T @ (mu - y) / len(y) + penalty @ beta
        move = np.linalg.solve(design.T @ (design * mu[:, None]) / len(y) + penalty + 1e-10 * np.eye(len(beta)), grad)
        size, now = 1.0, loss(beta)
        while size > 1e-8 and loss(beta - size * move) > now:
            size /= 2
        beta = beta - size * move
        if np.max(np.abs(size * move)) < 1e-9:
            break
    return float(beta[0]), beta[1:]


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    deviation = x.std(axis=0)
    return x.mean(axis=0), np.where(deviation == 0, 1.0, deviation)


def exogenous(x: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Fitted values, forecast, standardised weights and alpha; alpha by the last three years held out."""

    def fit(a: np.ndarray, b: np.ndarray, alpha: float):
        mean, deviation = _standard(a)
        c, w = poisson((a - mean) / deviation, b, alpha)
        return (lambda z: np.exp(np.clip(c + (z - mean) / deviation @ w, -50, 50))), w

    alpha = 10.0
    if len(y) >= 8:
        cut = max(4, len(y) - 3)
        errors = [float(np.sqrt(np.mean((fit(x[:cut], y[:cut], a)[0](x[cut:]) - y[cut:]) ** 2))) for a in ALPHAS]
        alpha = ALPHAS[int(np.argmin(errors))]
    predict, weights = fit(x, y, alpha)
    return predict(x), predict(ahead), weights, alpha


FORECAST = (
    "target string, forecast_year int, horizon int, holt_winters_forecast double, linear_regression_forecast double, "
    "exogenous_regression_forecast double, chosen_forecast double, chosen_forecast_rounded long, chosen_model string, mae double, rmse double, "
    "weights map<string,double>, alpha double"
)


def _series(pdf: pd.DataFrame, horizon: int, features: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values("year")
    past = pdf[pdf["value"].notna()]
    years, y = past["year"].to_numpy(float), past["value"].to_numpy(float)
    if not len(y):
        return pd.DataFrame(columns=[c.split()[0] for c in FORECAST.split(", ")])
    ahead = np.arange(int(years.max()) + 1, int(years.max()) + horizon + 1)
    smooth = len(y) >= 4 and y.sum() != 0
    fitted, holt = holt_damped(y, horizon) if smooth else (np.full(len(y), y.mean()), np.full(horizon, y.mean()))
    c, w = ols(years - years.min(), y)
    line_fit, line = c + w[0] * (years - years.min()), c + w[0] * (ahead - years.min())
    name, chosen, chosen_fit = ("holt_winters", holt, fitted) if smooth else ("linear_regression", line, line_fit)
    more, weights, alpha = np.full(horizon, np.nan), None, None
    future = pdf[pdf["year"].isin(ahead)]
    if features and len(future) == horizon and len(y) >= max(6, len(features) + 3):
        x, z = past[features].to_numpy(float), future[features].to_numpy(float)
        if np.isfinite(x).all() and np.isfinite(z).all():
            chosen_fit, more, w, alpha = exogenous(x, y, z)
            name, chosen, weights = "exogenous_poisson", more, dict(zip(features, np.round(w, 6).tolist(), strict=True))
    error = y - np.maximum(chosen_fit, 0)
    at = lambda v: np.round(np.maximum(v, 0), 4)
    return pd.DataFrame(
        {
            "target": pdf["target"].iloc[0],
            "forecast_year": ahead,
            "horizon": np.arange(1, horizon + 1),
            "holt_winters_forecast": at(holt),
            "linear_regression_forecast": at(line),
            "exogenous_regression_forecast": at(more),
            "chosen_forecast": at(chosen),
            "chosen_forecast_rounded": np.rint(np.maximum(chosen, 0)).astype(int),
            "chosen_model": name,
            "mae": round(float(np.mean(np.abs(error))), 4),
            "rmse": round(float(np.sqrt(np.mean(error**2))), 4),
            "weights": [weights] * horizon,
            "alpha": alpha,
        }
    )


def forecast_series(history: DataFrame, horizon: int, features: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Holt, trend line and, with ``features`` (year and ``columns``, also for the years ahead),
    Poisson forecasts of every target of ``history`` (target, year, value). The best available is chosen:
    Poisson, then Holt, then the line."""
    rows = history.select("target", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
    if features is not None and columns:
        ends = rows.groupBy("target").agg(F.max("year").alias("_end"))
        more = ends.select("target", F.explode(F.sequence(F.col("_end") + 1, F.col("_end") + horizon)).alias("year"), F.lit(None).cast("double").alias("value"))
        # a row per year: as small as the range of years
        rows = rows.unionByName(more).join(features.select("year", *columns), "year", "left")
    return rows.groupBy("target").applyInPandas(partial(_series, horizon=horizon, features=list(columns)), FORECAST)


def trend_line(history: DataFrame, horizon: int, keys: list[str]) -> DataFrame:
    """Ordinary least squares on the year, for each key, without Python: (year, forecast)."""
    fit = history.groupBy(*keys).agg(
        F.regr_slope("value", "year").alias("_w"), F.avg("year").alias("_x"), F.avg("value").alias("_y"), F.max("year").cast("int").alias("_end")
    )
    rows = fit.withColumn("year", F.explode(F.sequence(F.col("_end") + 1, F.col("_end") + horizon)))
    value = F.col("_y") + F.coalesce("_w", F.lit(0.0)) * (F.col("year") - F.col("_x"))
    return rows.select(*keys, "year", F.greatest(value, F.lit(0.0)).alias("forecast"))


def with_interval(forecasts: DataFrame, value: str, rmse: str = "rmse", horizon: str = "horizon") -> DataFrame:
    """lower and upper: 1.96 * rmse * sqrt(horizon) * 0.35 to both sides, not below 0."""
    margin = Z * F.coalesce(F.col(rmse), F.lit(0.0)) * F.sqrt(F.col(horizon)) * 0.35
    return forecasts.withColumns({"lower": F.greatest(F.col(value) - margin, F.lit(0.0)), "upper": F.col(value) + margin})


def high_years(df: DataFrame, value: str, year: str, n: int = 5) -> DataFrame:
    """The n highest years with their rank; ties by year."""
    top = df.orderBy(F.desc(value), F.asc(year)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(value), F.asc(year))))


def _panel_unit(pdf: pd.DataFrame, first: int, last: int, damping: float, cap: float, min_points: int, z: float) -> pd.DataFrame:
    pdf = pdf[pdf["value"].notna() & (pdf["year"] < first)].sort_values("year")
    names = [c.split()[0] for c in PANEL_FORECAST.split(", ")]
    if pdf.empty:
        return pd.DataFrame(columns=names)
    years, values = pdf["year"].to_numpy(float), pdf["value"].to_numpy(float)
    y, x = np.log1p(np.maximum(values, 0)), years - years.min()
    weak, slope, sigma = len(y) < min_points, 0.0, 0.0
    if len(y) >= 2:
        c, w = huber(x, y) if len(y) >= 4 else ols(x, y)
        slope, sigma = float(w[0]), float(np.std(y - c - w[0] * x, ddof=1))
    slope = float(np.clip(slope, -cap, cap))
    if weak:
        slope, sigma = 0.25 * slope, max(sigma, 0.10)
    anchor, base = int(years[-1]), float(y[-1])
    target = np.arange(first, last + 1)
    ahead = target - anchor
    middle = base + slope * np.array([damped(h, damping) for h in ahead])
    spread = z * (sigma + 0.015 * np.maximum(ahead, 1))
    up = lambda v: np.maximum(np.expm1(v), 0.0)
    return pd.DataFrame(
        {
            "unit_id": pdf["unit_id"].iloc[0],
            "metric": pdf["metric"].iloc[0],
            "year": target,
            "value": up(middle),
            "lower95": up(middle - spread),
            "upper95": up(middle + spread),
            "status": "weak_history_forecast" if weak else "forecast",
            "anchor_year": anchor,
            "training_points": len(y),
        }
    )[names]


PANEL_FORECAST = "unit_id string, metric string, year int, value double, lower95 double, upper95 double, status string, anchor_year int, training_points int"


def forecast_panel(
    panel: DataFrame, metrics: list[str], first: int, last: int, damping: float = DAMPING, cap: float = SLOPE_CAP,
    min_points: int = MIN_POINTS, z: float = Z, statuses: Sequence[str] = ("observed", "observed_or_modelled_epoch"),
) -> DataFrame:
    """Damped robust log trend of each unit's metrics, anchored at its latest value, in long form.

    Only rows of the given statuses are learned from. All metrics of a unit are separate groups."""
    each = [
        F.struct(F.lit(m).alias("metric"), F.when(F.coalesce(F.col(f"status_{m}"), F.lit("observed")).isin(list(statuses)), F.col(m).cast("double")).alias("value"))
        for m in metrics
    ]
    rows = panel.select(F.col("unit_id").cast("string").alias("unit_id"), "year", F.inline(F.array(*each))).where("value is not null")
    run = partial(_panel_unit, first=first, last=last, damping=damping, cap=cap, min_points=min_points, z=z)
    return rows.groupBy("unit_id", "metric").applyInPandas(run, PANEL_FORECAST)


def count_forecast(years: np.ndarray, values: np.ndarray, target: Sequence[int], damping: float = COUNT_DAMPING) -> list[int]:
    """Damped robust trend of counts from the latest one, a quarter of the way to the fit."""
    if len(years) < 2:
        return [int(round(values[-1]))] * len(target)
    start, latest = years.min(), int(years.max())
    c, w = huber(years - start, values.astype(float))
    now = float(values[int(np.argmax(years))])
    pull = COUNT_PULL * (c + w[0] * (latest - start) - now)
    return [max(0, int(round(now + float(w[0]) * damped(t - latest, damping) + pull))) for t in target]


def blended_counts(years: np.ndarray, values: np.ndarray, target: Sequence[int], outside: pd.DataFrame | None, columns: Sequence[str]) -> tuple[list[int], str]:
    """``count_forecast``, blended 65 to 35 with a fit on outside indicators (within a quarter of it)
    where the indicators cover the history and all target years."""
    base = count_forecast(years, values, target)
    if outside is None or not columns:
        return base, "damped_huber_trend"
    latest = int(years.max())
    outside = outside.dropna(subset=list(columns)).drop_duplicates("year").set_index("year").sort_index()
    both = [k for k, t in enumerate(years.astype(int)) if t in outside.index]
    if len(both) < max(6, len(columns) + 3) or not {latest, *target} <= set(outside.index):
        return base, "damped_huber_trend"
    origin = years[both].min()

    def design(at: Sequence[int]) -> np.ndarray:
        more = np.log1p(np.maximum(outside.loc[list(at), list(columns)].to_numpy(float), 0))
        return np.column_stack([(np.array(at, float) - origin) / 10, more])

    x = design(years[both].astype(int))
    mean, deviation = _standard(x)
    c, w = huber((x - mean) / deviation, np.log1p(np.maximum(values[both].astype(float), 0)), alpha=1e-3)
    fit = lambda at: c + (design(at) - mean) / deviation @ w
    now, anchor = float(fit([latest])[0]), float(np.log1p(max(float(values[int(np.argmax(years))]), 0)))
    out = []
    for b, t, f in zip(base, target, fit(list(target)), strict=True):
        ahead = max(t - latest, 1)
        value = max(float(np.expm1(anchor + (f - now) * damped(ahead, COUNT_DAMPING) / ahead)), 0.0)
        value = min(max(value, b * (1 - BLEND_CLIP)), b * (1 + BLEND_CLIP))
        out.append(max(0, int(round((1 - BLEND) * b + BLEND * value))))
    return out, "hybrid_damped_huber_trend_external_" + "_".join(columns)


def forecast_counts(panel: DataFrame, counts: list[str], first: int, last: int, outside: DataFrame | None = None, columns: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Count forecasts of each unit (unit_id, year, counts, and ``keys`` kept), with model labels."""
    rows = panel.select(F.col("unit_id").cast("string").alias("unit_id"), "year", *keys, *counts)
    if outside is not None and columns:
        rows = rows.join(outside.select(F.col("unit_id").cast("string").alias("unit_id"), "year", *columns), ["unit_id", "year"], "full_outer")

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        target = list(range(first, last + 1))
        past = pdf[pdf[counts].notna().all(axis=1) & (pdf["year"] < first)]
        if past.empty:
            return pd.DataFrame(columns=names)
        indicators = pdf[["year", *columns]] if columns else None
        out = {"unit_id": past["unit_id"].iloc[0], "year": target} | {k: past[k].iloc[-1] for k in keys}
        for c in counts:
            out[c], out[f"forecast_model_{c}"] = blended_counts(past["year"].to_numpy(), past[c].to_numpy(float), target, indicators, columns)
        return pd.DataFrame(out)[names]

    types = dict(rows.dtypes)
    fields = ["unit_id string", "year int", *(f"{k} {types[k]}" for k in keys), *(f"{c} long, forecast_model_{c} string" for c in counts)]
    names = [f.split()[0] for f in ", ".join(fields).split(", ")]
    return rows.groupBy("unit_id").applyInPandas(unit, ", ".join(fields))


def census_curve(spark: SparkSession, early: int = 2006, late: int = 2016, now: int = 2026, last: int = 2035, value: float = 3_170_000.0, fall: float = 0.038, damping: float = DAMPING) -> DataFrame:
    """A national count between two census years, carried on to ``now`` and damped beyond, in closed form."""
    before = value / (1 - fall)
    rate = float(np.log(value / before)) / (late - early)
    year = F.col("year")
    current = value * float(np.exp(rate * (now - late)))
    count = (
        F.when(year == early, before)
        .when(year == late, value)
        .when(year < late, before * F.exp(rate * (year - early)))
        .when(year <= now, value * F.exp(rate * (year - late)))
        .otherwise(current * F.exp(rate * damped_steps(year - now, damping)))
    )
    status = (
        F.when(year == early, "derived_observed").when(year == late, "observed").when(year < late, "interpolated").when(year <= now, "nowcast").otherwise("forecast")
    )
    years = spark.range(early, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.select("year", F.rint(count).cast("long").alias("natural_village_count"), status.alias("status_natural_village_count"))
