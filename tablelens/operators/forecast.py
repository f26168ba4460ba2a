"""Forecast tournament: many series in parallel, one task per series.

Three models compete on the last fifth of each series: ARIMA(1,1,1), the same
with a weekly season, and additive exponential smoothing.  Coefficients are
fitted by conditional least squares over a shrinking box of candidates, all
candidates advancing together through the series.  A series holds one value
per calendar day, so a group is small whatever the size of the table.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Season, split, band and candidate order.
SEASON = 7
TRAIN_SHARE = 0.8
BAND_Z = 1.96
MIN_POINTS = 6
MODELS = ("ARIMA", "SARIMA", "ETS")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def search(loss, low: list[float], high: list[float], points: int = 160, rounds: int = 4) -> np.ndarray:
    """Minimise a vectorised loss by sampling a box and shrinking it around the best point."""
    rng = np.random.default_rng(7)
    low, high = np.array(low), np.array(high)
    best, best_loss, box_low, box_high = (low + high) / 2, math.inf, low, high
    for _ in range(rounds):
        tried = np.vstack([best, rng.uniform(box_low, box_high, size=(points, len(low)))])
        with np.errstate(all="ignore"):
            losses = np.nan_to_num(loss(tried), nan=math.inf, posinf=math.inf)
        at = int(np.argmin(losses))
        if losses[at] < best_loss:
            best, best_loss = tried[at], losses[at]
        reach = (box_high - box_low) * 0.2
        box_low, box_high = np.maximum(low, best - reach), np.minimum(high, best + reach)
    if not math.isfinite(best_loss):
        raise ValueError("no usable fit")
    return best


class Arima:
    """ARIMA(1,1,1), with a (1,1,1) weekly season on request."""

    def __init__(self, seasonal: bool):
        self.seasonal = seasonal

    def _terms(self, c: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(lag, weight of values, weight of errors) for each row of coefficients."""
        phi, theta = c[:, 0], c[:, 1]
        if not self.seasonal:
            return [(1, phi, theta)]
        s_phi, s_theta = c[:, 2], c[:, 3]
        return [(1, phi, theta), (SEASON, s_phi, s_theta), (SEASON + 1, -phi * s_phi, theta * s_theta)]

    def _errors(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        terms, e = self._terms(c), np.zeros((len(w), len(c)))
        for t in range(terms[-1][0], len(w)):
            guess = sum(a * w[t - lag] + m * e[t - lag] for lag, a, m in terms)
            e[t] = w[t] - guess
        return e

    def _difference(self, y: np.ndarray) -> np.ndarray:
        w = np.diff(y)
        return w[SEASON:] - w[:-SEASON] if self.seasonal else w

    def fit(self, y: np.ndarray) -> "Arima":
        self.y, w = y, self._difference(y)
        size = 4 if self.seasonal else 2
        if len(w) < 2 * size + (SEASON + 1 if self.seasonal else 1):
            raise ValueError("series too short")
        self.c = search(lambda c: (self._errors(w, c) ** 2).sum(axis=0), [-0.98] * size, [0.98] * size)[None, :]
        self.w, self.e = w, self._errors(w, self.c)[:, 0]
        used = len(w) - self._terms(self.c)[-1][0]
        self.var = float((self.e**2).sum() / used)
        spread = used * math.log(self.var) if self.var > 0 else 0.0
        self.aic, self.bic = spread + 2 * size, spread + size * math.log(used)
        return self

    def _extend(self, w: np.ndarray, e: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
        w, e, y = list(w), list(e), list(y)
        steps_done = np.diff(y).tolist()
        for _ in range(steps):
            step = sum(
                float(a[0]) * w[-lag] + float(m[0]) * e[-lag] for lag, a, m in self._terms(self.c) if lag <= len(w)
            )
            w.append(step)
            e.append(0.0)
            steps_done.append(step + (steps_done[-SEASON] if self.seasonal else 0.0))
            y.append(y[-1] + steps_done[-1])
        return np.array(y[-steps:])

    def forecast(self, steps: int) -> np.ndarray:
        return self._extend(self.w, self.e, self.y, steps)

    def margins(self, steps: int) -> np.ndarray:
        """1.96 deviations of the forecast error, from the answer to one unit shock."""
        quiet = np.zeros(SEASON + 2)
        w, e, y = quiet.copy(), quiet.copy(), np.zeros(SEASON + 3)
        w[-1] = e[-1] = y[-1] = 1.0
        answer = np.concatenate([[1.0], self._extend(w, e, y, steps)[: steps - 1]])
        return BAND_Z * np.sqrt(self.var * np.cumsum(answer**2))


class Smoothing:
    """Additive exponential smoothing with trend, and a weekly season given two full weeks."""

    def _run(self, y: np.ndarray, c: np.ndarray):
        alpha, beta = c[:, 0], c[:, 1]
        errors = np.zeros((len(y), len(c)))
        if self.seasonal:
            gamma = c[:, 2]
            level = np.full(len(c), y[:SEASON].mean())
            slope = np.full(len(c), (y[SEASON : 2 * SEASON].mean() - y[:SEASON].mean()) / SEASON)
            season = [np.full(len(c), v) for v in y[:SEASON] - y[:SEASON].mean()]
        else:
            gamma = np.zeros(len(c))
            level, slope = np.full(len(c), y[0]), np.full(len(c), y[1] - y[0])
            season = [np.zeros(len(c))] * SEASON
        for t, value in enumerate(y):
            cycle = season[t % SEASON]
            errors[t] = value - (level + slope + cycle)
            fresh = alpha * (value - cycle) + (1 - alpha) * (level + slope)
            slope = beta * (fresh - level) + (1 - beta) * slope
            if self.seasonal:
                season[t % SEASON] = gamma * (value - fresh) + (1 - gamma) * cycle
            level = fresh
        return errors, level, slope, season

    def fit(self, y: np.ndarray) -> "Smoothing":
        self.seasonal = len(y) >= 2 * SEASON
        size = 3 if self.seasonal else 2
        best = search(lambda c: (self._run(y, c)[0] ** 2).sum(axis=0), [0.0] * size, [1.0] * size)
        errors, level, slope, season = self._run(y, best[None, :])
        self.n, self.level, self.slope = len(y), float(level[0]), float(slope[0])
        self.season = [float(s[0]) for s in season]
        self.sigma = float(np.std(errors[:, 0]))
        spread = len(y) * math.log(self.sigma**2) if self.sigma > 0 else 0.0
        self.aic, self.bic = spread + 2 * size, spread + size * math.log(len(y))
        return self

    def forecast(self, steps: int) -> np.ndarray:
        ahead = np.arange(1, steps + 1)
        cycle = np.array([self.season[(self.n + i) % SEASON] for i in range(steps)])
        return self.level + self.slope * ahead + cycle

    def margins(self, steps: int) -> np.ndarray:
        return BAND_Z * self.sigma * np.sqrt(np.arange(1, steps + 1))


def new_model(name: str):
    return Smoothing() if name == "ETS" else Arima(seasonal=name == "SARIMA")


def percentage_error(actual: np.ndarray, guess: np.ndarray) -> float:
    """Mean absolute percentage error over non-zero actuals."""
    seen = actual != 0
    if not seen.any():
        return math.inf
    return float(np.mean(np.abs((actual[seen] - guess[seen]) / actual[seen])) * 100)


def backtest(y: np.ndarray) -> dict[str, dict]:
    """Error, AIC and BIC of every model that can be fitted on the first 80 %."""
    cut = int(len(y) * TRAIN_SHARE)
    train, test = y[:cut], y[cut:]
    out = {}
    for name in MODELS:
        try:
            model = new_model(name).fit(train)
            guess = model.forecast(len(test))
        except (ValueError, IndexError, FloatingPointError):
            continue
        out[name] = {"mape": percentage_error(test, guess), "aic": model.aic, "bic": model.bic}
    return out


def best_of(scores: dict[str, dict]) -> str | None:
    usable = {k: v["mape"] for k, v in scores.items() if math.isfinite(v["mape"])}
    return min(usable, key=usable.get, default=None)


def _groups(series: DataFrame, keys: list[str]):
    """Series grouped by key; a keyless table is one series of calendar days."""
    return series.groupBy(*keys) if keys else series.groupBy(F.lit(0).alias("__all"))


def _schema(series: DataFrame, keys: list[str], rest: str) -> str:
    parts = [f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys]
    return ", ".join([*parts, rest])


def tournament(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series and model: backtest error, AIC, BIC, and whether it won."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds")["y"].to_numpy(dtype=float)
        scores = backtest(y) if len(y) >= MIN_POINTS else {}
        winner = best_of(scores)
        head = {k: pdf[k].iloc[0] for k in keys}
        rows = [
            {**head, "model": m, **s, "points": len(y), "zero_actuals": int((y[int(len(y) * TRAIN_SHARE) :] == 0).sum()), "is_best": m == winner}
            for m, s in scores.items()
        ]
        return pd.DataFrame(rows, columns=[*keys, "model", "mape", "aic", "bic", "points", "zero_actuals", "is_best"])

    rest = "model string, mape double, aic double, bic double, points int, zero_actuals int, is_best boolean"
    return _groups(series, keys).applyInPandas(run, _schema(series, keys, rest))


def forecast(series: DataFrame, keys: list[str], steps: int = 30) -> DataFrame:
    """The winning model of each series, refitted on all of it, with 95 % bands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = pdf["y"].to_numpy(dtype=float)
        columns = [*keys, "model", "step", "ds", "yhat", "lower", "upper"]
        if len(y) < MIN_POINTS:
            return pd.DataFrame(columns=columns)
        name = best_of(backtest(y))
        try:
            model = new_model(name or "ETS").fit(y)
            yhat = model.forecast(steps)
            margin = model.margins(steps)
            lower, upper = yhat - margin, yhat + margin
        except (ValueError, IndexError, FloatingPointError):
            name = "Extrapolation"
            drift = float(np.mean(np.diff(y[-10:]))) if len(y) > 10 else 0.0
            yhat = y[-1] + drift * np.arange(1, steps + 1)
            lower, upper = yhat * 0.9, yhat * 1.1
        last = pd.Timestamp(pdf["ds"].iloc[-1])
        out = {k: pdf[k].iloc[0] for k in keys}
        out |= {
            "model": name or "ETS",
            "step": np.arange(1, steps + 1, dtype="int32"),
            "ds": [(last + pd.Timedelta(days=i)).date() for i in range(1, steps + 1)],
        }
        finite = {n: np.where(np.isfinite(v), v, 0.0) for n, v in (("yhat", yhat), ("lower", lower), ("upper", upper))}
        return pd.DataFrame({**out, **finite}, columns=columns)

    rest = "model string, step int, ds date, yhat double, lower double, upper double"
    return _groups(series, keys).applyInPandas(run, _schema(series, keys, rest))
