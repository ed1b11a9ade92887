"""Choice among dose models with intervals: resamplings of seeds as weighted refits, all of a block from its sums by dose."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.diagnostics import NATURAL

MODELS = ("log_linear", "emax", "isotonic")
# Bounds of the saturating curve's top and half dose, the half dose that counts as at its bound, decimals that tell steps apart.
TOPS = (-1.0, 5.0)
HALVES = (1e-3, 1e5)
AT_BOUND = 9e4
DECIMALS = 10
#: Stands for an infinite equivalent dose where quantiles interpolate.
NEVER = 1e300


@dataclass(frozen=True)
class DoseSums:
    """What refits need of batches of weighted curves. n, total: (batch, doses) weights and weighted sums; square: (batch,)."""

    doses: np.ndarray
    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    def means(self) -> np.ndarray:
        return np.divide(self.total, self.n, out=np.full(self.n.shape, np.nan), where=self.n > 0)

    def left(self, fitted: np.ndarray) -> np.ndarray:
        """(batch,): weighted squares of what a fit leaves, a fit that leaves nothing but rounding as 0."""
        inside = self.square - np.nansum(self.total * self.means(), axis=1)
        found = np.maximum(inside, 0) + np.where(self.n > 0, self.n * (self.means() - fitted) ** 2, 0).sum(1)
        return np.where(found > 1e-12 * self.square, found, 0.0)


def dose_sums(curves: np.ndarray, doses: np.ndarray, weights: np.ndarray) -> DoseSums:
    """curves: seeds by doses, NaN where unmeasured; weights: (batch, seeds)."""
    known = ~np.isnan(curves)
    y = np.where(known, curves, 0.0)
    return DoseSums(doses, weights @ known, weights @ y, weights @ (y * y).sum(1))


def fit_log_linear(s: DoseSums) -> tuple[np.ndarray, np.ndarray]:
    z = np.log1p(s.doses)
    below = s.n @ (z * z)
    slope = np.divide(s.total @ z, below, out=np.full(len(s.n), np.nan), where=below > 0)
    return slope[:, None], slope[:, None] * z


def fit_emax(s: DoseSums, grid: int = 400, zooms: int = 5, points: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """(top, half dose): the best top of a half dose is closed, so only half doses are searched: a whole grid, then around its best."""
    halves = np.repeat(np.geomspace(*HALVES, grid)[None], len(s.n), axis=0)
    rows = np.arange(len(s.n))
    for _ in range(zooms + 1):
        shape = s.doses / (halves[:, :, None] + s.doses)
        up, down = np.einsum("bd,bhd->bh", s.total, shape), np.einsum("bd,bhd->bh", s.n, shape * shape)
        top = np.clip(np.divide(up, down, out=np.zeros_like(up), where=down > 0), *TOPS)
        best = (top * top * down - 2 * top * up).argmin(1)  # the squares of the response are the same at every half dose
        at, half = top[rows, best], halves[rows, best]
        low, high = halves[rows, np.maximum(best - 1, 0)], halves[rows, np.minimum(best + 1, halves.shape[1] - 1)]
        halves = np.geomspace(low, high, points, axis=1)
    at = np.where(s.n.sum(1) > 0, at, np.nan)
    return np.column_stack([at, np.where(np.isnan(at), np.nan, half)]), at[:, None] * s.doses / (half[:, None] + s.doses)


def fit_isotonic(s: DoseSums) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit: the highest, over starts before a dose, of the lowest mean over ends after it; unmeasured doses have none."""
    d = len(s.doses)
    n, total = (np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1) for x in (s.n, s.total))
    weight = n[:, None, 1:] - n[:, :-1, None]
    mean = np.divide(total[:, None, 1:] - total[:, :-1, None], weight, out=np.full(weight.shape, np.inf), where=weight > 0)
    fitted = np.stack([mean[:, : i + 1, i:].min(2).max(1) for i in range(d)], axis=1)
    fitted = np.where(s.n > 0, fitted, np.nan)
    return np.empty((len(fitted), 0)), fitted


FITS = dict(zip(MODELS, (fit_log_linear, fit_emax, fit_isotonic), strict=True))


def parameter_counts(model: str, fitted: np.ndarray) -> np.ndarray:
    """(batch,): a rising fit counts its steps."""
    if model != "isotonic":
        return np.full(len(fitted), MODELS.index(model) + 1.0)
    return np.array([len(np.unique(np.round(f[~np.isnan(f)], DECIMALS))) for f in fitted], dtype=float)


def akaike(s: DoseSums, model: str, fitted: np.ndarray) -> np.ndarray:
    """(batch,): NaN where the fit leaves nothing."""
    size, left = s.n.sum(1), s.left(fitted)
    found = np.log(np.divide(left, size, out=np.ones_like(size), where=left > 0))
    return np.where(left > 0, size * found + 2 * (parameter_counts(model, fitted) + 1), np.nan)


def equivalents(s: DoseSums, natural: np.ndarray) -> np.ndarray:
    """(batch,): the dose at which the means first reach the natural gain, on the line from the last measured dose; 0 below the first, infinity if never."""
    curve = s.means()
    found = np.where(natural <= curve[:, 0], 0.0, np.nan)
    y, d = curve[:, 0].copy(), np.full(len(curve), s.doses[0])
    for i in range(1, len(s.doses)):
        known = ~np.isnan(curve[:, i])
        hit = np.isnan(found) & known & (curve[:, i] >= natural)
        rise = np.where(hit & ~np.isnan(y), curve[:, i] - y, 1.0)
        line = d + (natural - y) / np.where(rise == 0, 1.0, rise) * (s.doses[i] - d)
        found = np.where(hit, np.where(np.isnan(y), s.doses[i], line), found)
        y, d = np.where(known, curve[:, i], y), np.where(known, s.doses[i], d)
    return np.where(np.isnan(natural), np.nan, np.where(np.isnan(found), np.inf, found))


def cross_validated(curves: np.ndarray, doses: np.ndarray, model: str) -> float:
    """Mean over seeds of the squared error of a seed under the fit of the others, all of them in one batch."""
    others = dose_sums(curves, doses, 1.0 - np.eye(len(curves)))
    squares = (curves - FITS[model](others)[1]) ** 2
    known = ~np.isnan(squares)
    each = np.divide(np.where(known, squares, 0).sum(1), known.sum(1), out=np.full(len(curves), np.nan), where=known.any(1))
    return float(each[~np.isnan(each)].mean()) if (~np.isnan(each)).any() else np.nan


def refits(curves: np.ndarray, natural: np.ndarray, doses: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    """A row a row of weights: AIC of each model, parameters, natural and top gain, equivalent dose."""
    s, known = dose_sums(curves, doses, weights), ~np.isnan(natural)
    size = weights @ known
    gain = np.divide(weights @ np.where(known, natural, 0.0), size, out=np.full(len(weights), np.nan), where=size > 0)
    out = {"natural_gain": gain, "top_dose_gain": s.means()[:, -1], "equivalent": equivalents(s, gain)}
    for model, fit in FITS.items():
        parameters, fitted = fit(s)
        out[f"aic_{model}"] = akaike(s, model, fitted)
        for name, column in zip({"log_linear": ["log_slope"], "emax": ["emax_top", "ed50"]}.get(model, []), parameters.T, strict=True):
            out[name] = column
    return pd.DataFrame(out)


def dose_model_table(levels: DataFrame, keys: list[str], draws: int = 2000, block: int = 500, seed: int = 1, level: float = 0.95, least: int = 1, least_cross: int = 3) -> DataFrame:
    """A row a group of ``keys``: three dose models of its curves, one a seed, with intervals over resampled seeds.

    ``levels`` holds (keys, seed, dose_code, gain), NATURAL the code of what all that is available gains. Gains of one seed and dose are
    averaged; null gains, seeds and doses take no part. Groups of fewer than ``least`` seeds with a measured dose give no row, cross-validated
    errors take ``least_cross`` seeds, and what can't be told is null: intervals of one seed are its own value, a model that leaves
    no error has no AIC, no natural gain no equivalent dose. An equivalent dose beyond the top dose is infinite.

    ``*_gain`` is how much lower a model's AIC lies than the log-linear one's; ``*_chosen`` the share of draws in which it is the lowest.
    Each task refits a block of draws from sums of at most seeds by doses values.
    """
    clean = levels.where(F.col("gain").isNotNull() & ~F.isnan("gain") & F.col("seed").isNotNull() & F.col("dose_code").isNotNull())
    inner = {f"key_{i}": k for i, k in enumerate(keys)}  # keys may be called as what is computed here
    cells = clean.select(*[F.col(k).alias(i) for i, k in inner.items()], "seed", "dose_code", "gain").groupBy(*inner, "seed", "dose_code").agg(F.avg(F.col("gain").cast("double")).alias("gain"))
    count = -(-draws // block)
    parts = max(count + 1, int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be coalesced
    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count)))).repartition(parts, *inner, "block")
    kinds = dict(levels.dtypes)
    numbers = ["natural_gain", "top_dose_gain", "equivalent", *[f"aic_{m}" for m in MODELS], "log_slope", "emax_top", "ed50", *[f"cv_{m}" for m in MODELS]]
    schema = {**{i: kinds[k] for i, k in inner.items()}, "own": "boolean", "enough": "boolean", "units": "long", "top_dose": "double", **dict.fromkeys(numbers, "double")}

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="seed", columns="dose_code", values="gain").sort_index()
        doses = np.array(sorted(c for c in wide.columns if c != NATURAL), dtype=float)
        curves = wide[[c for c in sorted(wide.columns) if c != NATURAL]].to_numpy(float)
        natural = wide[NATURAL].to_numpy(float) if NATURAL in wide.columns else np.full(len(wide), np.nan)
        units, b = len(wide), int(rows["block"].iloc[0])
        named = {**{i: rows[i].iloc[0] for i in inner}, "own": b == 0, "units": units}
        if (~np.isnan(curves)).any(1).sum() < max(least, 1):
            return pd.DataFrame([{**dict.fromkeys(schema, np.nan), **named, "enough": False}])
        weights = np.ones((1, units))
        if b > 0:
            chosen = [np.random.default_rng([seed, d]).integers(0, units, units) for d in range((b - 1) * block, min(b * block, draws))]
            weights = np.stack([np.bincount(c, minlength=units) for c in chosen]).astype(float)
        weights, same = np.unique(weights, axis=0, return_inverse=True)  # few seeds are drawn alike again and again
        out = refits(curves, natural, doses, weights).iloc[same.ravel()].reset_index(drop=True)
        for model in MODELS:
            out[f"cv_{model}"] = cross_validated(curves, doses, model) if b == 0 and units >= least_cross else np.nan
        return out.assign(**named, enough=True, top_dose=doses[-1])

    fitted = blocks.groupBy(*inner, "block").applyInPandas(reduce, ", ".join(f"{c} {kind}" for c, kind in schema.items()))
    fitted = fitted.where("enough").select(*inner, "own", "units", "top_dose", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in numbers])
    lowest = F.least(*[f"aic_{m}" for m in MODELS])
    return fitted.groupBy(*inner).agg(*_summary((1 - level) / 2, lowest)).withColumnsRenamed(inner)


def _summary(tail: float, lowest: Column) -> list[Column]:
    own = lambda c: F.max(F.when(F.col("own"), c))
    drawn = lambda c: F.when(~F.col("own"), c)
    share = lambda c: F.avg(drawn(c.cast("double")))
    ends = lambda c: [F.percentile(drawn(c), F.lit(p)) for p in (tail, 1 - tail)]
    bounded = lambda name, c: [own(c).alias(name), *[e.alias(f"{name}_{w}") for e, w in zip(ends(c), ("low", "high"), strict=True)]]
    out = [own(F.col("units")).alias("units"), *[own(F.col(f"{what}_{m}")).alias(f"{what}_{m}") for what in ("aic", "cv") for m in MODELS]]
    for model in MODELS[1:]:
        out += bounded(f"{model}_gain", F.col("aic_log_linear") - F.col(f"aic_{model}"))
    out += [share(F.col(f"aic_{m}") == lowest).alias(f"{m}_chosen") for m in MODELS]
    for name in ("log_slope", "emax_top", "ed50"):
        out += bounded(name, F.col(name))
    at_bound, high = share(F.col("ed50") > AT_BOUND), ends(F.col("ed50"))[1]
    out += [share(F.col("ed50") > F.col("top_dose")).alias("ed50_beyond_top"), at_bound.alias("ed50_at_bound"), ((high <= F.max("top_dose")) & (at_bound < tail)).alias("ed50_identified")]
    out += [own(F.col(c)).alias(c) for c in ("natural_gain", "top_dose_gain")]
    finite = F.when(F.col("equivalent").isNotNull(), F.least("equivalent", F.lit(NEVER)))
    whole = lambda c: F.when(c > NEVER / 1e100, F.lit(float("inf"))).otherwise(c)
    out += [own(F.col("equivalent")).alias("equivalent_dose"), *[whole(e).alias(f"equivalent_{w}") for e, w in zip(ends(finite), ("low", "high"), strict=True)]]
    return [*out, share(F.col("equivalent") > F.col("top_dose")).alias("equivalent_beyond_top")]
