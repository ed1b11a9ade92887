"""Dose models: weighted refits against refits of repeated rows, closed forms and a search, tables with their defined cases."""

import math

import numpy as np
import pandas as pd
import pytest

from sievegrid.operators import dosefits as D
from sievegrid.operators import statistics as stat

DOSES = np.array([0, 10, 25, 50, 100, 250.0])


def curves(seeds=7, holes=True, seed=1):
    rng = np.random.default_rng(seed)
    y = 0.4 * DOSES / (DOSES + 40) + rng.normal(0, 0.05, (seeds, len(DOSES)))
    if holes:
        y[1, 2] = y[3, 5] = y[3, 4] = np.nan
    return y, rng.normal(0.25, 0.05, seeds)


def ones(y):
    return D.dose_sums(y, DOSES, np.ones((1, len(y))))


def test_weights_are_copies():
    y, natural = curves()
    draws = np.random.default_rng(2).integers(0, len(y), (40, len(y)))
    weights = np.stack([np.bincount(d, minlength=len(y)) for d in draws]).astype(float)
    got = D.refits(y, natural, DOSES, weights)
    want = pd.concat([D.refits(y[d], natural[d], DOSES, np.ones((1, len(y)))) for d in draws], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("model", ["log_linear", "isotonic"])
def test_closed_fits_agree_with_fits_of_rows(model):
    y, _ = curves()
    parameters, fitted = D.FITS[model](ones(y))
    want, line = stat.fit_curve(y, DOSES, model.replace("_", "-"))
    assert fitted[0] == pytest.approx(line) and list(parameters[0]) == pytest.approx(list(want))
    count = len(np.unique(np.round(line, 10))) if model == "isotonic" else 1
    assert D.akaike(ones(y), model, fitted)[0] == pytest.approx(stat.akaike(y, line, count))
    full = curves(holes=False)[0]
    assert D.cross_validated(full, DOSES, model) == pytest.approx(stat.cross_validated(full, DOSES, model.replace("_", "-")))


def test_saturating_fit_is_the_best_of_its_bounds():
    exact = np.array([0.3 * DOSES / (DOSES + 40)] * 3)
    assert D.fit_emax(ones(exact))[0][0] == pytest.approx((0.3, 40), rel=1e-5)
    rng = np.random.default_rng(5)
    for k in range(5):
        y = curves(seed=k)[0] if k < 3 else rng.normal(-0.1, 0.3, (4, len(DOSES)))
        s = ones(y)
        (top, half), fitted = D.fit_emax(s)[0][0], D.fit_emax(s)[1]
        assert D.TOPS[0] <= top <= D.TOPS[1] and D.HALVES[0] * 0.999 <= half <= D.HALVES[1] * 1.001
        tried_top, tried_half = rng.uniform(*D.TOPS, 20000), np.exp(rng.uniform(*np.log(D.HALVES), 20000))
        tried = tried_top[:, None] * DOSES / (DOSES + tried_half[:, None])
        squares = np.nansum((y[None] - tried[:, None]) ** 2, axis=(1, 2))
        assert s.left(fitted)[0] <= squares.min() + 1e-9
    linear = np.array([0.05 * DOSES] * 3)  # rises by more than the highest top lets it
    assert D.fit_emax(ones(linear))[0][0, 0] == pytest.approx(5.0)


def test_equivalent_dose_passes_over_unmeasured_doses():
    doses, natural = np.array([0, 25, 50, 100.0]), np.array([0.25, -1, 9, np.nan, 0.1])
    s = D.dose_sums(np.array([[0, 0.1, 0.2, 0.3]]), doses, np.ones((5, 1)))
    assert list(D.equivalents(s, natural)[:3]) == [75.0, 0.0, math.inf] and math.isnan(D.equivalents(s, natural)[3])
    holed = D.dose_sums(np.array([[0, np.nan, 0.2, 0.3]]), doses, np.ones((1, 1)))
    assert D.equivalents(holed, np.array([0.1]))[0] == 25.0
    first = D.dose_sums(np.array([[np.nan, 0.2, 0.2, 0.3]]), doses, np.ones((1, 1)))
    assert D.equivalents(first, np.array([0.1]))[0] == 25.0


def long(name, y, natural):
    rows = [(name, s, int(d), float(y[s, i])) for s in range(len(y)) for i, d in enumerate(DOSES) if not math.isnan(y[s, i])]
    return rows + [(name, s, D.NATURAL, float(v)) for s, v in enumerate(natural) if not math.isnan(v)]


SCHEMA = "block string, seed long, dose_code int, gain double"


def test_intervals_are_those_of_the_draws(spark):
    y, natural = curves()
    got = D.dose_model_table(spark.createDataFrame(long("a", y, natural), SCHEMA), ["block"], draws=300, block=64).toPandas().iloc[0]
    draws = [np.random.default_rng([1, d]).integers(0, len(y), len(y)) for d in range(300)]
    each = pd.concat([D.refits(y[d], natural[d], DOSES, np.ones((1, len(y)))) for d in draws], ignore_index=True)
    own = D.refits(y, natural, DOSES, np.ones((1, len(y)))).iloc[0]
    ends = lambda c: list(np.nanquantile(c, [0.025, 0.975]))
    for m in ("emax", "isotonic"):
        assert got[f"{m}_gain"] == pytest.approx(own["aic_log_linear"] - own[f"aic_{m}"])
        assert [got[f"{m}_gain_low"], got[f"{m}_gain_high"]] == pytest.approx(ends(each["aic_log_linear"] - each[f"aic_{m}"]), rel=1e-4)
    for c in ("log_slope", "emax_top", "ed50"):
        assert [got[c], got[f"{c}_low"], got[f"{c}_high"]] == pytest.approx([own[c], *ends(each[c])], rel=1e-4)
    assert [got["equivalent_low"], got["equivalent_high"]] == pytest.approx(ends(each["equivalent"]), rel=1e-6)
    lowest = each[[f"aic_{m}" for m in D.MODELS]].idxmin(axis=1)
    for m in D.MODELS:
        assert got[f"{m}_chosen"] == pytest.approx((lowest == f"aic_{m}").mean(), abs=1 / 300)
    assert got["units"] == 7 and got["ed50_beyond_top"] == pytest.approx((each["ed50"] > 250).mean()) and bool(got["ed50_identified"]) is bool(ends(each["ed50"])[1] <= 250)
    again = D.dose_model_table(spark.createDataFrame(long("a", y, natural)[::-1], SCHEMA).repartition(3), ["block"], draws=300, block=50).toPandas().iloc[0]
    assert again.drop("block").astype(float).to_numpy() == pytest.approx(got.drop("block").astype(float).to_numpy(), nan_ok=True)


def test_defined_cases_of_the_table(spark):
    y, natural = curves(holes=False)
    flat = np.zeros((4, len(DOSES)))
    rows = [
        *long("no natural", y, []),
        *long("never", y, natural + 9),
        *long("one", y[:1], natural[:1]),
        *long("flat", flat, np.zeros(4)),
        *long("repeated", y, natural), *long("repeated", y, natural),
        *long("plain", y, natural), ("plain", 0, 10, None), ("plain", None, 10, 5.0), ("plain", 0, None, 5.0), ("plain", 0, 25, math.nan),
        ("only natural", 1, D.NATURAL, 0.3), (None, 1, 0, 0.0), (None, 1, 10, 0.2),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"own": D.F.lit("clash"), "units": D.F.lit(7)})
    got = D.dose_model_table(table, ["block"], draws=40, block=16).toPandas()
    by = {k if isinstance(k, str) else None: r for k, r in zip(got["block"], got.to_dict("records"), strict=True)}
    assert set(by) == {"no natural", "never", "one", "flat", "repeated", "plain", None}
    for c in ("natural_gain", "equivalent_dose", "equivalent_low"):
        assert math.isnan(by["no natural"][c])
    assert [by["never"][c] for c in ("equivalent_dose", "equivalent_low", "equivalent_high", "equivalent_beyond_top")] == [math.inf] * 3 + [1.0]
    assert by["one"]["units"] == 1 and math.isnan(by["one"]["cv_emax"]) and by["one"]["log_slope_low"] == pytest.approx(by["one"]["log_slope"])
    assert math.isnan(by["flat"]["aic_emax"]) and by["flat"]["equivalent_dose"] == 0
    for c in got.columns.drop(["block"]):
        assert by["repeated"][c] == pytest.approx(by["plain"][c], nan_ok=True), c
    assert D.dose_model_table(table.limit(0), ["block"], draws=4).count() == 0
    assert {r["block"] for r in D.dose_model_table(table, ["block"], draws=4, least=4).collect()} == {"no natural", "never", "flat", "repeated", "plain"}
