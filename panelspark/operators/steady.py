"""Steady state of a two-sector economy for every row of a parameter table.

The equilibrium conditions reduce to one scalar equation in log consumption,

    e^x + a1 e^(-k1 x) + a2 e^(-k2 x) = 0,

whose coefficients are closed forms of the parameters, written as Columns.  Only
the root itself is found in an Arrow batch: the bracket grows from the edge where regular
hours vanish (or from zero where there is none) until the sign changes, then 60 bisection
steps run over whole columns.  (The same loop as an SQL lambda is interpreted and
measured 30 times slower; unrolled Newton steps overflow the JIT's method size.)  The
functions of this module are projections without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters a row must carry, and the calibrated ones with their values.
PARAMS = [
    "beta", "sigma", "B_0", "B_1", "gamma_ss", "tau_c_ss", "tau_h_ss", "tau_s_ss", "s",
    "alpha", "delta_k", "alpha_u", "phi", "xi", "p_ss",
]
CALIBRATED = {
    "beta": 0.997, "sigma": 0.99, "B_0": 81.74, "B_1": 300.0, "gamma_ss": 1.00,
    "tau_c_ss": 0.25, "tau_h_ss": 0.23, "tau_s_ss": 0.23, "s": 1.70,
}

# Reported variables, in report order.
VARIABLES = ["y", "y_m", "y_u", "underground_share", "c", "inv", "G_c", "G_h", "G_s", "TE", "n_m", "n_u"]
EXTRA = ["w_m", "w_u", "utility"]

_STEPS = 60
_FAR = 700.0        # log consumption at which exp leaves the range of a double; the only end of a search


def _steps(df: DataFrame, *steps: dict) -> DataFrame:
    """Add columns in order; a step may use the columns of the steps before it."""
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    return df


def _as_double(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({n: F.col(n).cast("double") for n in PARAMS if kinds[n] != "double"})


def _power(base: str, expo: str) -> str:
    """Power of a positive base; null otherwise."""
    return f"CASE WHEN {base} > 0 THEN pow({base}, {expo}) END"


def _emit(df: DataFrame, prefix: str, out: dict) -> DataFrame:
    """Add the outputs through a one-element ``inline`` and drop the working columns.

    The generator keeps the optimizer from substituting the outputs' definitions
    into later filters: a test on revenue would otherwise unfold, step by step,
    into a predicate too large to compile.
    """
    kept = [c for c in df.columns if not c.startswith("_t_") and c not in {prefix + k for k in out}]
    row = F.struct(*[F.expr(v).alias(prefix + k) for k, v in out.items()])
    return df.select(*kept, F.inline(F.array(row)))


def _technology(df: DataFrame) -> DataFrame:
    """Ratios that do not depend on consumption (per hour or per unit of capital).

    ``kap_m`` and ``kap_u`` are the resources absorbed per hour in each sector, net of output.
    """
    missing = " OR ".join(f"{n} IS NULL OR isnan({n})" for n in PARAMS)
    return _steps(
        _as_double(df),
        {"_t_null": missing,
         "_t_r_u": "try_divide(gamma_ss, beta) - 1 + delta_k"},
        {"_t_r_m": "try_divide(_t_r_u, 1 - tau_h_ss)"},
        {"_t_ykm": "try_divide(_t_r_m, (1 - tau_c_ss) * (1 - alpha))",
         "_t_yku": "try_divide(_t_r_u, (1 - p_ss * s * tau_c_ss) * (1 - alpha_u))"},
        {"_t_hkm": "try_divide(" + _power("_t_ykm", "try_divide(1D, alpha)") + ", gamma_ss)",
         "_t_hku": "try_divide(" + _power("_t_yku", "try_divide(1D, alpha_u)") + ", gamma_ss)"},
        {"_t_ym": "try_divide(_t_ykm, _t_hkm)", "_t_yu": "try_divide(_t_yku, _t_hku)"},
        {"_t_w_m": "try_divide(alpha * _t_ym * (1 - tau_c_ss), 1 + tau_s_ss - tau_c_ss)",
         "_t_w_u": "alpha_u * _t_yu",
         "_t_inv_m": "try_divide(gamma_ss - 1 + delta_k, _t_hkm)",
         "_t_inv_u": "try_divide(gamma_ss - 1 + delta_k, _t_hku)"},
        {"_t_net": "(1 - tau_h_ss) * _t_w_m",
         "_t_gap": "_t_w_u - (1 - tau_h_ss) * _t_w_m",
         "_t_kap_m": "_t_inv_m + tau_h_ss * (_t_w_m + try_divide(_t_r_m, _t_hkm)) + tau_c_ss * (_t_ym - _t_w_m) "
                     "+ tau_s_ss * _t_w_m - _t_ym",
         "_t_kap_u": "_t_inv_u + tau_c_ss * p_ss * s * (_t_yu - _t_w_u) - _t_yu"})


@F.pandas_udf(T.DoubleType())
def _root(a1: pd.Series, k1: pd.Series, a2: pd.Series, k2: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Root in log consumption between ``low`` and ``high`` (null: open), or null where the sign never changes."""
    a1, k1, a2, k2, low, high = (v.to_numpy(dtype=float, copy=True) for v in (a1, k1, a2, k2, low, high))

    def f(x):
        return np.exp(x) + a1 * np.exp(-k1 * x) + a2 * np.exp(-k2 * x)

    with np.errstate(all="ignore"):
        start = np.where(np.isnan(low), np.where(np.isnan(high), 0.0, high), low)
        lo, hi, step = start.copy(), start.copy(), 1.0
        while step < 2 * _FAR:    # open ends move outwards until the sign is right there
            hi = np.where(np.isnan(high) & ~(f(hi) > 0), np.minimum(start + step, _FAR), hi)
            lo = np.where(np.isnan(low) & ~(f(lo) < 0), np.maximum(start - step, -_FAR), lo)
            step *= 2
        bracket = (f(lo) < 0) & (f(hi) > 0)
        for _ in range(_STEPS):
            mid = (lo + hi) / 2
            neg = f(mid) < 0
            lo, hi = np.where(neg, mid, lo), np.where(neg, hi, mid)
    return pd.Series(np.where(bracket, (lo + hi) / 2, np.nan))


def _solve(df: DataFrame) -> DataFrame:
    """Needs ``_t_a1 _t_k1 _t_a2 _t_k2 _t_lo _t_hi _t_idle``; adds ``_t_x`` and ``_t_status``.

    ``_t_idle`` marks rows in which no consumption leaves regular hours.
    """
    inputs = [F.expr(f"CASE WHEN NOT _t_null THEN {c} END") for c in ("_t_a1", "_t_k1", "_t_a2", "_t_k2", "_t_lo", "_t_hi")]
    return _steps(df.withColumn("_t_x", _root(*inputs)), {"_t_status": """CASE
        WHEN _t_null THEN 'null_param'
        WHEN _t_gap IS NULL OR _t_kap_m IS NULL OR _t_kap_u IS NULL THEN 'bad_param'
        WHEN _t_gap <= 0 OR _t_idle THEN 'no_interior'
        WHEN _t_hi IS NOT NULL AND (_t_x IS NULL OR isnan(_t_x)) THEN 'no_interior'
        WHEN _t_x IS NULL OR isnan(_t_x) THEN 'no_bracket'
        ELSE 'ok' END"""})


def steady_state(params: DataFrame, prefix: str = "") -> DataFrame:
    """Add the steady state of every row; failed rows get nulls and a ``status``.

    ``params`` carries the columns of ``PARAMS``.  ``prefix`` names the outputs
    (``base_`` keeps a baseline solution beside a scenario solution).
    """
    df = _steps(
        _technology(params),
        {"_t_hours_u": _power("try_divide(_t_gap, B_1)", "try_divide(1D, phi)"),
         "_t_hours": _power("try_divide(_t_net, B_0)", "try_divide(1D, xi)"),
         "_t_k1": "try_divide(sigma, xi)",
         "_t_k2": "try_divide(sigma, phi)"},
        # consumption at which regular hours reach zero: a lower end for k2 > k1 (phi < xi), an upper end for k2 < k1
        {"_t_a1": "_t_kap_m * _t_hours",
         "_t_a2": "(_t_kap_u - _t_kap_m) * _t_hours_u",
         "_t_idle": "coalesce(_t_k1 = _t_k2 AND _t_hours <= _t_hours_u, false)",
         "_t_edge": "CASE WHEN _t_hours_u > 0 AND _t_hours > 0 THEN try_divide(ln(_t_hours_u) - ln(_t_hours), _t_k2 - _t_k1) END"},
        {"_t_lo": "CASE WHEN _t_k2 > _t_k1 THEN _t_edge END", "_t_hi": "CASE WHEN _t_k2 < _t_k1 THEN _t_edge END"})
    df = _steps(
        _solve(df),
        {"_t_c": "CASE WHEN _t_status = 'ok' THEN exp(_t_x) END"},
        {"_t_n_u": "_t_hours_u * " + "(" + _power("_t_c", "-_t_k2") + ")",
         "_t_hours_all": "_t_hours * " + "(" + _power("_t_c", "-_t_k1") + ")"},
        {"_t_n_m": "_t_hours_all - _t_n_u"},
        {"_t_y_m": "_t_ym * _t_n_m", "_t_y_u": "_t_yu * _t_n_u",
         "_t_pay_m": "_t_w_m * _t_n_m", "_t_pay_u": "_t_w_u * _t_n_u"})
    return _emit(df, prefix, {
        "status": "_t_status",
        "y": "_t_y_m + _t_y_u", "y_m": "_t_y_m", "y_u": "_t_y_u",
        "underground_share": "try_divide(_t_y_u, _t_y_m + _t_y_u)",
        "c": "_t_c",
        "inv": "_t_inv_m * _t_n_m + _t_inv_u * _t_n_u",
        "G_c": "tau_c_ss * (p_ss * s * (_t_y_u - _t_pay_u) + _t_y_m - _t_pay_m)",
        "G_h": "tau_h_ss * (_t_pay_m + _t_r_m / _t_hkm * _t_n_m)",
        "G_s": "tau_s_ss * _t_pay_m",
        "TE": "tau_s_ss * _t_pay_u + tau_h_ss * (_t_pay_u + _t_r_u / _t_hku * _t_n_u) "
              "+ (1 - p_ss) * tau_c_ss * (_t_y_u - _t_pay_u)",
        "n_m": "_t_n_m", "n_u": "_t_n_u",
        "w_m": "CASE WHEN _t_status = 'ok' THEN _t_w_m END",
        "w_u": "CASE WHEN _t_status = 'ok' THEN _t_w_u END",
        "utility": "ln(_t_c) - B_0 * (" + _power("_t_hours_all", "1 + xi") + ") / (1 + xi) "
                   "- B_1 * (" + _power("_t_n_u", "1 + phi") + ") / (1 + phi)",
    })


def calibrate_b0(params: DataFrame, target: float = 0.19) -> DataFrame:
    """Value of ``B_0`` at which total hours equal ``target``; adds ``b0_star`` and ``b0_status``.

    Total hours are fixed, so one solve in consumption gives ``B_0`` in closed form.
    """
    if "B_0" not in params.columns:
        params = params.withColumn("B_0", F.lit(1.0))
    hours = f"{float(target)!r}D"
    df = _steps(
        _technology(params),
        {"_t_hours_u": _power("try_divide(_t_gap, B_1)", "try_divide(1D, phi)"),
         "_t_k1": "0D",
         "_t_k2": "try_divide(sigma, phi)"},
        {"_t_a1": f"_t_kap_m * {hours}",
         "_t_a2": "(_t_kap_u - _t_kap_m) * _t_hours_u",
         "_t_idle": "false", "_t_hi": "CAST(NULL AS DOUBLE)",
         "_t_lo": f"CASE WHEN _t_hours_u > 0 THEN try_divide(ln(_t_hours_u) - ln({hours}), _t_k2) END"})
    return _emit(_solve(df), "", {
        "b0_star": f"CASE WHEN _t_status = 'ok' THEN _t_net * exp(-sigma * _t_x) / pow({hours}, xi) END",
        "b0_status": "_t_status",
    })


def total_revenue(prefix: str = "", parts: tuple = ("G_c", "G_h", "G_s")) -> Column:
    """Sum of the revenue components; a missing component counts as zero."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(F.col(prefix + part), F.lit(0.0))
    return total


def size_table(solved: DataFrame) -> DataFrame:
    """Size of the underground sector: output share and share of hours."""
    return solved.withColumns({
        "hours": F.col("n_m") + F.col("n_u"),
        "hours_share": F.try_divide(F.col("n_u"), F.col("n_m") + F.col("n_u")),
        "share_pct": F.col("underground_share") * 100,
    })
