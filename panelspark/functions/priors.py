"""Prior densities: kernels as Columns, normalising constants once per prior on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = (None, None)

# Priors of the estimation on real data, (family, a, b, lower, upper).
# Beta(a, b); Gamma(shape a, scale b); InverseGamma(shape a, scale b); Normal(mean a, sd b).
PRIORS_REAL = {
    "alpha": ("Beta", 1478.1, 795.9, *_NONE),
    "delta_k": ("Beta", 6.07, 236.68, *_NONE),
    "alpha_u": ("Beta", 1480.2, 766.0, *_NONE),
    "phi": ("Gamma", 400.0, 0.0025, *_NONE),
    "xi": ("Gamma", 25.0, 0.04, *_NONE),
    "gamma_pct": ("Normal", 0.37, 0.20, 0.0, None),
    "p_ss": ("Beta", 8.70, 281.30, *_NONE),
    "rho_a": ("Beta", 12.0, 3.0, None, 0.97),
    "rho_b": ("Beta", 12.0, 12.0, None, 0.97),
    "rho_c": ("Beta", 7.2, 0.8, None, 0.97),
    "rho_s": ("Beta", 7.2, 0.8, None, 0.97),
    "rho_h": ("Beta", 7.2, 0.8, None, 0.97),
    "rho_xi_h": ("Beta", 13.8, 9.2, None, 0.97),
    "rho_x": ("Beta", 12.0, 3.0, None, 0.95),
    "rho_p": ("Beta", 12.0, 3.0, None, 0.97),
    **{f"var_eps_{e}": ("InverseGamma", 3.0, 7.2e-5, *_NONE) for e in ("a", "b", "c", "s", "h", "xi_h", "x", "p")},
}
# Flat priors of the estimation on simulated data.
PRIORS_SIMULATED = {
    "alpha": ("Uniform", 0.40, 0.85, *_NONE),
    "delta_k": ("Uniform", 0.005, 0.10, *_NONE),
    "alpha_u": ("Uniform", 0.40, 0.85, *_NONE),
    "sigma": ("Uniform", 0.10, 5.00, *_NONE),
    "phi": ("Uniform", 0.10, 3.00, *_NONE),
    "xi": ("Uniform", 0.30, 4.00, *_NONE),
    "B_1": ("Uniform", 10.0, 2000.0, *_NONE),
    "gamma_pct": ("Uniform", 0.02, 0.80, *_NONE),
    "p_ss": ("Uniform", 0.001, 0.1, *_NONE),
    **{f"rho_{r}": ("Beta", 1.0, 1.0, *_NONE) for r in ("a", "b", "c", "s", "h", "xi_h", "x", "p")},
    **{f"var_eps_{e}": ("InverseGamma", 2.0, 0.01, *_NONE) for e in ("a", "b", "c", "s", "h", "xi_h", "x", "p")},
}
# Start of the first chain.
START_VALUES = {
    "alpha": 0.650, "delta_k": 0.025, "alpha_u": 0.659, "phi": 1.000, "xi": 1.000, "gamma_pct": 0.27, "p_ss": 0.030,
    "rho_a": 0.800, "rho_b": 0.500, "rho_c": 0.900, "rho_s": 0.900, "rho_h": 0.900, "rho_xi_h": 0.600,
    "rho_x": 0.800, "rho_p": 0.800,
    **{f"var_eps_{e}": 3.6e-5 for e in ("a", "b", "c", "s", "h", "xi_h", "x", "p")},
}
# Parameters behind the simulated data.
TRUE_VALUES = {
    "alpha": 0.63, "delta_k": 0.03, "alpha_u": 0.66, "sigma": 0.99, "phi": 0.93, "xi": 1.60, "B_1": 300.0,
    "gamma_pct": 0.20, "p_ss": 0.02, "rho_a": 0.99, "rho_b": 0.93, "rho_c": 0.96, "rho_s": 0.94, "rho_h": 0.99,
    "rho_xi_h": 0.60, "rho_x": 0.94, "rho_p": 0.95,
    "var_eps_a": 0.01 ** 2, "var_eps_b": 0.01 ** 2, "var_eps_c": 0.01 ** 2, "var_eps_s": 0.01 ** 2,
    "var_eps_h": 0.02 ** 2, "var_eps_xi_h": 0.01 ** 2, "var_eps_x": 0.01 ** 2, "var_eps_p": 0.06 ** 2,
}

PRIOR_SCHEMA = T.StructType([
    T.StructField("param", T.StringType()), T.StructField("family", T.StringType()),
    T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()),
    T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()),
    T.StructField("prior_mean", T.DoubleType()), T.StructField("log_norm", T.DoubleType()),
])
MAX_CATALOGUE = 10_000  # prior rows that may be broadcast


def log_constant(family: str, a: float, b: float) -> float:
    """Log normalising constant of the untruncated density."""
    if family == "Beta":
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    if family == "Gamma":
        return -math.lgamma(a) - a * math.log(b)
    if family == "InverseGamma":
        return a * math.log(b) - math.lgamma(a)
    if family == "Normal":
        return -math.log(b) - 0.5 * math.log(2 * math.pi)
    if family == "Uniform":
        return -math.log(b - a)
    raise ValueError(f"unknown prior family {family}")


def _log_kernel(family: str, a: float, b: float, x: np.ndarray) -> np.ndarray:
    if family == "Beta":
        return (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    if family == "Gamma":
        return (a - 1) * np.log(x) - x / b
    if family == "InverseGamma":
        return -(a + 1) * np.log(x) - b / x
    if family == "Normal":
        return -0.5 * ((x - a) / b) ** 2
    return np.zeros_like(x)


def _support(family: str, a: float, b: float) -> tuple:
    if family == "Beta":
        return 0.0, 1.0
    if family == "Gamma":
        return 0.0, a * b + 40 * b * math.sqrt(a) + 40 * b
    if family == "InverseGamma":
        return 0.0, math.inf
    if family == "Normal":
        return a - 12 * b, a + 12 * b
    return a, b


def _moments(family: str, a: float, b: float, lower, upper) -> tuple:
    """Mass and mean inside the truncation bounds by Gauss-Legendre panels."""
    lo, hi = _support(family, a, b)
    lo = lo if lower is None else max(lo, lower)
    hi = hi if upper is None else min(hi, upper)
    if not math.isfinite(hi):
        raise ValueError(f"a truncated {family} prior needs an upper bound")
    nodes, weights = np.polynomial.legendre.leggauss(40)
    edges = np.linspace(lo, hi, 401)
    half = np.diff(edges)[:, None] / 2
    x = edges[:-1, None] + half * (nodes + 1)
    f = np.exp(log_constant(family, a, b) + _log_kernel(family, a, b, x)) * half * weights
    return float(f.sum()), float((f * x).sum() / f.sum())


def _plain_mean(family: str, a: float, b: float) -> float:
    if family == "Beta":
        return a / (a + b)
    if family == "Gamma":
        return a * b
    if family == "InverseGamma":
        return b / (a - 1) if a > 1 else math.nan
    if family == "Normal":
        return a
    return (a + b) / 2


def prior_table(spark: SparkSession, priors: dict = PRIORS_REAL) -> DataFrame:
    """Prior catalogue with its mean and log normalising constant, truncation included."""
    rows = []
    for name, (family, a, b, lower, upper) in priors.items():
        norm, mean = log_constant(family, a, b), _plain_mean(family, a, b)
        if lower is not None or upper is not None:
            mass, mean = _moments(family, a, b, lower, upper)
            norm -= math.log(mass)
        rows.append((name, family, float(a), float(b), lower, upper, mean, norm))
    return spark.createDataFrame(rows, PRIOR_SCHEMA)


def log_density(x: Column) -> Column:
    """Log prior density at ``x`` for a row that carries the catalogue columns; null outside the support."""
    a, b, family = F.col("a"), F.col("b"), F.col("family")
    inside = ((F.col("lower").isNull() | (x >= F.col("lower"))) & (F.col("upper").isNull() | (x <= F.col("upper"))))
    kernel = (
        F.when((family == "Beta") & (x > 0) & (x < 1), (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x))
        .when((family == "Gamma") & (x > 0), (a - 1) * F.ln(x) - F.try_divide(x, b))
        .when((family == "InverseGamma") & (x > 0), -(a + 1) * F.ln(x) - F.try_divide(b, x))
        .when(family == "Normal", -0.5 * F.pow(F.try_divide(x - a, b), 2))
        .when((family == "Uniform") & (x >= a) & (x <= b), F.lit(0.0)))
    return F.when(inside, kernel + F.col("log_norm"))


def _with_catalogue(df: DataFrame, priors: dict, on: str = "param") -> DataFrame:
    table = prior_table(df.sparkSession, priors)
    if len(priors) <= MAX_CATALOGUE:
        table = F.broadcast(table)
    return df.join(table, [on])


def prior_pdf(grid: DataFrame, priors: dict = PRIORS_REAL, x: str = "x") -> DataFrame:
    """Prior density at every ``(param, x)``; zero outside the support."""
    return (_with_catalogue(grid, priors)
            .withColumn("pdf", F.coalesce(F.exp(log_density(F.col(x))), F.lit(0.0)))
            .select(*grid.columns, "pdf"))


def log_prior(draws: DataFrame, priors: dict = PRIORS_REAL) -> DataFrame:
    """Log prior of every draw, summed over its parameters; null if a parameter is out of support."""
    each = _with_catalogue(draws, priors).withColumn("_lp", log_density(F.col("value")))
    agg = each.groupBy("run", "chain", "iter").agg(
        F.sum("_lp").alias("_sum"), F.count_if(F.col("_lp").isNull()).alias("_out"))
    return agg.select("run", "chain", "iter", F.when(F.col("_out") == 0, F.col("_sum")).alias("log_prior"))


def perturb_init(start: DataFrame, chains: list, step: float = 0.001, lo: float = 0.05, hi: float = 0.96) -> DataFrame:
    """Start values per chain from ``(param, group, start_value)``.

    ``chains`` lists ``(chain, sign)``; a zero sign keeps the start value.
    Structural parameters and variances move by a factor, persistences by an
    amount and stay within ``[lo, hi]``.
    """
    signs = F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(float(s)).alias("sign")) for c, s in chains])
    out = start.select("*", F.inline(signs))
    moved = F.when(
        (F.col("group") == "persistence") & (F.col("sign") != 0),
        F.least(F.greatest(F.col("start_value") + F.col("sign") * step, F.lit(lo)), F.lit(hi))
    ).when(F.col("group") == "persistence", F.col("start_value")).otherwise(F.col("start_value") * (1 + F.col("sign") * step))
    return out.withColumn("init_value", moved).drop("sign")
