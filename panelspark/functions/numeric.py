"""Scalar helpers as Columns: missing values, rounding, inverse normal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16) for the inverse normal.
_CENTRE_NUM = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
               4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_CENTRE_DEN = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_MID_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
            1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_MID_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_FAR_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_FAR_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _poly(coefs: list, x: str) -> str:
    """Horner form of a polynomial as SQL text."""
    return reduce(lambda acc, c: f"({acc}*{x} + {c!r}D)", reversed(coefs[:-1]), f"{coefs[-1]!r}D")


def with_norm_ppf(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the inverse of the standard normal distribution function at ``p``; null outside (0, 1).

    The shared inner terms are columns of their own: repeated inside the
    polynomials they would be evaluated over and over.
    """
    df = df.withColumn("_ppf_p", F.when((p > 0) & (p < 1), p))
    df = df.withColumns({
        "_ppf_q": F.expr("_ppf_p - 0.5D"),
        "_ppf_d": F.expr("sqrt(-ln(least(_ppf_p, 1D - _ppf_p)))"),
    })
    df = df.withColumns({
        "_ppf_r": F.expr("0.180625D - _ppf_q*_ppf_q"), "_ppf_m": F.expr("_ppf_d - 1.6D"), "_ppf_f": F.expr("_ppf_d - 5D")})
    z = F.expr(f"""CASE
        WHEN abs(_ppf_q) <= 0.425D THEN _ppf_q*{_poly(_CENTRE_NUM, '_ppf_r')}/{_poly(_CENTRE_DEN, '_ppf_r')}
        WHEN _ppf_d <= 5D THEN signum(_ppf_q)*{_poly(_MID_NUM, '_ppf_m')}/{_poly(_MID_DEN, '_ppf_m')}
        ELSE signum(_ppf_q)*{_poly(_FAR_NUM, '_ppf_f')}/{_poly(_FAR_DEN, '_ppf_f')} END""")
    return df.withColumn(name, z).drop("_ppf_p", "_ppf_q", "_ppf_d", "_ppf_r", "_ppf_m", "_ppf_f")


def or_null(col: Column) -> Column:
    """NaN becomes null, so both missing-value conventions look the same downstream."""
    return F.when(~F.isnan(col), col)


def or_default(col: Column, default: float = 0.0) -> Column:
    """Value of a lookup with a default: null and NaN are replaced."""
    return F.coalesce(or_null(col), F.lit(float(default)))


def clamp(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(lo))), F.lit(float(hi)))


def is_valid(*cols: str) -> Column:
    """True where every named column holds a usable number."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def valid_rows(df, *cols: str):
    """Drop failed points (null or NaN) before a peak search or a curve."""
    return df.filter(is_valid(*cols))
