"""Scalar column helpers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts) -> Column:
    """UTC calendar day of a timestamp (the session runs with timeZone=UTC)."""
    return F.to_date(ts)


def clean(x) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.nanvl(F.col(x) if isinstance(x, str) else x, F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def keep_above(x: Column, tau: float) -> Column:
    """|x| where it exceeds the threshold, else 0."""
    return F.when(F.abs(x) > tau, F.abs(x)).otherwise(F.lit(0.0))


def credible_lower(p: Column, n_eff: Column, alpha: float) -> Column:
    """One-sided lower credible bound of an edge probability, clipped to [0, 1]."""
    z = NormalDist().inv_cdf(1.0 - alpha)
    raw = p - F.lit(z) * F.sqrt(p * (1.0 - p) / F.nullif(n_eff, F.lit(0.0)))
    return clip(F.coalesce(raw, F.lit(0.0)), 0.0, 1.0)


def bernoulli_kl(p: Column, eps: float = 1e-10) -> Column:
    """KL divergence of Bernoulli(p) from Bernoulli(1/2)."""
    q = clip(p, eps, 1.0 - eps)
    return q * F.ln(2.0 * q) + (1.0 - q) * F.ln(2.0 * (1.0 - q))


def country_of(name: Column) -> Column:
    """``CC`` of ``CC_KIND``; a name without underscore is an error."""
    return F.when(F.instr(name, "_") > 0, F.split(name, "_", 2)[0]).otherwise(
        F.raise_error(F.concat(F.lit("variable name is not CC_KIND: "), name)).cast("string")
    )


def kind_of(name: Column) -> Column:
    """``KIND`` of ``CC_KIND`` (split at the first underscore)."""
    return F.when(F.instr(name, "_") > 0, F.split(name, "_", 2)[1]).otherwise(
        F.raise_error(F.concat(F.lit("variable name is not CC_KIND: "), name)).cast("string")
    )


def pip_label(p: Column, threshold: float = 0.5, decimals: int = 2) -> Column:
    """Rounded probability as text, blank at or below the threshold."""
    return F.when(p > threshold, F.round(p, decimals).cast("string")).otherwise(F.lit(""))


def light(x: Column, red: Column, amber: Column) -> Column:
    return F.when(red, "red").when(amber, "amber").otherwise("green")


def ess_light(share: Column) -> Column:
    return light(share, share < 0.01, share < 0.05)


def geweke_light(z: Column) -> Column:
    return light(z, F.abs(z) > 3, F.abs(z) > 2)


def rhat_light(r: Column) -> Column:
    return light(r, r > 1.05, r > 1.01)


def volatility(h: Column) -> Column:
    """Residual scale implied by a log-volatility."""
    return F.exp(0.5 * h)
