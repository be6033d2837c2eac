"""Proportion statistics as columns added to a table; undefined results are NULL.

Each step is its own column, so Catalyst keeps a value that is used several times instead of repeating its
expression.
"""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

Z95 = NormalDist().inv_cdf(0.975)

# Coefficients of the published Chebyshev fit of erfc (Numerical Recipes, relative error below 1.2e-7 everywhere).
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _steps(df: DataFrame, name: str, steps: list[dict[str, str]], result: str) -> DataFrame:
    """Add the steps as working columns, then the result as column `name`, and drop the working columns.

    `{x}` in an expression is the working column x.
    """
    work = {c: f"`_{name}_{c}`" for step in steps for c in step}
    for step in steps:
        df = df.withColumns({f"_{name}_{c}": F.expr(e.format(**work)) for c, e in step.items()})
    return df.withColumn(name, F.expr(result.format(**work))).drop(*[w.strip("`") for w in work.values()])


def with_erfc(df: DataFrame, name: str, x: str) -> DataFrame:
    """Complementary error function of a non-negative SQL expression."""
    poly = str(ERFC_FIT[-1]) + "D"
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({c}D + {{t}} * {poly})"
    return _steps(df, name, [
        {"x": f"CAST({x} AS DOUBLE)"},
        {"t": "1D / (1D + 0.5D * {x})"},
    ], f"{{t}} * exp(-{{x}} * {{x}} + {poly})")


def with_wilson(df: DataFrame, name: str, x: str, n: str, z: float = Z95) -> DataFrame:
    """Struct (p, lo, hi): x / n with its Wilson score interval, NULL when n is not positive."""
    return _steps(df, name, [
        {"p": f"CASE WHEN {n} > 0 THEN try_divide(CAST({x} AS DOUBLE), CAST({n} AS DOUBLE)) END",
         "inv": f"CASE WHEN {n} > 0 THEN try_divide(1D, CAST({n} AS DOUBLE)) END"},
        {"scale": f"1D + {z * z}D * {{inv}}"},
        {"mid": f"({{p}} + {z * z / 2}D * {{inv}}) / {{scale}}",
         "half": f"{z}D * sqrt({{p}} * (1D - {{p}}) * {{inv}} + {z * z / 4}D * {{inv}} * {{inv}}) / {{scale}}"},
    ], "CASE WHEN {p} IS NOT NULL THEN named_struct("
       "'p', {p}, 'lo', greatest(0D, {mid} - {half}), 'hi', least(1D, {mid} + {half})) END")


def with_two_proportions(df: DataFrame, name: str, x1: str, n1: str, x0: str, n0: str, z: float = Z95) -> DataFrame:
    """Struct (p1, p0, diff, lo, hi, p_value, rel): unpooled 95% interval, pooled two-sided z-test."""
    w = f"_{name}_w"
    df = _steps(df, w, [
        {"x1": f"CAST({x1} AS DOUBLE)", "n1": f"CASE WHEN {n1} > 0 AND {n0} > 0 THEN CAST({n1} AS DOUBLE) END",
         "x0": f"CAST({x0} AS DOUBLE)", "n0": f"CASE WHEN {n1} > 0 AND {n0} > 0 THEN CAST({n0} AS DOUBLE) END"},
        {"p1": "try_divide({x1}, {n1})", "p0": "try_divide({x0}, {n0})",
         "pool": "try_divide({x1} + {x0}, {n1} + {n0})", "inv": "try_divide(1D, {n1}) + try_divide(1D, {n0})"},
        {"diff": "{p1} - {p0}", "pooled": "sqrt({pool} * (1D - {pool}) * {inv})",
         "half": f"{z}D * sqrt(try_divide({{p1}} * (1D - {{p1}}), {{n1}}) + try_divide({{p0}} * (1D - {{p0}}), {{n0}}))"},
    ], "named_struct('p1', {p1}, 'p0', {p0}, 'diff', {diff}, 'half', {half}, "
       "'z', CASE WHEN {pooled} > 0 THEN try_divide(abs({diff}), {pooled}) / sqrt(2D) END)")
    df = with_erfc(df, f"{w}p", f"{w}.z")
    return df.withColumn(name, F.expr(
        f"CASE WHEN {w}.diff IS NOT NULL THEN named_struct('p1', {w}.p1, 'p0', {w}.p0, 'diff', {w}.diff, "
        f"'lo', {w}.diff - {w}.half, 'hi', {w}.diff + {w}.half, 'p_value', least(1D, coalesce({w}p, 1D)), "
        f"'rel', CASE WHEN {w}.p0 > 0 THEN try_divide({w}.diff, {w}.p0) END) END")).drop(w, f"{w}p")


def standardised_difference(n1: str, x1: str, n0: str, x0: str, z: float = Z95) -> Column:
    """Aggregate over strata rows: the difference after giving the second group the first group's mix.

    Strata where a group is empty cannot be compared; they are left out and show up as lost coverage.
    """
    kept = f"FILTER (WHERE {n1} > 0 AND {n0} > 0)"
    w, p1, p0 = f"CAST({n1} AS DOUBLE)", f"try_divide({x1}, {n1})", f"try_divide({x0}, {n0})"
    var = f"try_divide({p1} * (1 - {p1}), {n1}) + try_divide({p0} * (1 - {p0}), {n0})"
    weight = f"sum({w}) {kept}"
    diff = f"try_divide(sum({w} * ({p1} - {p0})) {kept}, {weight})"
    se = f"try_divide(sqrt(sum({w} * {w} * ({var})) {kept}), {weight})"
    return F.expr(
        f"named_struct('diff', {diff}, 'se', {se}, 'lo', {diff} - {z}D * {se}, 'hi', {diff} + {z}D * {se}, "
        f"'coverage', coalesce(try_divide({weight}, sum({w})), 0D), "
        f"'strata_used', count({n1}) {kept}, 'strata_total', count({n1}))")


def with_n_per_arm(df: DataFrame, name: str, p0: str, lift: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Users per arm to detect p0 -> p0 * (1 + lift) with a two-sided two-proportion test."""
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return _steps(df, name, [
        {"p0": f"CAST({p0} AS DOUBLE)", "p1": f"{p0} * (1D + {lift})"},
        {"mid": "({p0} + {p1}) / 2D", "gap": "{p1} - {p0}"},
        {"root": f"{za}D * sqrt(2D * {{mid}} * (1D - {{mid}})) + {zb}D * sqrt({{p0}} * (1D - {{p0}}) + {{p1}} * (1D - {{p1}}))"},
    ], "CAST(ceil(try_divide({root} * {root}, {gap} * {gap})) AS BIGINT)")
