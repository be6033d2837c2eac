import math

import numpy as np
import pytest

from shoptrail.functions import stats
from shoptrail.functions.skew import exact_median
from shoptrail.plans.stages import Stages
from pyspark.sql import functions as F


def one(df, name):
    return df.select(name).first()[0]


def test_wilson_textbook(spark):
    df = spark.createDataFrame([(10, 100)], "x long, n long")
    ci = one(stats.with_wilson(df, "ci", "x", "n"), "ci")
    assert (round(ci.p, 4), round(ci.lo, 4), round(ci.hi, 4)) == (0.1, 0.0552, 0.1744)


@pytest.mark.parametrize("x, n", [(0, 0), (None, None), (0, -1)])
def test_wilson_is_undefined_without_trials(spark, x, n):
    df = spark.createDataFrame([(x, n)], "x long, n long")
    assert one(stats.with_wilson(df, "ci", "x", "n"), "ci") is None


def test_wilson_stays_inside_zero_and_one(spark):
    df = spark.createDataFrame([(0, 5), (5, 5)], "x long, n long")
    got = [r.ci for r in stats.with_wilson(df, "ci", "x", "n").orderBy("x").collect()]
    assert got[0].lo == 0.0 and got[0].hi < 1 and got[1].hi == 1.0 and got[1].lo > 0


def test_two_proportions_textbook(spark):
    df = spark.createDataFrame([(60, 1000, 40, 1000)], "x1 long, n1 long, x0 long, n0 long")
    t = one(stats.with_two_proportions(df, "t", "x1", "n1", "x0", "n0"), "t")
    p1, p0 = 0.06, 0.04
    se = math.sqrt(p1 * (1 - p1) / 1000 + p0 * (1 - p0) / 1000)
    se0 = math.sqrt(0.05 * 0.95 * 0.002)
    assert math.isclose(t.diff, 0.02) and math.isclose(t.rel, 0.5)
    assert math.isclose(t.lo, 0.02 - stats.Z95 * se) and math.isclose(t.hi, 0.02 + stats.Z95 * se)
    assert math.isclose(t.p_value, math.erfc(0.02 / se0 / math.sqrt(2)), rel_tol=2e-7)
    assert abs(t.p_value - 0.0402) < 0.0005


def test_two_proportions_edges(spark):
    df = spark.createDataFrame([(1, 0, 1, 10), (0, 10, 0, 10), (5, 10, 0, 10)], "x1 long, n1 long, x0 long, n0 long")
    rows = stats.with_two_proportions(df, "t", "x1", "n1", "x0", "n0").collect()
    none, same, no_base = (r.t for r in rows)
    assert none is None
    assert same.p_value == 1.0 and same.diff == 0 and same.rel is None
    assert no_base.rel is None and no_base.diff == 0.5


def test_erfc_follows_the_library_function(spark):
    df = spark.range(0, 2500).select((F.col("id") / 100).alias("x"))
    for r in stats.with_erfc(df, "e", "x").collect():
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=2e-7), r.x


def test_sample_size_textbook(spark):
    df = spark.createDataFrame([(0.10, 0.20)], "p double, lift double")
    assert one(stats.with_n_per_arm(df, "n", "p", "lift"), "n") == 3841


STRATA = "n1 long, x1 long, n0 long, x0 long"


def test_equal_rates_in_every_stratum_leave_no_difference(spark):
    df = spark.createDataFrame([(40, 8, 360, 72), (160, 96, 20, 12), (25, 5, 75, 15)], STRATA)
    a = df.agg(stats.standardised_difference("n1", "x1", "n0", "x0").alias("a")).first().a
    assert abs(a["diff"]) < 1e-12 and a.coverage == 1.0 and (a.strata_used, a.strata_total) == (3, 3)
    pooled = spark.createDataFrame([(225, 109, 455, 99)], STRATA)
    assert math.isclose(one(stats.with_two_proportions(pooled, "t", "x1", "n1", "x0", "n0"), "t")["diff"], 109 / 225 - 99 / 455)


def test_one_sided_strata_are_left_out_and_counted(spark):
    df = spark.createDataFrame([(30, 6, 70, 7), (20, 9, 0, 0), (0, 0, 15, 3)], STRATA)
    a = df.agg(stats.standardised_difference("n1", "x1", "n0", "x0").alias("a")).first().a
    assert math.isclose(a.coverage, 0.6) and (a.strata_used, a.strata_total) == (1, 3) and math.isclose(a["diff"], 0.1)


def test_standardisation_without_any_comparable_stratum(spark):
    df = spark.createDataFrame([(50, 5, 0, 0)], STRATA)
    a = df.agg(stats.standardised_difference("n1", "x1", "n0", "x0").alias("a")).first().a
    assert a["diff"] is None and a.coverage == 0.0 and a.strata_used == 0


@pytest.mark.parametrize("seed", range(4))
def test_exact_median_equals_a_full_sort(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(-3, 2, 400 + seed), 3)
    weights = rng.integers(1, 5, len(values))
    if seed == 2:
        values[: len(values) // 3] = 0.02     # a third of all rows share one value
    if seed == 3:
        values[:150] = 0.0
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, weights)] + [(None, 3)], "v double, w long")
    got = exact_median(df, F.col("v"), F.col("w"), "m", Stages(spark).keep).first().m
    assert math.isclose(got, float(np.median(np.repeat(values, weights))))


def test_exact_median_between_distant_values_and_of_nothing(spark):
    df = spark.createDataFrame([(0.001, 1), (1000.0, 1)], "v double, w long")
    assert math.isclose(exact_median(df, F.col("v"), F.col("w"), "m", Stages(spark).keep).first().m, 500.0005)
    assert exact_median(df.where("false"), F.col("v"), F.col("w"), "m", Stages(spark).keep).first().m is None


def test_a_million_gaps_at_one_ratio_are_spread(spark):
    """Distinct values within a millionth of each other: no range, and so no task of the last step, holds many of them."""
    df = spark.range(1_000_000).selectExpr("0.2D + id / 1e12D AS v", "1L AS w")
    kept = {}

    def keep(table, name):
        kept[name] = Stages(spark).keep(table, name)
        return kept[name]
    got = exact_median(df, F.col("v"), F.col("w"), "m", keep, ranges=100)
    assert math.isclose(got.first().m, 0.2 + 499_999.5 / 1e12, rel_tol=1e-15)
    sizes = [r["count"] for r in kept["median_values"].groupBy("part").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 30_000
