"""What the reports read instead of sessions: an additive cell table, sessions per day and country, and users per day as bitmaps.

Each is made by one scan of the sessions. Counts and money in cells add up over any of their columns, so every report that
counts sessions is a roll-up of one small table (at most as many rows as its columns have combinations, whatever the number
of sessions). Distinct users do not add up, but bitmaps over dense user numbers do: a day has one for each 32,768 users, and
the users of a week, a window or the whole period are the union of its days.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..contract import MONEY_TOTAL
from ..functions.columns import exprs, week_start

DIMENSIONS = ("session_date", "device_category", "user_type", "medium_group", "prior_purchaser")
FLAGS = ("has_search", "is_engaged", "has_view_item", "has_add_to_cart", "has_begin_checkout", "has_shipping", "has_payment",
         "has_purchase_event", "has_purchase")


def session_cells(sessions: DataFrame) -> DataFrame:
    """Sessions, orders and revenue by day, device, visitor, channel, previous buyer and what was done; `n_session_start` goes up
    to 2, which stands for more. The nested funnel flags follow from the others and are stated as well."""
    from .sessions import NESTED_STEPS
    flags = list(NESTED_STEPS.values())
    cells = (sessions.groupBy(*DIMENSIONS, *FLAGS, F.expr("least(n_session_start, 2L)").alias("n_session_start"))
             .agg(*exprs({"n_sessions": "count(*)", "orders": "sum(orders)",
                          "revenue_usd": f"sum(CAST(revenue_usd AS {MONEY_TOTAL}))"})))
    return cells.select("*", *exprs({column: " AND ".join(flags[:i + 1]) for i, column in enumerate(NESTED_STEPS)}))


def country_days(sessions: DataFrame) -> DataFrame:
    """Sessions by day and country."""
    return sessions.groupBy("session_date", "country").agg(F.count(F.lit(1)).alias("n_sessions"))


def user_days(sessions: DataFrame) -> DataFrame:
    """One row per user and day: whether the user searched, bought, and saw products in a session with a search."""
    return sessions.groupBy("user_pseudo_id", "session_date").agg(*exprs({
        "searched": "bool_or(has_search)", "bought": "bool_or(has_purchase)", "saw_products": "bool_or(has_search AND has_view_item)"}))


def user_numbers(days: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(user_pseudo_id, user_number): users numbered from 1 without gaps. `keep(df, name)` stores the users with their place in a
    partition, which makes the numbers last; a partition's first number follows from the counts of those before it."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    users = keep(days.where("user_pseudo_id IS NOT NULL").select("user_pseudo_id").distinct()
                 .select("user_pseudo_id", F.spark_partition_id().alias("part"), place.alias("place")), "users")
    # A row per partition of the stored users.
    before = users.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return users.join(F.broadcast(before), "part").select("user_pseudo_id", (F.col("before") + F.col("place") + 1).alias("user_number"))


def visitor_bitmaps(days: DataFrame, numbers: DataFrame) -> DataFrame:
    """(session_date, bucket, users): the users of a day, a bit for each of the bucket's 32,768 numbers.

    Rows go to their bucket before bitmaps are made, so no partly filled bitmap is shuffled."""
    return (days.join(numbers, "user_pseudo_id")
            .select("session_date", F.bitmap_bucket_number("user_number").alias("bucket"), F.bitmap_bit_position("user_number").alias("bit"))
            .repartition("bucket").groupBy("session_date", "bucket").agg(F.bitmap_construct_agg("bit").alias("users")))


def distinct_users(bitmaps: DataFrame, *by: Column | str) -> DataFrame:
    """The exact number of users of all days in the table, or of each group of days."""
    names = [by_.alias(f"g{i}") if isinstance(by_, Column) else F.col(by_).alias(f"g{i}") for i, by_ in enumerate(by)]
    groups = [f"g{i}" for i in range(len(by))]
    union = bitmaps.groupBy(*names, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return union.groupBy(*groups).agg(F.coalesce(F.sum(F.bitmap_count("users")), F.lit(0)).alias("users"))


def users_by_day(bitmaps: DataFrame) -> DataFrame:
    """(date, users)."""
    return bitmaps.groupBy(F.col("session_date").alias("date")).agg(F.sum(F.bitmap_count("users")).alias("users"))


def users_by_week(bitmaps: DataFrame) -> DataFrame:
    """(week_start, users, days): users of each week, counted once however many days they came."""
    week = week_start(F.col("session_date"))
    days = bitmaps.where("session_date IS NOT NULL").groupBy(week.alias("week_start")).agg(F.count_distinct("session_date").alias("days"))
    return distinct_users(bitmaps.where("session_date IS NOT NULL"), week).withColumnRenamed("g0", "week_start").join(days, "week_start")
