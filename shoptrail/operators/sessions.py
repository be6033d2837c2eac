"""From events to one row per session, and the session-level overview."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import exprs, ratio, sessions_sql, total_sql, weighted
from ..functions.skew import salted_join
from ..functions.stats import with_wilson
from .cells import distinct_users
from .orders import session_orders

SESSION_KEY = ("user_pseudo_id", "ga_session_id")

COUNTED_EVENTS = {"n_session_start": "session_start", "page_views": "page_view", "searches": "view_search_results"}
STEP_EVENTS = {"has_view_item": "view_item", "has_add_to_cart": "add_to_cart", "has_begin_checkout": "begin_checkout",
               "has_shipping": "add_shipping_info", "has_payment": "add_payment_info", "has_purchase_event": "purchase"}

# Acquisition medium -> channel.
CHANNELS = (("organic", "organic search"), ("cpc", "paid search"), ("referral", "referral"), ("(none)", "direct"))
OTHER_CHANNEL = "other or unknown"

# Funnel column -> the last step flag it adds; each one also needs every earlier step.
NESTED_STEPS = {"f_view_item": "has_view_item", "f_add_to_cart": "has_add_to_cart", "f_checkout": "has_begin_checkout",
                "f_shipping": "has_shipping", "f_payment": "has_payment", "f_purchase": "has_purchase"}


def slices(events: DataFrame) -> DataFrame:
    """Events of a session that agree on day, device, country and medium, merged.

    Almost every session has one or two slices. The event rows are merged here, map side, by a hash aggregate whose
    buffers are all fixed width, one of them holding a bit per step event; only the few slices reach the aggregate
    that has to carry text.
    """
    step_bit = " ".join(f"WHEN '{event}' THEN {1 << i}" for i, event in enumerate(STEP_EVENTS.values()))
    return (events.where("ga_session_id IS NOT NULL")
            .groupBy(*SESSION_KEY, "event_date", "device_category", "country", "first_medium")
            .agg(*exprs({
                "first_ts": "min(event_ts)",
                "ga_session_number": "min(ga_session_number)",
                **{column: f"count_if(event_name = '{event}')" for column, event in COUNTED_EVENTS.items()},
                "engaged": "bool_or(session_engaged = '1')",
                "steps": f"bit_or(CASE event_name {step_bit} ELSE 0 END)",
            })))


def _first_known(column: str) -> str:
    """The earliest non-NULL value of events that have a time; equal times give the smallest value."""
    return f"min(struct(first_ts, {column})) FILTER (WHERE {column} IS NOT NULL AND first_ts IS NOT NULL).{column}"


def merge_slices(parts: DataFrame) -> DataFrame:
    """One row per session from its slices: first-touch attributes, counts, the bits of its step events, and the days it reaches over."""
    return parts.groupBy(*SESSION_KEY).agg(*exprs({
        "start_ts": "min(first_ts)",
        "session_date": _first_known("event_date"),
        "device_category": _first_known("device_category"),
        "country": _first_known("country"),
        "first_medium": _first_known("first_medium"),
        "ga_session_number": "min(ga_session_number)",
        **{column: f"sum({column})" for column in COUNTED_EVENTS},
        "engaged": "bool_or(engaged)",
        "steps": "bit_or(steps)",
        "first_day": "min(event_date)",
        "last_day": "max(event_date)",
    }))


def session_core(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """One row per session: first-touch attributes, counts, step flags, orders and revenue."""
    return with_orders(merge_slices(slices(events)).drop("first_day", "last_day"), purchases)


def with_orders(merged: DataFrame, purchases: DataFrame) -> DataFrame:
    """Merged sessions with their step flags, orders and revenue."""
    flags = {column: f"steps & {1 << i} <> 0" for i, column in enumerate(STEP_EVENTS)}
    own = [c for c in merged.columns if c != "steps"]
    return (merged.join(session_orders(purchases), list(SESSION_KEY), "left")
            .select(*own, *exprs({
                **flags,
                "orders": "coalesce(orders, 0L)",
                "revenue_usd": "coalesce(revenue_usd, 0D)",
                "has_purchase": "coalesce(orders, 0L) > 0",
            })))


def first_orders(core: DataFrame) -> DataFrame:
    """Start of the first ordering session per buyer."""
    return (core.where("has_purchase").groupBy("user_pseudo_id")
            .agg(F.min("start_ts").alias("first_order_ts")))


def with_journey(core: DataFrame) -> DataFrame:
    """Visitor type, channel, nested funnel flags and whether the user ordered in an earlier session."""
    flags = list(NESTED_STEPS.values())
    channel = " ".join(f"WHEN '{medium}' THEN '{label}'" for medium, label in CHANNELS)
    joined = salted_join(core, first_orders(core), ["user_pseudo_id"], ["ga_session_id"])
    return joined.select(*core.columns, *exprs({
        "has_search": "searches > 0",
        "is_engaged": "coalesce(engaged, false)",
        "user_type": "CASE WHEN ga_session_number IS NULL THEN 'unknown' WHEN ga_session_number = 1 THEN 'new' ELSE 'returning' END",
        "medium_group": f"CASE first_medium {channel} ELSE '{OTHER_CHANNEL}' END",
        **{column: " AND ".join(flags[:i + 1]) for i, column in enumerate(NESTED_STEPS)},
        "prior_purchaser": "coalesce(start_ts > first_order_ts, false)",
    }))


def sessions(events: DataFrame, purchases: DataFrame,
             keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The session table. `keep` may store the core, which is read twice: once per session, once for first orders."""
    return with_journey(keep(session_core(events, purchases)))


def overview(sessions: DataFrame, n_events: DataFrame, visitors: DataFrame | None = None) -> DataFrame:
    """One row of headline figures over `sessions` or their cells; `n_events` is a one-row frame counting all events, `visitors` the
    bitmaps of the same days, which cells need as they do not hold users."""
    row = weighted(sessions).agg(*exprs({
        "first_day": "min(session_date)",
        "last_day": "max(session_date)",
        "sessions": sessions_sql(),
        **({} if visitors is not None else {"users": "count(DISTINCT user_pseudo_id)"}),
        "purchasing_sessions": sessions_sql("has_purchase"),
        "orders": "coalesce(sum(orders), 0L)",
        "revenue_usd": total_sql("revenue_usd"),
        "searching": sessions_sql("has_search"),
        "engaged": sessions_sql("is_engaged"),
    }))
    if visitors is not None:
        row = row.withColumn("users", distinct_users(visitors).scalar())
    row = with_wilson(row.withColumn("events", n_events.scalar()), "ci", "purchasing_sessions", "sessions")
    return row.selectExpr(
        "first_day", "last_day", "events", "sessions", "users", "purchasing_sessions", "orders", "revenue_usd",
        "ci.p AS conversion", "ci.lo AS conversion_lo", "ci.hi AS conversion_hi",
        "try_divide(revenue_usd, orders) AS revenue_per_order",
        "try_divide(searching, sessions) AS search_share",
        "try_divide(engaged, sessions) AS engaged_share")


def mix(sessions: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The `top` largest groups of a column and their share of all sessions."""
    groups = weighted(sessions).groupBy(F.col(column).alias("grp")).agg(F.sum("n_sessions").alias("sessions"))
    # The total adds up the same groups, so both read one exchange and the sessions are scanned once.
    total = groups.agg(F.sum("sessions")).scalar()
    return (groups.orderBy(F.desc("sessions"), F.asc_nulls_last("grp")).limit(top)
            .select(F.col("grp").alias("group"), "sessions", ratio(F.col("sessions"), total).alias("share")))
