"""Table contracts and the fixed vocabulary the operators share."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, types as T

EVENTS = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("ga_session_id", T.LongType()),
    T.StructField("ga_session_number", T.LongType()),
    T.StructField("page_location", T.StringType()),
    T.StructField("page_title", T.StringType()),
    T.StructField("search_term", T.StringType()),
    T.StructField("engagement_time_msec", T.LongType()),
    T.StructField("session_engaged", T.StringType()),
    T.StructField("device_category", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("first_medium", T.StringType()),
    T.StructField("first_source", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("purchase_revenue_usd", T.DoubleType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("item_quantity", T.LongType()),
])

ITEMS = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("ga_session_id", T.LongType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_category", T.StringType()),
    T.StructField("price_usd", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("item_revenue_usd", T.DoubleType()),
])

INVENTORY = T.StructType([
    T.StructField("event_name", T.StringType()),
    T.StructField("param_key", T.StringType()),
    T.StructField("n_present", T.LongType()),
    T.StructField("n_nonnull", T.LongType()),
])

CALENDAR = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("label", T.StringType()),
])

TRADING_WINDOWS = T.StructType([
    T.StructField("window_name", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("role", T.StringType()),
])

# Nested export: only the fields the flatten jobs read, so a reader with this schema prunes the rest.
EXPORT = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_params", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([
            T.StructField("string_value", T.StringType()),
            T.StructField("int_value", T.LongType()),
            T.StructField("float_value", T.DoubleType()),
            T.StructField("double_value", T.DoubleType()),
        ])),
    ]))),
    T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
    T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
    T.StructField("traffic_source", T.StructType([
        T.StructField("medium", T.StringType()),
        T.StructField("source", T.StringType()),
    ])),
    T.StructField("ecommerce", T.StructType([
        T.StructField("transaction_id", T.StringType()),
        T.StructField("purchase_revenue_in_usd", T.DoubleType()),
        T.StructField("total_item_quantity", T.LongType()),
    ])),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("item_category", T.StringType()),
        T.StructField("price_in_usd", T.DoubleType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("item_revenue_in_usd", T.DoubleType()),
    ]))),
])

# Fixed values of the data model.
MISSING_IDS = ("", "(not set)")
PLACEHOLDERS = ("<Other>", "(not set)", "(data deleted)", "<obfuscated>")
JOURNEY_EVENTS = ("view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info",
                  "purchase", "view_search_results")
ECOMMERCE_EVENTS = ("view_item", "add_to_cart", "begin_checkout", "purchase")

# Money is added as a decimal so totals do not depend on the order partitions arrive in.
MONEY = "decimal(18,6)"
MONEY_TOTAL = "decimal(28,6)"


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, contract: T.StructType, what: str) -> DataFrame:
    """Check names and types against a contract and select exactly its columns; extra columns are dropped.

    Nullability is not compared: what a reader or a job can prove about it is not part of the contract.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = [f.name for f in contract.fields if f.name not in have]
    if missing:
        raise ContractError(f"{what} is missing columns {missing}; expected {contract.fieldNames()}")
    wrong = [f"{f.name} is {have[f.name]}, expected {f.dataType.simpleString()}"
             for f in contract.fields if have[f.name] != f.dataType.simpleString()]
    if wrong:
        raise ContractError(f"{what} has wrong types: {'; '.join(wrong)}")
    return df.select(*contract.fieldNames())


def covers(have: T.DataType, want: T.DataType) -> bool:
    """Whether every field of `want`, at any depth, is in `have` with the same type."""
    if isinstance(want, T.StructType):
        return isinstance(have, T.StructType) and all(
            f.name in have.fieldNames() and covers(have[f.name].dataType, f.dataType) for f in want.fields)
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and covers(have.elementType, want.elementType)
    return have == want


def require_stored(have: T.StructType, contract: T.StructType, what: str, free: Sequence[str] = ()) -> None:
    """Check the schema that files really have against a contract; columns in `free` may be of any type (partition values)."""
    missing = [f.name for f in contract.fields if f.name not in have.fieldNames()]
    if missing:
        raise ContractError(f"{what} is missing columns {missing}; expected {contract.fieldNames()}")
    wrong = [f"{f.name} is {have[f.name].dataType.simpleString()}, expected {f.dataType.simpleString()}"
             for f in contract.fields if f.name not in free and not covers(have[f.name].dataType, f.dataType)]
    if wrong:
        raise ContractError(f"{what} has wrong types: {'; '.join(wrong)}")


def valid_id(transaction_id: str) -> str:
    """SQL test: a usable transaction ID."""
    return f"({transaction_id} IS NOT NULL AND {transaction_id} NOT IN ({', '.join(repr(v) for v in MISSING_IDS)}))"
