"""Small column helpers used by every operator."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..contract import MONEY_TOTAL


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, NULL when the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def total_sql(amount: str) -> str:
    """Order-independent sum of a money expression as SQL text, 0 when nothing was added."""
    return f"CAST(coalesce(sum(CAST({amount} AS {MONEY_TOTAL})), 0) AS DOUBLE)"


def exprs(columns: dict[str, str]) -> list[Column]:
    """SQL expressions by result name."""
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def weighted(sessions: DataFrame) -> DataFrame:
    """A session table, or cells of one, with the number of sessions that each row stands for."""
    return sessions if "n_sessions" in sessions.columns else sessions.withColumn("n_sessions", F.lit(1).cast("long"))


def sessions_sql(rule: str = "TRUE") -> str:
    """The number of sessions of a weighted table that a rule holds for, as SQL text."""
    return f"coalesce(sum(n_sessions) FILTER (WHERE {rule}), 0L)"


def iso_week(date: Column) -> Column:
    """ISO week label such as 2020-W53."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def week_start(date: Column) -> Column:
    return F.trunc(date, "week")


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery, so no join is needed to attach it."""
    return df.select(F.struct("*")).scalar()
