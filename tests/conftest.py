import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoptrail.contract import EVENTS, ITEMS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("shoptrail-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


DAY = dt.date(2020, 12, 1)
START = dt.datetime(2020, 12, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def make_events(spark):
    """(user, session, seconds, name, extra columns) rows -> the flat events table."""
    def make(rows):
        full = []
        for user, sid, secs, name, extra in rows:
            row = dict.fromkeys(EVENTS.fieldNames())
            row.update(event_date=DAY, event_ts=START + dt.timedelta(seconds=secs), event_name=name, user_pseudo_id=user,
                       ga_session_id=sid, ga_session_number=1, device_category="desktop", first_medium="organic")
            row.update(extra)
            full.append(tuple(row[c] for c in EVENTS.fieldNames()))
        return spark.createDataFrame(full, EVENTS)
    return make


@pytest.fixture(scope="session")
def make_items(spark):
    """(user, session, seconds, name, revenue) rows -> the flat items table."""
    def make(rows):
        full = []
        for user, sid, secs, name, revenue in rows:
            row = dict.fromkeys(ITEMS.fieldNames())
            row.update(event_date=DAY, event_ts=START + dt.timedelta(seconds=secs), event_name=name, user_pseudo_id=user,
                       ga_session_id=sid, quantity=1, item_revenue_usd=revenue)
            full.append(tuple(row[c] for c in ITEMS.fieldNames()))
        return spark.createDataFrame(full, ITEMS)
    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ws(spark):
    import __spark_entry__ as registered
    return registered.workspace(spark, SF)
