"""Hot keys must not pile up in one task: row shares per output partition with broadcasts and coalescing off."""
import pytest
from pyspark.sql import functions as F

from shoptrail.contract import EVENTS, ITEMS, require_columns
from shoptrail.operators import audit, orders, sessions, tracking

N, PARTITIONS = 90_000, 32
SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(PARTITIONS)}


@pytest.fixture(scope="module")
def big_cluster(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def events(spark, big_cluster, tmp_path_factory):
    """A third of the rows in one session, a third in one user's many sessions, a third spread out."""
    names = "array('page_view', 'view_item', 'begin_checkout', 'purchase', 'purchase', 'session_start')"
    rows = spark.range(0, N, 1, 8).selectExpr(
        "id", "date_add(DATE '2024-01-01', CAST(id % 30 AS INT)) AS event_date",
        "timestamp_micros(1704067200000000 + (id % 30) * 86400000000 + id) AS event_ts",
        f"{names}[CAST(pmod(xxhash64(id, 7), 6) AS INT)] AS event_name",
        "CASE id % 3 WHEN 0 THEN 'bot' WHEN 1 THEN 'hot' ELSE concat('u', id % 5000) END AS user_pseudo_id",
        "CASE id % 3 WHEN 0 THEN 1L WHEN 1 THEN id DIV 9 ELSE id % 30 END AS ga_session_id", "1L AS ga_session_number",
        "'p' AS page_location", "'t' AS page_title", "CAST(NULL AS STRING) AS search_term", "CAST(NULL AS BIGINT) AS engagement_time_msec",
        "'1' AS session_engaged", "'mobile' AS device_category", "'FR' AS country", "'cpc' AS first_medium", "'g' AS first_source",
        "CASE WHEN id % 3 = 0 THEN 'SAME' ELSE CAST(id AS STRING) END AS transaction_id", "10D AS purchase_revenue_usd",
        "1L AS n_items", "1L AS item_quantity")
    rows = rows.withColumns({c: F.expr(f"if(event_name = 'purchase', {c}, NULL)") for c in ("transaction_id", "purchase_revenue_usd")})
    path = str(tmp_path_factory.mktemp("hot"))
    require_columns(rows, EVENTS, "events").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture(scope="module")
def bought(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bought"))
    table = orders.purchases(events)
    assert largest_share(table) < 0.1
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_a_hot_order_id_is_spread_and_counted_once(events, bought):
    total = bought.agg(F.sum("n_events"), F.sum("n_repeats"), F.sum("n_orders")).first()
    sent = events.where("event_name = 'purchase'")
    assert total[0] == sent.count()
    assert total[2] == sent.where("transaction_id <> 'SAME'").count() + 1 and total[1] == total[0] - total[2]


def test_a_hot_session_and_a_hot_user_are_spread(spark, events, bought, tmp_path):
    core = sessions.session_core(events, bought)
    assert largest_share(core) < 0.1
    core.write.parquet(str(tmp_path / "core"))
    table = sessions.with_journey(spark.read.parquet(str(tmp_path / "core")))
    assert largest_share(table) < 0.2      # the hot user alone has most sessions; one task would hold them all
    assert table.where("user_pseudo_id = 'hot'").count() / table.count() > 0.25
    first = core.where("user_pseudo_id = 'hot' AND has_purchase").agg(F.min("start_ts")).first()[0]
    assert table.where("user_pseudo_id = 'hot' AND prior_purchaser").count() == core.where(
        (F.col("user_pseudo_id") == "hot") & (F.col("start_ts") > F.lit(first))).count()


def test_many_orders_at_one_moment_are_spread_over_the_revenue_join(spark, bought):
    at_once = bought.withColumn("hot", F.expr("pmod(xxhash64(transaction_id), 3) = 0")).withColumns({
        "user_pseudo_id": F.expr("if(hot, 'bot', user_pseudo_id)"), "ga_session_id": F.expr("if(hot, 1L, ga_session_id)"),
        "event_ts": F.expr("if(hot, TIMESTAMP '2024-01-01 00:00:00', event_ts)")}).drop("hot")
    items = (at_once.select("user_pseudo_id", "ga_session_id", "event_ts", "event_date").distinct().selectExpr(
        "event_date", "event_ts", "'purchase' AS event_name", "user_pseudo_id", "ga_session_id", "'i' AS item_id", "'n' AS item_name",
        "'c' AS item_category", "1D AS price_usd", "1L AS quantity", "10D AS item_revenue_usd"))
    pairs = audit.revenue_pairs(at_once, require_columns(items, ITEMS, "items"))
    assert largest_share(pairs) < 0.2
    assert pairs.agg(F.sum("n_events")).first()[0] == bought.agg(F.sum("n_events")).first()[0]


def test_the_profile_is_reduced_before_it_is_shuffled(events):
    profile = tracking.event_profile(events)
    assert profile.count() == 30 * 5 and profile.agg(F.sum("n")).first()[0] == N
