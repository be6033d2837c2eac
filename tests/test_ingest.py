import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from shoptrail.contract import CALENDAR, EVENTS, EXPORT, INVENTORY, ITEMS, ContractError, require_columns
from shoptrail.plans.extract import extract
from shoptrail.plans.workspace import Workspace
from shoptrail.sources import export, tables
from shoptrail.sources import days
from shoptrail.sources.inputs import FlatInputs


def slot(text=None, number=None, single=None, double=None):
    return (text, number, single, double)


def hit(day="20201201", micros=1_606_780_800_000_001, name="page_view", params=(), device="desktop", items=None, txn=None, usd=None):
    return (day, micros, name, "u1", list(params), (device,), ("FR",), ("cpc", "google"), (txn, usd, 2), items)


@pytest.fixture(scope="module")
def nested(spark):
    line = ("sku", "Mug", "Kitchen", 9.5, 2, 19.0)
    rows = [
        hit(params=[("ga_session_id", slot(number=7)), ("ga_session_number", slot(text="3")), ("page_title", slot(number=42)),
                    ("session_engaged", slot(text="1")), ("page_location", slot())]),
        hit(name="view_item", params=[("ga_session_id", slot(text="not a number"))], items=[line, line]),
        hit(name="add_to_cart", items=[]),
        hit(name="scroll", items=[line], params=[("ga_session_id", slot(number=1)), ("ga_session_id", slot(number=2))]),
        hit(day="20201202", name="purchase", items=[line], txn="T", usd=19.0, params=[("value", slot(double=19.0))]),
    ]
    return spark.createDataFrame(rows, EXPORT)


def test_flatten_events_lifts_parameters_from_whichever_slot(nested):
    rows = {r.event_name: r for r in export.flatten_events(nested).collect()}
    v = rows["page_view"]
    assert (v.ga_session_id, v.ga_session_number, v.page_title, v.session_engaged, v.page_location) == (7, 3, "42", "1", None)
    assert v.event_date == dt.date(2020, 12, 1) and v.event_ts.microsecond == 1
    assert (v.device_category, v.country, v.first_medium, v.first_source, v.n_items, v.item_quantity) == ("desktop", "FR", "cpc", "google", None, 2)
    assert rows["view_item"].ga_session_id is None and rows["view_item"].n_items == 2
    assert rows["add_to_cart"].n_items == 0 and rows["scroll"].ga_session_id == 1
    assert (rows["purchase"].transaction_id, rows["purchase"].purchase_revenue_usd) == ("T", 19.0)


def test_flatten_items_keeps_only_ecommerce_lines(nested):
    got = sorted(r.event_name for r in export.flatten_items(nested).collect())
    assert got == ["purchase", "view_item", "view_item"]
    r = export.flatten_items(nested).where("event_name = 'purchase'").first()
    assert (r.item_id, r.item_name, r.item_category, r.price_usd, r.quantity, r.item_revenue_usd) == ("sku", "Mug", "Kitchen", 9.5, 2, 19.0)


def test_inventory_counts_present_and_filled_in_any_slot(nested):
    inv = {(r.event_name, r.param_key): (r.n_present, r.n_nonnull) for r in export.param_inventory(nested).collect()}
    assert inv["page_view", "page_location"] == (1, 0) and inv["purchase", "value"] == (1, 1) and inv["scroll", "ga_session_id"] == (2, 2)


def test_repeated_keys_are_reported(nested):
    r = {x.event_name: x.n_events_with_repeated_keys for x in export.repeated_params(nested).collect()}
    assert r["scroll"] == 1 and r["page_view"] == 0


def test_contract_errors_name_what_is_wrong(spark, nested):
    events = export.flatten_events(nested)
    with pytest.raises(ContractError, match=r"events is missing columns \['country'\]"):
        require_columns(events.drop("country"), EVENTS, "events")
    with pytest.raises(ContractError, match="n_items is string, expected bigint"):
        require_columns(events.withColumn("n_items", F.lit("x")), EVENTS, "events")
    assert require_columns(events.withColumn("extra", F.lit(1)), EVENTS, "events").columns == EVENTS.fieldNames()


def test_check_one_day(nested):
    from shoptrail.sources.driver_tables import nested_export
    events, items = export.check_day(nested, dt.date(2020, 12, 2))
    driver, _ = export.check_day(nested_export(nested.sparkSession, "/root/testdata/sf0.001"), dt.date(2024, 1, 2))
    assert driver.count() > 0
    assert events.count() == 1 and items.count() == 1


def test_extract_by_day_and_read_back(spark, nested, tmp_path):
    out = str(tmp_path)
    extract(nested, out)
    events = tables.read_table(spark, f"{out}/events", EVENTS, "events")
    assert events.schema == EVENTS and events.exceptAll(export.flatten_events(nested)).isEmpty() and events.count() == 5
    one_day = events.where(F.col("event_date") == dt.date(2020, 12, 2))
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and one_day.count() == 1
    # A re-run of one day with other content replaces that day only.
    again = nested.where("event_name = 'purchase'").withColumn("user_pseudo_id", F.lit("u2"))
    extract(again, out, dt.date(2020, 12, 2), dt.date(2020, 12, 2))
    events = tables.read_table(spark, f"{out}/events", EVENTS, "events")
    assert sorted((r.user_pseudo_id, r.event_name) for r in events.collect()) == [
        ("u1", "add_to_cart"), ("u1", "page_view"), ("u1", "scroll"), ("u1", "view_item"), ("u2", "purchase")]
    assert tables.read_table(spark, f"{out}/items", ITEMS, "items").count() == 3
    inventory = spark.read.parquet(f"{out}/param_inventory")
    assert inventory.where("event_name = 'purchase'").count() == 1 and inventory.where("event_name = 'page_view'").count() == 5


def test_export_days_are_pruned_before_they_are_read(spark, nested, tmp_path):
    path = str(tmp_path / "export")
    nested.write.partitionBy("event_date").parquet(path)
    one = export.in_days(tables.read_export(spark, path), dt.date(2020, 12, 2), dt.date(2020, 12, 2))
    plan = export.flatten_events(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "20201202" in plan
    assert export.flatten_events(one).collect() == export.flatten_events(nested.where("event_date = '20201202'")).collect()


def test_flatten_reads_only_the_nested_fields_it_uses(spark, nested, tmp_path):
    path = str(tmp_path / "export")
    nested.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        stored = spark.read.schema(EXPORT).parquet(path)
        schema = export.flatten_events(stored)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "value:struct<string_value:string,int_value:bigint>" in schema and "items:array<struct<item_id:string>>" in schema


def test_days_are_inclusive(nested):
    assert export.in_days(nested, dt.date(2020, 12, 1), dt.date(2020, 12, 1)).count() == 4
    assert export.in_days(nested, dt.date(2020, 12, 1), dt.date(2020, 12, 2)).count() == 5
    assert export.in_days(nested, dt.date(2020, 12, 3), None).count() == 0


def test_merged_schemas_union_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T.StructType([CALENDAR["date"], CALENDAR["label"]])
    spark.createDataFrame([(dt.date(2020, 1, 1), "a")], schema).write.parquet(path)
    spark.createDataFrame([("b", 1)], "label string, extra int").write.mode("append").parquet(path)
    rows = tables.read_table(spark, path, schema, "t", merge=True).collect()
    assert sorted((r.label, r.date) for r in rows) == [("a", dt.date(2020, 1, 1)), ("b", None)]


def test_stored_tables_without_a_column_or_with_another_type_raise(spark, nested, tmp_path):
    events = export.flatten_events(nested)
    for name, table, message in (("lacks", events.drop("country", "transaction_id"), r"missing columns \['country', 'transaction_id'\]"),
                                 ("type", events.withColumn("n_items", F.lit("x")), "n_items is string, expected bigint")):
        table.write.parquet(f"{tmp_path}/{name}/events")
        for merge in (True, False):
            with pytest.raises(ContractError, match=message):
                tables.read_table(spark, f"{tmp_path}/{name}/events", EVENTS, "events", merge=merge)
        with pytest.raises(ContractError, match=message):
            FlatInputs(spark, f"{tmp_path}/{name}", str(tmp_path))
    nested.select("event_date", "event_name", "event_timestamp").write.parquet(f"{tmp_path}/narrow")
    no_user = nested.withColumn("geo", F.struct(F.lit("x").alias("city")))
    no_user.write.partitionBy("event_date").parquet(f"{tmp_path}/inner")
    for name in ("narrow", "inner"):
        with pytest.raises(ContractError):
            export.check_day(tables.read_export(spark, f"{tmp_path}/{name}"), dt.date(2020, 12, 1))


def test_a_day_run_again_loses_what_it_no_longer_has(spark, nested, tmp_path):
    out, day = str(tmp_path), dt.date(2020, 12, 2)
    count = lambda name, where="true": spark.read.parquet(f"{out}/{name}").where(where).count()
    extract(nested, out)
    others = {n: count(n, "event_date <> DATE '2020-12-02'") for n in ("events", "items", "param_inventory")}
    assert all(count(n, "event_date = DATE '2020-12-02'") > 0 for n in others)
    bare = nested.withColumn("items", F.lit(None).cast(nested.schema["items"].dataType)).withColumn(
        "event_params", F.lit(None).cast(nested.schema["event_params"].dataType))
    extract(bare, out, day, day)
    assert (count("events", "event_date = DATE '2020-12-02'"), count("items", "event_date = DATE '2020-12-02'"),
            count("param_inventory", "event_date = DATE '2020-12-02'")) == (1, 0, 0)
    extract(nested.where("false"), out, day, day)
    assert {n: count(n) for n in others} == others
    (tmp_path / "calendar.csv").write_text("date,label\n")
    (tmp_path / "trading_windows.csv").write_text("window_name,start_date,end_date,role\n")
    extract(bare, f"{out}/bare")
    bare_items = nested.limit(0)
    extract(bare_items, f"{out}/none")
    assert tables.read_or_empty(spark, f"{out}/bare/param_inventory", INVENTORY, "parameter inventory").count() == 0


def test_missing_inputs_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path / "nowhere"), EVENTS, "events")
    (tmp_path / "empty").mkdir()
    with pytest.raises(tables.EmptyInputError, match="no Parquet rows for events"):
        tables.read_table(spark, str(tmp_path / "empty"), EVENTS, "events")


def test_two_labels_on_one_day_are_an_error(spark):
    d = dt.date(2020, 12, 25)
    fine = spark.createDataFrame([(d, "Christmas"), (dt.date(2021, 1, 1), "New Year")], CALENDAR)
    assert tables.unique_dates(fine).count() == 2
    with pytest.raises(Exception, match="two labels for 2020-12-25"):
        tables.unique_dates(fine.unionByName(spark.createDataFrame([(d, "Holiday")], CALENDAR))).collect()


def test_flat_inputs_feed_a_workspace(spark, nested, tmp_path):
    raw, ref = str(tmp_path / "raw"), tmp_path / "ref"
    extract(nested, raw)
    ref.mkdir()
    (ref / "calendar.csv").write_text("date,label\n2020-12-01,Giving Tuesday\n")
    (ref / "trading_windows.csv").write_text("window_name,start_date,end_date,role\nBase,2020-12-01,2020-12-01,baseline\n")
    ws = Workspace(spark, FlatInputs(spark, raw, str(ref)))
    r = ws.daily.first()
    assert (r.date, r.sessions, r.calendar_label) == (dt.date(2020, 12, 1), 2, "Giving Tuesday")


def test_a_run_that_dies_between_tables_changes_nothing(spark, nested, tmp_path, monkeypatch):
    out, day = str(tmp_path / "raw"), dt.date(2020, 12, 2)
    extract(nested, out)
    read = lambda name, schema: sorted(map(str, tables.read_table(spark, f"{out}/{name}", schema, name).collect()))
    before = read("events", EVENTS), read("items", ITEMS)
    again = nested.withColumn("event_name", F.lit("changed"))
    write = days.DayTables.write

    def dies(self, table, rows, run):
        if table == "items":
            raise RuntimeError("lost")
        return write(self, table, rows, run)
    monkeypatch.setattr(days.DayTables, "write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        extract(again, out, day, day)
    assert (read("events", EVENTS), read("items", ITEMS)) == before
    monkeypatch.undo()
    extract(again, out, day, day)
    events = tables.read_table(spark, f"{out}/events", EVENTS, "events")
    assert events.where("event_name = 'changed'").count() == events.where(F.col("event_date") == day).count() > 0
    # what the dead run left is gone: a plain reader sees the same rows
    assert spark.read.parquet(f"{out}/events").count() == events.count()


def test_of_two_runs_at_a_time_one_raises(spark, nested, tmp_path):
    out = str(tmp_path / "raw")
    extract(nested, out)
    store = days.DayTables(spark, out)
    version, now = store.current()
    store.switch(version, now)
    with pytest.raises(days.ConcurrentRunError):
        store.switch(version, now)
    assert store.current() == (version + 1, now)


def test_a_folder_without_a_manifest_is_not_written_over(spark, nested, tmp_path):
    export.flatten_events(nested).write.partitionBy("event_date").parquet(f"{tmp_path}/events")
    with pytest.raises(ValueError, match="without a manifest"):
        extract(nested, str(tmp_path))


@pytest.mark.parametrize("text, shown", (("date,label\n2024-13-45,x\n", "2024-13-45"), ("date,label\nnot a date,x\n", "not a date"),
                                         ("date,label\n2024-01-01\n", "2024-01-01"), ("label,date\nx,2024-01-01\n", "label"),
                                         ("date,label\n2024-01-01,a,b\n", "2024-01-01,a,b")))
def test_lines_of_reference_files_that_do_not_fit_are_shown(spark, tmp_path, text, shown):
    (tmp_path / "calendar.csv").write_text(text)
    with pytest.raises(ContractError, match=shown):
        tables.read_calendar(spark, str(tmp_path / "calendar.csv"))


def test_reference_files_that_fit(spark, tmp_path):
    (tmp_path / "calendar.csv").write_text('date,label\n2024-01-01,"New Year, a holiday"\n2024-01-02,x\n')
    assert [r.label for r in tables.read_calendar(spark, str(tmp_path / "calendar.csv")).collect()] == ["New Year, a holiday", "x"]


def test_every_file_is_looked_at(spark, tmp_path):
    """One file of many lacks a column, another holds a different type; the first one is right."""
    path = str(tmp_path / "raw" / "calendar")
    for i, table in enumerate(("SELECT DATE '2024-01-01' AS date, 'a' AS label", "SELECT DATE '2024-01-02' AS date", "SELECT '2024-01-03' AS date, 'c' AS label")):
        spark.sql(table).write.mode("append").parquet(path)
    found = {(r.column, r.fault) for r in tables.drift(spark, [path], CALENDAR).collect()}
    assert found == {("label", "missing"), ("date", "is string")}
    with pytest.raises(ContractError):
        tables.read_table(spark, path, CALENDAR, "calendar")


def test_the_mapped_export_is_stored_narrow(spark):
    """What the mapping stores has a nested column only in a table whose size is fixed; a session start may have any k."""
    from conftest import SF
    from shoptrail.sources.driver_tables import nested_export
    kept = {}
    made = nested_export(spark, SF, lambda df, name: kept.setdefault(name, df))
    nested_columns = {n: [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct")] for n, df in kept.items()}
    assert nested_columns.pop("export_looks") and nested_columns == {"export": []} and kept["export_looks"].count() == 1100
    odd = kept["export"].where("event_name = 'session_start'").withColumn("k", F.col("k") + 100)
    again = nested_export(spark, SF, lambda df, name: odd if name == "export" else df)
    keys = {tuple(p.key for p in r.event_params) for r in again.collect()}
    assert keys == {("ga_session_id", "ga_session_number", "session_engaged"), ("ga_session_number", "session_engaged")} or keys == {
        ("ga_session_id", "ga_session_number", "session_engaged")}
    assert made.count() == kept["export"].count()
