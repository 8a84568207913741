"""Full-refresh write / typed read of the app tables, the materialised
report pack, and the parameterised SQL path."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import event, make_tables, order, session, user
from tidemark.functions import money_text, none_if_all, number_text, percent_text, with_text_times
from tidemark.plans import registry, reports, sql_reports
from tidemark.plans.mart import user_device_facts
from tidemark.plans.pack import run_report_pack
from tidemark.sources import schemas
from tidemark.sources.driver_data import load_app_tables
from tidemark.session import checkpoint_dir
from tidemark.sources.io import materialize_tables, read_app_tables, read_jdbc_tables, run_folder, write_app_tables


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_write_then_read_back_is_identical(spark):
    tables = load_app_tables(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="tidemark-io-")
    write_app_tables(tables, out)
    write_app_tables(tables, out)  # overwrite, not append
    back = read_app_tables(spark, out)
    for name, df in tables.as_dict().items():
        got = back.as_dict()[name]
        assert got.schema.fieldNames() == schemas.TABLE_SCHEMAS[name].fieldNames()
        assert _sorted(got) == _sorted(df.select(*schemas.TABLE_SCHEMAS[name].fieldNames())), name
    assert os.path.isdir(os.path.join(out, "sessions"))
    assert any(p.startswith("session_date=") for p in os.listdir(os.path.join(out, "sessions")))
    # reports over the re-read tables (no rollup) equal those over the derived ones
    assert _sorted(reports.funnel_by_device(back)) == _sorted(reports.funnel_by_device(tables))


def test_materialized_tables_give_same_reports(spark):
    tables = load_app_tables(spark, SF_SMALL)
    with run_folder(spark) as folder:
        mat = materialize_tables(tables, folder)
        assert _sorted(reports.ab_results(mat)) == _sorted(reports.ab_results(tables))
        assert _sorted(reports.segment_performance(mat)) == _sorted(reports.segment_performance(tables))
    assert not os.path.exists(folder)


@pytest.mark.parametrize("key", registry.MATERIALIZED)
def test_only_the_result_is_left(spark, key):
    shared = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    assert registry.queries()[key](spark, SF_SMALL).count() > 0
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and all(name.endswith("-result") for name in left)


def tables_read(df) -> set[str]:
    """Folders that the plan reads."""
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}


FACT_REPORTS = ["funnel_by_device", "funnel_sessions", "funnel_sessions_ios", "business_kpis", "topline_kpis"] + [
    "segment_performance", "ab_results", "ab_raw", "ab_lift", "ab_significance", "ab_pvalue", "device_checkout", "device_leakage"
]


def test_a_pack_scans_the_mart_once_for_all_reports_over_it(spark):
    tables = load_app_tables(spark, SF_SMALL)
    with run_folder(spark) as folder:
        written = materialize_tables(tables, folder)
        facts = user_device_facts(written)
        assert tables_read(facts) == {"sessions"}
        assert facts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        packed = registry.with_facts(written, folder)
        for key in FACT_REPORTS:
            df = registry.REPORTS[key](packed)
            read = tables_read(df)
            assert "user_device_facts" in read and "sessions" not in read and "events.parquet" not in read, (key, read)
            assert _sorted(df) == _sorted(registry.REPORTS[key](tables)), key


def test_words_for_everything_are_no_filter(spark):
    tables = load_app_tables(spark, SF_SMALL)
    assert none_if_all("city", "All Regions") is None and none_if_all("city", "All Devices") == "All Devices"
    every = reports.business_kpis(tables)
    assert _sorted(reports.business_kpis(tables, "All Regions", "All Channels")) == _sorted(every)
    assert reports.business_kpis(tables, "All Channels").first().total_revenue == 0.0


def test_text_output(spark):
    df = spark.createDataFrame([(1234567.891, -0.5, None)], "a double, b double, c double")
    out = df.select(
        money_text("a"), money_text("a", grouped=False), number_text("a", 0), percent_text("b"), percent_text("a", 1), money_text("c")
    ).first()
    assert tuple(out) == ("$1,234,567.89", "$1234567.89", "1,234,568", "-0.50%", "1234567.9%", None)
    shown = with_text_times(make_tables(spark, events=[event(1, 1, "Search", 2, 3661)]).events).first()
    assert shown.timestamp == "2024-01-03 01:01:01"


def test_an_appended_file_is_seen(spark, tmp_path):
    for name in ("events", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))

    def events():
        rows = registry.queries()["table_counts"](spark, str(tmp_path)).filter("table_name = 'events'")
        return rows.first().row_count

    first = events()
    spark.read.parquet(f"{SF_SMALL}/events.parquet").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert first == spark.read.parquet(f"{SF_SMALL}/events.parquet").count() and events() == 2 * first


def test_decimal_amounts_are_read_as_they_are(spark, tmp_path):
    tables = make_tables(
        spark, users=[user(1)], sessions=[session(10, 1)], events=[event(10, 1, "Purchase")],
        orders=[order(1, 1, 10, "10.10"), order(2, 1, 10, "0.20"), order(3, 1, 10, "20.00")],
    )
    write_app_tables(tables, str(tmp_path))
    back = read_app_tables(spark, str(tmp_path))
    assert back.orders.schema["amount"].dataType.simpleString() == "decimal(10,2)"
    kpi = reports.business_kpis(back).first()
    assert (kpi.total_revenue, kpi.avg_order_value) == (30.3, 10.1)
    for name, df in back.as_dict().items():
        if name == "orders":
            df = df.withColumn("amount", F.col("amount").cast("double") + 0.005)
        df.write.parquet(f"{tmp_path}/doubles/{name}")
    kpi = reports.business_kpis(read_app_tables(spark, f"{tmp_path}/doubles")).first()
    assert kpi.total_revenue == 30.32  # 30.315: three decimals are summed before rounding


def test_jdbc_needs_bounds_of_every_table(spark):
    with pytest.raises(ValueError, match="events"):
        read_jdbc_tables(spark, "jdbc:x", {}, {"users": (1, 9)})


def test_a_cluster_needs_a_shared_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Elsewhere)


def test_report_pack_writes_every_report(spark):
    tables = load_app_tables(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="tidemark-pack-")
    status = run_report_pack(spark, tables, out)
    assert status and all(v == "ok" for v in status.values()), status
    assert set(status) == set(registry.REPORTS) == set(registry.oracle_sql())
    assert set(registry.queries()) - set(status) == set(registry.MODEL_REPORTS)
    back = spark.read.parquet(os.path.join(out, "funnel_sessions"))
    assert back.count() == 6


def test_sql_parameters_none_means_no_filter(spark):
    tables = load_app_tables(spark, SF_SMALL)
    df_none = sql_reports.business_kpis_sql(tables)
    assert _sorted(df_none) == _sorted(reports.business_kpis(tables))
    df_empty = sql_reports.business_kpis_sql(tables, city="")
    assert df_empty.collect()[0]["total_revenue"] == 0.0
    city = tables.users.select("city").orderBy("city").first()[0]
    assert _sorted(sql_reports.business_kpis_sql(tables, city=city)) == _sorted(
        reports.business_kpis(tables, city=city)
    )


def test_display_names(spark):
    tables = load_app_tables(spark, SF_SMALL)
    df = reports.with_display_names(reports.funnel_sessions(tables), "funnel_sessions")
    assert "Step Drop-off %" in df.columns and "stage_idx" in df.columns
    assert df.filter(F.col("Funnel Stage") == "App Open").count() == 1
