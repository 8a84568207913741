"""Named report registry: what each key builds from the app tables, one Spark
builder per key, and the DuckDB oracle SQL of every key whose result is
deterministic.

Every builder takes ``(spark, sf_dir)`` and derives the app tables from the
whole test tables in ``sf_dir``, whose files are listed anew each time. Most
return a lazy DataFrame. The split's cut points and the models are computed by
jobs while building; the composite reports (``MATERIALIZED``) write the derived
tables that they read, write the report's rows beside them, and remove the
tables again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import with_text_times
from tidemark.operators import audit, entities
from tidemark.plans import ml, oracle, reports, sql_reports
from tidemark.plans.mart import user_device_facts
from tidemark.sources.driver_data import load_app_tables
from tidemark.sources.io import AppTables, materialize, materialize_tables, run_folder

# Report parameters used by the filtered keys.
FUNNEL_DEVICE = "iOS"
FUNNEL_CHANNEL = "BUILDING"
KPI_CITY = "NATION_7"
KPI_CHANNEL = "AUTOMOBILE"
LEAKAGE_THRESHOLD_PTS = 10.0

Builder = Callable[[SparkSession, str], DataFrame]
Report = Callable[[AppTables], DataFrame]


def _split(tables: AppTables) -> DataFrame:
    return ml.stratified_split(ml.cart_features(tables))


#: Every deterministic report.
REPORTS: dict[str, Report] = {
    "funnel_by_device": reports.funnel_by_device,
    "funnel_by_device_weekly": reports.funnel_by_device_weekly,
    "funnel_sessions": reports.funnel_sessions,
    "funnel_sessions_all": lambda t: reports.funnel_sessions(t, device_type="All Devices", channel="All Channels"),
    "funnel_sessions_ios": lambda t: reports.funnel_sessions(t, device_type=FUNNEL_DEVICE),
    "funnel_sessions_channel": lambda t: reports.funnel_sessions(t, channel=FUNNEL_CHANNEL),
    "retention_by_channel": reports.retention_by_channel,
    "retention_grid": reports.retention_grid,
    "retention_validation": reports.retention_validation,
    "acquisition_share": reports.acquisition_share,
    "business_kpis": reports.business_kpis,
    "business_kpis_filtered": lambda t: reports.business_kpis(t, city=KPI_CITY, channel=KPI_CHANNEL),
    "business_kpis_all": lambda t: reports.business_kpis(t, city="All Regions", channel="All Channels"),
    "kpi_text": reports.kpi_text,
    "topline_kpis": reports.topline_kpis,
    "filter_options": reports.filter_options,
    "table_counts": reports.table_counts,
    "segment_performance": reports.segment_performance,
    "segment_by_channel": reports.segment_by_channel,
    "ab_results": reports.ab_results,
    "ab_raw": reports.ab_raw,
    "ab_lift": reports.ab_lift,
    "ab_significance": reports.ab_significance,
    "ab_pvalue": reports.ab_pvalue,
    "device_checkout": reports.device_checkout,
    "device_leakage": lambda t: reports.device_leakage(t, threshold_pts=LEAKAGE_THRESHOLD_PTS),
    "sessions_built": lambda t: t.sessions,
    "user_active_days": lambda t: entities.active_days(t.sessions),
    "user_segments": lambda t: t.users,
    "experiment_assignment": lambda t: t.experiments,
    "orders_built": lambda t: t.orders,
    "events_text": lambda t: with_text_times(t.events),
    "orders_text": lambda t: with_text_times(t.orders),
    "past_purchases": ml.past_purchases,
    "cart_features": ml.cart_features,
    "feature_sample": lambda t: ml.feature_sample(ml.cart_features(t)),
    "label_distribution": lambda t: ml.label_distribution(ml.cart_features(t)),
    "stratified_split": lambda t: _split(t).select("session_id", "abandoned", "split"),
    "class_weights": lambda t: ml.class_weights(_split(t)),
    "feature_scaling": lambda t: ml.feature_scaling(_split(t)),
    "rule_report": lambda t: ml.rule_report(_split(t)),
    "risk_bands": lambda t: ml.rule_risk(ml.session_features(t)),
    "funnel_by_device_sql": sql_reports.funnel_by_device_sql,
    "retention_grid_sql": sql_reports.retention_grid_sql,
    "topline_kpis_sql": sql_reports.topline_kpis_sql,
    "business_kpis_sql": sql_reports.business_kpis_sql,
    "business_kpis_filtered_sql": lambda t: sql_reports.business_kpis_sql(t, city=KPI_CITY, channel=KPI_CHANNEL),
    "integrity_audit": audit.integrity_audit,
    "integrity_audit_defects": lambda t: audit.integrity_audit(audit.with_defects(t)),
    "briefing_context": reports.briefing_context,
    "briefing_text": reports.briefing_text,
}

#: Reports that read derived tables many times, and the tables that are written
#: for them first.
MATERIALIZED = {
    "integrity_audit": ("users", "sessions", "orders"),
    "integrity_audit_defects": ("users", "sessions", "orders"),
    "briefing_context": ("users", "sessions"),
    "briefing_text": ("users", "sessions"),
}

#: Reports that depend on the forest's random choices.
MODEL_REPORTS: dict[str, Report] = {
    "model_metrics": ml.model_metrics_report,
    "cart_risk_scores": ml.cart_risk_scores,
}


def _lazy(report: Report) -> Builder:
    return lambda spark, sf_dir: report(load_app_tables(spark, sf_dir))


def _materialized(report: Report, names: tuple[str, ...]) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        with run_folder(spark) as folder:
            tables = materialize_tables(load_app_tables(spark, sf_dir), folder, names)
            return materialize(report(tables), f"{folder}-result")

    return build


def with_facts(tables: AppTables, folder: str) -> AppTables:
    """The tables with their user-device facts written to ``folder``, so that
    the reports over them share one scan of the mart."""
    tables.memo["user_device_facts"] = materialize(user_device_facts(tables), f"{folder}/user_device_facts")
    return tables


def queries() -> dict[str, Builder]:
    found = {name: _materialized(r, MATERIALIZED[name]) if name in MATERIALIZED else _lazy(r) for name, r in REPORTS.items()}
    return found | {name: _lazy(r) for name, r in MODEL_REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "funnel_by_device": oracle.funnel_by_device(),
        "funnel_by_device_weekly": oracle.funnel_by_device_weekly(),
        "funnel_sessions": oracle.funnel_sessions(),
        "funnel_sessions_all": oracle.funnel_sessions(),
        "funnel_sessions_ios": oracle.funnel_sessions(device_type=FUNNEL_DEVICE),
        "funnel_sessions_channel": oracle.funnel_sessions(channel=FUNNEL_CHANNEL),
        "retention_by_channel": oracle.retention_by_channel(),
        "retention_grid": oracle.retention_grid(),
        "retention_validation": oracle.retention_validation(),
        "acquisition_share": oracle.acquisition_share(),
        "business_kpis": oracle.business_kpis(),
        "business_kpis_filtered": oracle.business_kpis(city=KPI_CITY, channel=KPI_CHANNEL),
        "business_kpis_all": oracle.business_kpis(),
        "kpi_text": oracle.kpi_text(),
        "topline_kpis": oracle.topline_kpis(),
        "filter_options": oracle.filter_options(),
        "table_counts": oracle.table_counts(),
        "segment_performance": oracle.segment_performance(),
        "segment_by_channel": oracle.segment_by_channel(),
        "ab_results": oracle.ab_results(),
        "ab_raw": oracle.ab_raw(),
        "ab_lift": oracle.ab_lift(),
        "ab_significance": oracle.ab_significance(),
        "ab_pvalue": oracle.ab_pvalue(),
        "device_checkout": oracle.device_checkout(),
        "device_leakage": oracle.device_leakage(LEAKAGE_THRESHOLD_PTS),
        "sessions_built": oracle.sessions_built(),
        "user_active_days": oracle.user_active_days(),
        "user_segments": oracle.user_segments(),
        "experiment_assignment": oracle.experiment_assignment(),
        "orders_built": oracle.orders_built(),
        "events_text": oracle.events_text(),
        "orders_text": oracle.orders_text(),
        "past_purchases": oracle.past_purchases(),
        "cart_features": oracle.cart_features(),
        "feature_sample": oracle.feature_sample(),
        "label_distribution": oracle.label_distribution(),
        "stratified_split": oracle.stratified_split(),
        "class_weights": oracle.class_weights(),
        "feature_scaling": oracle.feature_scaling(),
        "rule_report": oracle.rule_report(),
        "risk_bands": oracle.risk_bands(),
        "funnel_by_device_sql": oracle.funnel_by_device(),
        "retention_grid_sql": oracle.retention_grid(),
        "topline_kpis_sql": oracle.topline_kpis(),
        "business_kpis_sql": oracle.business_kpis(),
        "business_kpis_filtered_sql": oracle.business_kpis(city=KPI_CITY, channel=KPI_CHANNEL),
        "integrity_audit": oracle.integrity_audit(),
        "integrity_audit_defects": oracle.integrity_audit(defects=True),
        "briefing_context": oracle.briefing_context(),
        "briefing_text": oracle.briefing_text(),
    }
