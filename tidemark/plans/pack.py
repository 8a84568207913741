"""The named report pack: every deterministic report of the registry,
written as one Parquet folder per report.

The derived tables and the user-device facts, which the funnels, KPIs, segments,
experiment and device reports add up, are written once as Parquet to a run folder
below ``spark.checkpoint.dir`` and read back: later reports read them instead
of re-running the event aggregation, and a lost executor does not force
recomputing the lineage. The folder goes when the pack is written. A failing
report is recorded and does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.plans.registry import REPORTS, with_facts
from tidemark.sources.io import AppTables, materialize_tables, run_folder, write_reports


def run_report_pack(spark: SparkSession, tables: AppTables, out_dir: str) -> dict[str, str]:
    """Write every report under ``out_dir/<name>``; returns per-report status."""
    built, status = {}, {}
    with run_folder(spark) as folder:
        tables = with_facts(materialize_tables(tables, folder), folder)
        for name, report in REPORTS.items():
            try:
                built[name] = report(tables)
            except Exception as exc:  # noqa: BLE001 - one bad report must not stop the pack
                status[name] = f"{type(exc).__name__}: {exc}".splitlines()[0]
        status.update(write_reports(built, out_dir))
    return status
