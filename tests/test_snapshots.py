"""Consistent loads, refresh by day, and what is counted while writing."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import day, event, experiment, make_tables, order, session, user
from tidemark.operators import audit
from tidemark.plans import reports
from tidemark.sources import schemas, snapshots, versions
from tidemark.sources.driver_data import load_app_tables
from tidemark.sources.io import AppTables, WrittenRows, materialize_tables, run_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a: AppTables, b: AppTables) -> None:
    for name, schema in schemas.TABLE_SCHEMAS.items():
        cols = schema.fieldNames()
        left, right = (t.as_dict()[name].select(*cols) for t in (a, b))
        assert left.schema.fieldNames() == right.schema.fieldNames()
        assert rows(left) == rows(right), name


def files(root, name=""):
    found = {}
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet") and name in folder:
                path = os.path.join(folder, n)
                found[os.path.relpath(path, root)] = os.path.getmtime(path)
    return found


@pytest.fixture
def raw(spark, tmp_path):
    """A copy of the raw tables whose events can be changed."""
    for name in ("events", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(str(tmp_path / "raw" / f"{name}.parquet"))
    return str(tmp_path / "raw")


def test_snapshot_reads_back(spark, tmp_path):
    tables = load_app_tables(spark, SF_SMALL)
    assert snapshots.write_snapshot(spark, tables, str(tmp_path)) == 1
    back = snapshots.read_snapshot(spark, str(tmp_path))
    same(back, tables)
    assert rows(reports.table_counts(back)) == rows(reports.table_counts(tables))
    assert rows(audit.integrity_audit(back)) == rows(audit.integrity_audit(tables))


def test_a_load_that_dies_leaves_the_old_set(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_snapshot(spark, root)
    old = make_tables(spark, users=[user(1)], sessions=[session(10, 1)], events=[event(10, 1, "Search")], orders=[order(1, 1, 10, 5)])
    new = make_tables(spark, users=[user(2)], sessions=[session(20, 2)], events=[event(20, 2, "Search")], orders=[order(2, 2, 20, 7)])
    snapshots.write_snapshot(spark, old, root)
    for dies_at in ("sessions", "experiments"):
        write = snapshots._write

        def broken(spark_, tables, name, *rest, dies_at=dies_at, write=write):
            if name == dies_at:
                raise OSError("lost")
            return write(spark_, tables, name, *rest)

        with monkeypatch.context() as patch:
            patch.setattr(snapshots, "_write", broken)
            with pytest.raises(OSError, match="lost"):
                snapshots.write_snapshot(spark, new, root)
        same(snapshots.read_snapshot(spark, root), old)
    snapshots.write_snapshot(spark, new, root)
    same(snapshots.read_snapshot(spark, root), new)
    same(snapshots.read_snapshot(spark, root, 1), old)
    # What the dead loads and the old version left goes with the clean-up.
    assert len(snapshots.remove_old(spark, root)) > 5
    same(snapshots.read_snapshot(spark, root), new)
    assert len(versions.numbers(spark, root)) == 1 and snapshots.remove_old(spark, root) == []


def test_refreshing_a_day_equals_a_full_rebuild(spark, raw, tmp_path):
    root = str(tmp_path / "store")
    snapshots.write_snapshot(spark, load_app_tables(spark, raw), root)
    before = files(root)
    # Late events of one day, for known and new users, and purchases among them.
    events = spark.read.parquet(f"{raw}/events.parquet")
    changed = events.agg(F.min(F.to_date("ts")).alias("d")).first()["d"] + dt.timedelta(days=3)
    late = events.filter(F.to_date("ts") == F.date_add(F.lit(changed), 1)).withColumns(
        {"ts": F.col("ts") - F.expr("INTERVAL 1 DAY"), "event_id": F.col("event_id") + 10_000_000, "event_type": F.lit("purchase")}
    )
    assert late.count() > 0
    late.write.mode("append").parquet(f"{raw}/events.parquet")
    fresh = load_app_tables(spark, raw)
    assert snapshots.refresh_days(spark, fresh, root, [changed]) == 2
    back = snapshots.read_snapshot(spark, root)
    same(back, fresh)
    after = files(root)
    assert {f: after[f] for f in before} == before  # nothing that was there is written again
    added = set(after) - set(before)
    by_day = [f for f in added if "=" in f]
    assert by_day and all(f"={changed.isoformat()}" in f for f in by_day)
    assert rows(reports.funnel_by_device(back)) == rows(reports.funnel_by_device(fresh))


def test_a_day_can_vanish_and_rows_without_a_day_refresh(spark, tmp_path):
    root = str(tmp_path)
    shared = {"users": [user(1)], "experiments": [experiment(1, schemas.GROUP_A)]}
    first = make_tables(spark, sessions=[session(10, 1, 0), session(11, 1, 1)], events=[event(10, 1, "Search", 0)], **shared)
    no_time = F.when(F.col("event_id") > 0, F.col("timestamp"))
    stray = make_tables(spark, events=[event(10, 1, "Search", 0, eid=-1)], **shared).events.withColumn("timestamp", no_time)
    first = AppTables(first.users, first.sessions, first.events.unionByName(stray), first.orders, first.experiments)
    snapshots.write_snapshot(spark, first, root)
    same(snapshots.read_snapshot(spark, root), first)
    second = make_tables(spark, sessions=[session(10, 1, 0)], events=[event(10, 1, "Search", 0, eid=5)], **shared)
    snapshots.refresh_days(spark, second, root, [day(0), day(1), None])
    same(snapshots.read_snapshot(spark, root), second)


def test_counts_while_writing_equal_counts_by_scan(spark):
    blank = lambda t, c: t.withColumn(c, F.when(F.col("user_id") % 7 != 0, F.col(c)))
    t = load_app_tables(spark, SF_SMALL)
    spoiled = AppTables(blank(t.users, "city"), blank(t.sessions, "device_type"), t.events, blank(t.orders, "category"), t.experiments)
    with run_folder(spark) as folder:
        written = materialize_tables(spoiled, folder)
        assert set(written.memo["observed"]) == {"users", "sessions", "orders", "experiments"}
        assert written.memo["observed"]["users"]["nulls"]["city"] > 0
        assert rows(audit.integrity_audit(written)) == rows(audit.integrity_audit(spoiled))
        assert rows(reports.table_counts(written)) == rows(reports.table_counts(spoiled))
        # No scan for NULLs of what was counted: its columns are read for keys alone.
        plan = audit.integrity_audit(written)._jdf.queryExecution().executedPlan().toString()
        read = [line.partition("ReadSchema: ")[2] for line in plan.splitlines() if "FileScan" in line]
        assert read and not any(c in x for x in read for c in ("city", "device_type", "category"))


def test_a_repeated_stage_counts_once(spark, tmp_path):
    """The counters stand behind the last exchange."""
    watch = WrittenRows("users")
    users = load_app_tables(spark, SF_SMALL).users.repartition(7)
    watch.watch(users).write.parquet(str(tmp_path / "u"))
    assert watch.result()["rows"] == users.count()
