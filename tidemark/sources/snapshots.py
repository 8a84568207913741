"""Consistent snapshots of the five app tables, refreshed by day.

A load writes every table to a folder of its own and then publishes one version
(``versions``) that names them all, so readers never mix two loads. Sessions,
orders and events are stored by day, and a session never leaves its day: a
refresh writes the changed days alone to a new folder, and the new version takes
those days from there and all others from where they already lie. Users and
experiments, which are small and depend on all days, are written anew.

A version also keeps each table's schema as stored, and the rows and NULLs that
were counted while its tables were written, where the whole table was.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas, versions
from tidemark.sources.io import DAY_COLUMNS, AppTables, WrittenRows

#: The folder of rows without a day, as Spark names it.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def write_snapshot(spark: SparkSession, tables: AppTables, root: str) -> int:
    """Full load; gives the version."""
    return versions.publish(spark, root, {name: _write(spark, tables, name, root) for name in schemas.TABLE_SCHEMAS})


def refresh_days(spark: SparkSession, tables: AppTables, root: str, days: list[dt.date]) -> int:
    """A version in which ``days`` (None: the rows without a day) are as
    ``tables`` has them now, and users and experiments too. The other days'
    files are neither read nor written. Gives the version."""
    last = versions.content(spark, root)
    if last is None:
        raise ValueError(f"there is no snapshot to refresh in {root}")
    names = {NO_DAY if d is None else d.isoformat() for d in days}
    fresh = {name: _write(spark, tables, name, root, days if name in DAY_COLUMNS else None) for name in schemas.TABLE_SCHEMAS}
    for name in DAY_COLUMNS:
        if fresh[name]["schema"] != last[name]["schema"]:
            raise ValueError(f"{name} has another schema than the snapshot in {root}: load it in full")
        kept = {day: folder for day, folder in last[name]["days"].items() if day not in names}
        fresh[name]["days"] = kept | fresh[name]["days"]
    return versions.publish(spark, root, fresh)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> AppTables:
    """The tables of one version, the newest by default."""
    found = versions.content(spark, root, number)
    if found is None:
        raise ValueError(f"no snapshot was published in {root}")
    observed = {name: found[name]["counted"] for name in found if "counted" in found[name]}
    frames = {name: _read(spark, name, root, found[name]) for name in schemas.TABLE_SCHEMAS}
    return AppTables(**frames, memo={"observed": observed})


def remove_old(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Withdraw all versions but the last ``keep`` and delete the folders that
    no version names any more; gives their names."""
    used = {f for v in versions.forget(spark, root, keep) for t in v.values() for f in [*t.get("days", {}).values(), t.get("folder")]}
    gone = [f for f in versions.children(spark, root) if f.startswith("data-") and f not in used]
    for folder in gone:
        versions.remove(spark, f"{root}/{folder}")
    return gone


def _write(spark: SparkSession, tables: AppTables, name: str, root: str, days: list[dt.date | None] | None = None) -> dict:
    """Write a table, or some of its days, to a fresh folder."""
    folder = f"data-{name}-{uuid.uuid4().hex[:12]}"
    watch = WrittenRows(name)
    out = tables.as_dict()[name].select(*schemas.TABLE_SCHEMAS[name].fieldNames())
    if name not in DAY_COLUMNS:
        watch.watch(out).write.parquet(f"{root}/{folder}")
        return {"folder": folder, "schema": _ddl(out), "counted": watch.result()}
    day = DAY_COLUMNS[name]
    if name == "events":
        out = out.withColumn(day, F.to_date("timestamp"))
    if days is not None:
        out = out.filter(F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() if None in days else F.lit(False)))
    # Each day's rows are gathered into few files; AQE splits a large day.
    watch.watch(out.hint("rebalance", day)).write.partitionBy(day).parquet(f"{root}/{folder}")
    written = [p.partition("=")[2] for p in versions.children(spark, f"{root}/{folder}") if p.startswith(f"{day}=")]
    counted = {"counted": watch.result()} if days is None else {}
    return {"days": {d: folder for d in written}, "schema": _ddl(out)} | counted


def _ddl(df: DataFrame) -> str:
    """Names and types; whether NULLs occur differs from load to load."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _read(spark: SparkSession, name: str, root: str, found: dict) -> DataFrame:
    stored = found["schema"]
    if "folder" in found:
        return spark.read.schema(stored).parquet(f"{root}/{found['folder']}")
    by_folder: dict[str, list[str]] = {}
    for day, folder in found["days"].items():
        by_folder.setdefault(folder, []).append(f"{root}/{folder}/{DAY_COLUMNS[name]}={day}")
    columns = schemas.TABLE_SCHEMAS[name].fieldNames()
    parts = [
        spark.read.schema(stored).option("basePath", f"{root}/{folder}").parquet(*paths).select(*columns)
        for folder, paths in sorted(by_folder.items())
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], stored).select(*columns)
