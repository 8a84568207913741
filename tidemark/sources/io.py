"""Readers and writers of the five-table app model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint_dir
from tidemark.sources import schemas

# Tables that are written partitioned by day, so date filters prune files.
DAY_COLUMNS = {"sessions": "session_date", "orders": "order_date", "events": "event_day"}


@dataclass(frozen=True)
class AppTables:
    """The five relational tables every report reads."""

    users: DataFrame
    sessions: DataFrame
    events: DataFrame
    orders: DataFrame
    experiments: DataFrame
    # Optional: sessions with their stage counts and order totals
    # (``flags.COUNT_COLS``, ``mart.ORDER_COLS``) from one pass over events.
    # The session mart then aggregates neither events nor orders again.
    session_rollup: DataFrame | None = None
    # Lazily built plans derived from these tables (e.g. the session mart),
    # shared by the reports of one run. Holds DataFrame definitions only.
    memo: dict = field(default_factory=dict, compare=False, repr=False)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in schemas.TABLE_SCHEMAS}

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for one run's intermediate tables below the shared checkpoint
    folder, removed at the end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return a reader over the files: the lineage
    is cut (a lost executor re-reads files instead of recomputing the plan),
    the data is computed exactly once, and later scans keep column pruning and
    filter pushdown."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WrittenRows:
    """Counts the rows of a table, and the NULLs in its required columns, while
    it is written. The counters stand last in the plan, in the tasks that write,
    so every partition counts once, however often an earlier stage ran."""

    def __init__(self, name: str):
        self._name = name
        self._observation = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self._observation, F.count(F.lit(1)).alias("rows"), *null_counts(self._name))

    def result(self) -> dict:
        """``rows`` and ``nulls`` by column; waits for the write."""
        found = dict(self._observation.get)
        return {"rows": found.pop("rows"), "nulls": found}


def null_counts(name: str) -> list[Column]:
    """The NULLs in each column that the table's schema requires."""
    return [F.count_if(F.col(f.name).isNull()).cast("bigint").alias(f.name) for f in schemas.TABLE_SCHEMAS[name].fields if not f.nullable]


def materialize_tables(tables: AppTables, folder: str, names: tuple[str, ...] | None = None, parallelism: int = 4) -> AppTables:
    """Write the derived tables of ``names`` (all by default) once for a
    multi-report job, counting them on the way (``memo["observed"]``); the rest
    stay as they are. The events are never copied, since the largest table
    rarely pays that back; sessions are written as the rollup when there is one,
    of which they are a projection. The tables are independent jobs and are
    written concurrently."""
    frames = tables.as_dict()
    todo = {name: df for name, df in frames.items() if name != "events" and (names is None or name in names)}
    if "sessions" in todo and tables.session_rollup is not None:
        todo["sessions"] = tables.session_rollup
    watches = {name: WrittenRows(name) for name in todo}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        written = pool.map(lambda name: materialize(watches[name].watch(todo[name]), f"{folder}/{name}"), todo)
        done = dict(zip(todo, written))
    rollup = tables.session_rollup
    if rollup is not None and "sessions" in done:
        rollup = done["sessions"]
        done["sessions"] = rollup.select(*schemas.SESSIONS.fieldNames())
    observed = {name: watch.result() for name, watch in watches.items()}
    return AppTables(**(frames | done), session_rollup=rollup, memo={"observed": observed})


def read_app_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> AppTables:
    """Read the five tables from ``{path}/{table}`` as their declared schemas.
    Files that carry types of their own are read by those and cast, so amounts
    stored as doubles are read as well as decimal ones (a double keeps its
    type, so that it isn't rounded row by row); others are parsed by the
    declared schema, without inference."""
    frames = {}
    for name, schema in schemas.TABLE_SCHEMAS.items():
        if fmt not in ("parquet", "orc"):
            frames[name] = spark.read.format(fmt).schema(schema).load(f"{path}/{name}").select(*schema.fieldNames())
            continue
        stored = spark.read.format(fmt).load(f"{path}/{name}")
        frames[name] = stored.select(
            *[
                F.col(f.name) if f.name == "amount" and stored.schema[f.name].dataType == T.DoubleType()
                else F.col(f.name).cast(f.dataType)
                for f in schema.fields
            ]
        )
    return AppTables(**frames)


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partition_bounds: dict[str, tuple[int, int]],
    num_partitions: int = 64,
) -> AppTables:
    """Read the five tables from a relational store over JDBC, each in
    ``num_partitions`` parallel range slices of its primary key.

    ``partition_bounds[table] = (lower, upper)`` is required for every table,
    so that no single task pulls a whole one. Requires the store's JDBC driver
    on the class path; there is none in the test environment."""
    missing = sorted(set(schemas.TABLE_SCHEMAS) - set(partition_bounds))
    if missing:
        raise ValueError(f"partition_bounds lacks {', '.join(missing)}")
    frames = {}
    for name, schema in schemas.TABLE_SCHEMAS.items():
        lower, upper = partition_bounds[name]
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in properties.items():
            reader = reader.option(key, value)
        df = (
            reader.option("partitionColumn", schemas.PRIMARY_KEYS[name])
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(num_partitions))
            .load()
        )
        frames[name] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return AppTables(**frames)


def write_app_tables(tables: AppTables, path: str) -> None:
    """Full-refresh load: every table is replaced (``mode('overwrite')``);
    sessions, orders and events are partitioned by day. Readers may see tables of
    two loads while this runs; ``snapshots.write_snapshot`` spares them that.

    A ``rebalance`` hint by the day precedes each partitioned write, so each
    day's rows are gathered into few files (not one file per shuffle partition
    per day), while AQE still splits a day that holds a large share of the
    rows into several tasks. The other tables are written as they come."""
    for name, df in tables.as_dict().items():
        out = df.select(*schemas.TABLE_SCHEMAS[name].fieldNames())
        part = DAY_COLUMNS.get(name)
        if name == "events":
            out = out.withColumn(part, F.to_date("timestamp"))
        if part:
            out.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{path}/{name}")
        else:
            out.write.mode("overwrite").parquet(f"{path}/{name}")


def write_reports(reports: dict[str, DataFrame], path: str, parallelism: int = 4) -> dict[str, str]:
    """Write each named report to its own Parquet folder. A failing report is
    recorded and does not stop the others (the reference's report-pack
    behaviour). Up to ``parallelism`` reports are submitted concurrently: the
    reports are small jobs, and concurrent jobs keep the cluster busy while
    each one waits on its own stage boundaries. Returns ``{name: "ok" | error
    text}``."""

    def write(item: tuple[str, DataFrame]) -> tuple[str, str]:
        name, df = item
        try:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return name, "ok"
        except Exception as exc:  # noqa: BLE001 - reported, not swallowed silently
            return name, f"{type(exc).__name__}: {exc}".splitlines()[0]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return dict(pool.map(write, reports.items()))
