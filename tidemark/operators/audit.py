"""Integrity audit of the five-table model.

The app model declares primary keys, foreign keys and NOT NULL columns but
nothing enforces them, so the audit reports violations instead:

* ``duplicate_key`` — primary-key values that occur more than once;
* ``null_value``    — NULLs in a column declared NOT NULL;
* ``orphan_key``    — child rows whose (non-NULL) foreign key has no parent.

Tables that were written for this run were counted on the way
(``memo["observed"]``): their NULLs are known, and the audit reads them again for
keys and orphans only. Of the others, a child's NULLs are counted in the same
aggregation as its foreign keys.

Child keys are counted per distinct value before the anti-join (a map-side
combined aggregation), so a hot key that holds a third of the rows reaches
the join as a single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import schemas
from tidemark.sources.io import AppTables

_OUT = ["check_name", "table_name", "column_name", "violations"]


def _row(df: DataFrame, check: str, table: str, column: str, value: F.Column) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        "violations",
    )


def duplicate_keys(tables: AppTables) -> list[DataFrame]:
    out = []
    for table, key in schemas.PRIMARY_KEYS.items():
        per_key = tables.as_dict()[table].groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        out.append(_row(per_key, "duplicate_key", table, key, F.count_if(F.col("_n") > 1)))
    return out


def _keys_of(child: str) -> list[str]:
    return sorted({c for t, c, *_ in schemas.FOREIGN_KEYS if t == child})


def _counted_keys(tables: AppTables, child: str) -> DataFrame:
    """Rows (``_n``) and NULLs of the required columns by the distinct
    combinations of a child's foreign keys: one aggregation, whose exchange the
    checks of the table share."""
    keys = _keys_of(child)
    nulls = [] if child in tables.memo.get("observed", {}) else [c for c in _required(child) if c not in keys]
    return tables.as_dict()[child].groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"_null_{c}") for c in nulls]
    )


def _required(table: str) -> list[str]:
    return [f.name for f in schemas.TABLE_SCHEMAS[table].fields if not f.nullable]


def null_values(tables: AppTables) -> list[DataFrame]:
    """One row per NOT NULL column of each table."""
    observed = tables.memo.get("observed", {})
    out = []
    for table in schemas.TABLE_SCHEMAS:
        required, keys = _required(table), _keys_of(table)
        if table in observed:
            counts = [F.lit(observed[table]["nulls"][c]) for c in required]
            wide = tables.users.sparkSession.range(1)
        elif keys:
            counted = _counted_keys(tables, table)
            per_key = {c: F.sum(F.when(F.col(c).isNull(), F.col("_n"))) if c in keys else F.sum(f"_null_{c}") for c in required}
            wide = counted.agg(*[F.coalesce(n, F.lit(0)).alias(c) for c, n in per_key.items()])
            counts = [F.col(c) for c in required]
        else:
            wide = tables.as_dict()[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
            counts = [F.col(c) for c in required]
        rows = [F.struct(F.lit(c).alias("column_name"), n.cast("bigint").alias("violations")) for c, n in zip(required, counts)]
        out.append(
            wide.select(F.inline(F.array(*rows))).select(
                F.lit("null_value").alias("check_name"), F.lit(table).alias("table_name"), "column_name", "violations"
            )
        )
    return out


def orphan_keys(tables: AppTables) -> list[DataFrame]:
    counted = {child: _counted_keys(tables, child) for child, *_ in schemas.FOREIGN_KEYS}
    out = []
    for child, col, parent, pcol in schemas.FOREIGN_KEYS:
        keys = counted[child].filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum("_n").alias("_n"))
        parents = tables.as_dict()[parent].select(F.col(pcol).alias(col))
        out.append(_row(keys.join(parents, col, "left_anti"), "orphan_key", child, col, F.sum("_n")))
    return out


#: Rows that ``with_defects`` spoils: those whose key is divisible by these.
LOST_USERS, BLANK_DEVICES, DOUBLE_ORDERS, BLANK_CITIES = 41, 37, 50, 23


def with_defects(tables: AppTables) -> AppTables:
    """The tables with defects put into known rows, for checks of the audit:
    users missing, devices and cities blank, orders doubled."""
    users = tables.users.filter(F.col("user_id") % LOST_USERS != 0).withColumn(
        "city", F.when(F.col("user_id") % BLANK_CITIES != 0, F.col("city"))
    )
    sessions = tables.sessions.withColumn("device_type", F.when(F.col("user_id") % BLANK_DEVICES != 0, F.col("device_type")))
    orders = tables.orders.unionByName(tables.orders.filter(F.col("order_id") % DOUBLE_ORDERS == 0))
    return AppTables(users, sessions, tables.events, orders, tables.experiments)


def integrity_audit(tables: AppTables) -> DataFrame:
    """All checks as rows (check_name, table_name, column_name, violations)."""
    frames = duplicate_keys(tables) + null_values(tables) + orphan_keys(tables)
    return reduce(DataFrame.unionByName, frames).select(*_OUT)
