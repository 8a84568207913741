"""Every registered key against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE
from oracle_compare import compare, duck
from tidemark.plans import registry

ORACLE_KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_key_matches_oracle(spark, con, key):
    res = compare(spark, SF_ORACLE, key, con)
    assert res["status"] == "ok", res


def test_every_key_has_oracle_or_is_rows_only():
    rows_only = set(registry.queries()) - set(registry.oracle_sql())
    assert rows_only == {"model_metrics", "cart_risk_scores"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "device_type" in df.columns
