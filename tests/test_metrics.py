"""Rounding helpers agree with exact rational half-up rounding and with the
DuckDB oracle's formula."""

from __future__ import annotations

import random
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import pct2, round_ratio, signed_pct2
from tidemark.plans import oracle


def exact(a: int, b: int, scale: int = 100) -> float:
    q = Fraction(scale * a, b) * 100
    return float(int(q + Fraction(1, 2))) / 100.0


def test_ties(spark):
    df = spark.createDataFrame([(1, 32), (201, 20000), (1, 8), (0, 5), (3, 0)], "a long, b long")
    got = [r[0] for r in df.select(pct2("a", "b")).collect()]
    assert got == [3.13, 1.01, 12.5, 0.0, None]


def test_signed_and_ratio(spark):
    df = spark.createDataFrame([(-1, 32), (5, 3)], "a long, b long")
    got = [tuple(r) for r in df.select(signed_pct2("a", "b"), round_ratio(F.abs("a"), "b")).collect()]
    assert got == [(-3.13, 0.03), (166.67, 1.67)]


def test_random_pairs_match_exact_and_duckdb(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 5000), rnd.randint(1, 5000)) for _ in range(3000)]
    pairs += [(k, 2 ** e) for k in range(1, 60) for e in range(1, 8)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", pct2("a", "b").alias("p")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    duck = {(a, b): p for a, b, p in con.execute(f"SELECT a, b, {oracle.pct2('a', 'b')} FROM t").fetchall()}
    for a, b in pairs:
        assert got[(a, b)] == exact(a, b) == duck[(a, b)], (a, b)


def test_money(spark):
    from decimal import Decimal

    from tidemark.functions import money, money_units

    df = spark.createDataFrame([(10.005, Decimal("10.01")), (-2.5, Decimal("0.10")), (0.1, Decimal("0.20"))], "x double, d decimal(10,2)")
    one = df.agg(F.sum(money_units("x")).alias("x"), F.sum(money_units("d")).alias("d"), F.count("x").alias("n"))
    got = one.select(money("x").alias("a"), money("x", "n").alias("b"), money("d").alias("c")).first()
    assert tuple(got) == (7.61, 2.54, 10.31)  # three decimals are summed before they are rounded
    huge = spark.range(1).select(money(F.lit(9 * 10**18)).alias("a"), money(F.lit(1), F.lit(0)).alias("b")).first()
    assert tuple(huge) == (9e14, None)
