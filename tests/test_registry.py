"""Every registered question equals its DuckDB oracle on sf0.001."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from __spark_entry__ import entry, oracle_sql, queries as every_query
from ledgerlens.plans.registry import QUERIES


def queries():
    """The ledger questions; other queries have tests of their own."""
    return QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(queries()) <= set(oracle_sql()) and set(oracle_sql()) <= set(every_query())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert canon(df.columns, rows) == canon(res.columns, res.fetchall())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["address", "total_value"]
    assert len(df.collect()) <= 10


LIST_QUESTIONS = ["top_contracts", "contract_monthly_mean_gas", "top_contract_monthly_mean_gas",
                  "scam_monthly_mean", "scam_top_totals", "scam_id_monthly_mean",
                  "scam_leader_monthly_mean", "broadcast_count_lookup"]


@pytest.mark.parametrize("name", LIST_QUESTIONS)
def test_shuffle_fallback_matches_oracle(spark, con, name):
    """With the broadcast bound at 0 every list goes through the shuffle path."""
    spark.conf.set("spark.ledgerlens.broadcastMaxRows", "0")
    try:
        df = queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.ledgerlens.broadcastMaxRows")
    res = con.sql(oracle_sql()[name])
    assert canon(df.columns, rows) == canon(res.columns, res.fetchall())
    if name in ("contract_monthly_mean_gas", "scam_monthly_mean", "scam_top_totals"):
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


@pytest.mark.parametrize("name", ["monthly_mean_value", "top_contracts", "scam_top_totals",
                                  "hex_overhead_bits", "line_arity_profile", "reject_report"])
def test_other_zone_and_ansi_off_match_oracle(spark, con, name):
    """Answers do not depend on the session time zone or ANSI mode."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        df = queries()[name](spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    res = con.sql(oracle_sql()[name])
    assert canon(df.columns, rows) == canon(res.columns, res.fetchall())


def test_entry_without_the_optional_libraries():
    """A library that only the training-data operators use may be missing."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = ("import sys; sys.modules['tokenizers'] = sys.modules['regex'] = sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))")
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"]
