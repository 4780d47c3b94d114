"""Plan-shape checks for the properties the design relies on at scale."""

import re

import pytest

from conftest import SF_SMALL
from ledgerlens.plans.registry import QUERIES


def plan_of(spark, name):
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES[name](spark, SF_SMALL)
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def exchanges(plan):
    """Exchange lines other than the fixture's redistribution of its input scan."""
    return [l for l in plan.splitlines() if "Exchange" in l and "REPARTITION_BY_NUM" not in l
            and "BroadcastExchange" not in l]


MONTHLY = ["monthly_count", "monthly_mean_value", "monthly_mean_gas_price",
           "listed_address_monthly_mean_gas"]


@pytest.mark.parametrize("name", MONTHLY)
def test_monthly_questions_shuffle_only_partial_rows(spark, name):
    plan = plan_of(spark, name)
    ex = exchanges(plan)
    # sums: partial rows per month and chunk, then the chunks of each month
    assert len(ex) == (1 if name == "monthly_count" else 2) and all("hashpartitioning(month" in e for e in ex)
    # the exchange sits between a partial and a final aggregate
    lines = plan.splitlines()
    i = lines.index(ex[-1])
    assert "HashAggregate" in lines[i - 1] and "HashAggregate" in lines[i + 1]
    assert "partial_" in lines[i + 1]


@pytest.mark.parametrize("name", ["contract_monthly_mean_gas", "scam_monthly_mean",
                                  "scam_top_totals", "top_contracts"])
def test_lists_are_broadcast_not_sort_merged(spark, name):
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["monthly_mean_value", "top_contracts", "top_miners"])
def test_each_line_is_split_once(spark, name):
    plan = plan_of(spark, name)
    # the transaction / block lines are split in one projection only
    splits = re.findall(r"split\(CASE WHEN|split\(concat_ws", plan)
    assert len(splits) == 1


def test_top_k_is_distributed(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "top_miners")


def test_two_part_question_scans_its_input_once(spark):
    plan = plan_of(spark, "top_contract_monthly_mean_gas")
    # both parts read the shared intermediate, not the lineitem scan
    assert "lineitem" not in plan
