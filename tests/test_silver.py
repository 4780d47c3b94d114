"""Questions read from the silver table equal the same questions on raw lines."""

import pytest

from conftest import SF_SMALL
from ledgerlens.plans import analyses as A
from ledgerlens.plans.registry import FIXTURE_LISTED_ADDRESSES, FIXTURE_SCAM_ID, ct, scam_list, tx
from ledgerlens.plans.silver import read_silver_transactions, write_silver_transactions


def same(a, b):
    ra = sorted(tuple(r) for r in a.collect())
    rb = sorted(tuple(r) for r in b.collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            assert u == v


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "transactions")
    write_silver_transactions(tx(spark, SF_SMALL), path)
    return read_silver_transactions(spark, path)


QUESTIONS = [
    lambda t, s: A.monthly_count(t),
    lambda t, s: A.monthly_mean_value(t),
    lambda t, s: A.monthly_mean_gas_price(t),
    lambda t, s: A.address_totals(t),
    lambda t, s: A.top_contracts(t, ct(s, SF_SMALL)),
    lambda t, s: A.contract_monthly_mean_gas(t, ct(s, SF_SMALL)),
    lambda t, s: A.top_contract_monthly_mean_gas(t, ct(s, SF_SMALL)),
    lambda t, s: A.listed_address_monthly_mean_gas(t, FIXTURE_LISTED_ADDRESSES),
    lambda t, s: A.scam_monthly_mean(t, scam_list(s, SF_SMALL)),
    lambda t, s: A.scam_top_totals(t, scam_list(s, SF_SMALL)),
    lambda t, s: A.scam_id_monthly_mean(t, scam_list(s, SF_SMALL), FIXTURE_SCAM_ID),
    lambda t, s: A.scam_leader_monthly_mean(t, scam_list(s, SF_SMALL)),
    lambda t, s: A.monthly_sums_with_count_lookup(t),
]


@pytest.mark.parametrize("i", range(len(QUESTIONS)))
def test_silver_equals_lines(spark, silver, i):
    q = QUESTIONS[i]
    same(q(silver, spark), q(tx(spark, SF_SMALL), spark))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd and wide lines as lines and as silver, unusable timestamps rejected."""
    from ledgerlens.plans.registry import odd_tx, wide_tx

    lines = odd_tx(spark, SF_SMALL).df.unionByName(wide_tx(spark, SF_SMALL))
    path = str(tmp_path_factory.mktemp("odd") / "transactions")
    write_silver_transactions(lines, path)
    return [A.Lines(df, on_bad_timestamp="reject") for df in (read_silver_transactions(spark, path), lines)]


@pytest.mark.parametrize("i", [i for i in range(len(QUESTIONS)) if i != 6])
def test_silver_equals_odd_lines(spark, odd, i):
    """Values of 41 and of 200 digits, and every question that meets them.  (The
    derived list buckets its lines by month before it knows which it uses, so it
    fails on an unusable timestamp either way.)"""
    q = QUESTIONS[i]
    same(q(odd[0], spark), q(odd[1], spark))


def test_silver_prunes_partitions_and_columns(spark, silver):
    plan = silver.filter("month = 24000").select("value")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "ReadSchema: struct<value:decimal(38,0)>" in plan


def test_large_month_is_split_across_writers(spark, tmp_path):
    import glob
    from pyspark.sql import functions as F
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    skew = spark.conf.get("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
        spark.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        lines = tx(spark, SF_SMALL)
        # every line moved to one month: a single hot partition
        one_month = lines.select(F.regexp_replace("value", r",([0-9]{9,10}),", ",1583020800,").alias("value"))
        path = str(tmp_path / "silver")
        write_silver_transactions(one_month.repartition(4), path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        spark.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", skew)
    folders = glob.glob(path + "/month=*")
    assert len(folders) == 1
    assert len(glob.glob(folders[0] + "/*.parquet")) > 1
    assert spark.read.parquet(path).count() == lines.filter("size(split(value, ',')) = 15").count()
