"""Totals kept file by file, and the counts that a run takes of its lines."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import Observation

from conftest import SF_SMALL, lines_df
from ledgerlens.operators.parse import line_counts
from ledgerlens.plans import analyses as A
from ledgerlens.plans import incremental as I
from ledgerlens.plans import jobs
from ledgerlens.plans.registry import bl, ct, tx, wide_tx


def rows(df):
    return sorted(map(tuple, df.collect()))


def export(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_new_files_only_are_parsed(spark, scratch, monkeypatch):
    lines = [r.value for r in wide_tx(spark, SF_SMALL).collect()]
    src, root = f"{scratch}/exports", f"{scratch}/folded"
    seen = []
    read = I.transactions
    monkeypatch.setattr(I, "transactions", lambda given, *a, **k: (seen.append(sorted(os.path.basename(f) for f in given.df.inputFiles())), read(given, *a, **k))[1])
    for i in range(3):
        export(src, f"part-{i}.csv", lines[i::3])
        assert [os.path.basename(p) for p in I.fold_new_exports(spark, src, root)] == [f"part-{i}.csv"]
        so_far = [x for k in range(i + 1) for x in lines[k::3]]
        got = I.monthly_summary_of(I.folded_totals(spark, root))
        assert rows(got) == rows(A.monthly_summary(lines_df(spark, so_far)))
    assert seen == [["part-0.csv"], ["part-1.csv"], ["part-2.csv"]]
    assert I.fold_new_exports(spark, src, root) == [] and len(seen) == 3
    assert I.folded_files(spark, root).count() == 3
    with pytest.raises(ValueError):
        I.fold_new_exports(spark, src, root, "address")
    export(src, "part-1.csv", lines[:5])
    with pytest.raises(ValueError):
        I.fold_new_exports(spark, src, root)


def test_a_stopped_run_counts_nothing_and_is_done_again(spark, scratch):
    lines = [r.value for r in tx(spark, SF_SMALL).collect()]
    src, root = f"{scratch}/exports", f"{scratch}/folded"
    export(src, "a.csv", lines[::2])
    I.fold_new_exports(spark, src, root, "address")
    export(src, "b.csv", lines[1::2])
    whole = spark.read.parquet(f"{root}/batch-0")
    whole.write.parquet(f"{root}/batch-1")  # a run that stopped before its manifest
    os.makedirs(f"{root}/manifest-1")
    assert [os.path.basename(p) for p in I.fold_new_exports(spark, src, root, "address")] == ["b.csv"]
    got = I.folded_totals(spark, root, "address")
    assert rows(got.select("to_address", "s")) == rows(A.address_totals(tx(spark, SF_SMALL)))


def test_runs_count_their_lines(spark):
    report = {}
    for r in A.reject_report(tx(spark, SF_SMALL)).collect():
        report.setdefault(r.family, {})[r.reason] = r.n_lines
    for family, question in (("monthly", A.monthly_summary), ("gas_price", A.monthly_mean_gas_price), ("value", A.address_totals),
                             ("gas_value", A.listed_address_monthly_mean_gas)):
        counts = {}
        result = question(A.Lines(tx(spark, SF_SMALL), counts=counts))
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CollectMetrics") == 1 and plan.count("Relation [") == 1
        result.collect()
        assert dict(line_counts(*counts["transactions"])) == report[family]
    counts = {}
    A.top_contracts(A.Lines(tx(spark, SF_SMALL), counts=counts), A.Lines(ct(spark, SF_SMALL), counts=counts)).collect()
    assert dict(line_counts(*counts["transactions"])) == report["value"]
    assert dict(line_counts(*counts["contracts"])) == {r.reason: r.n_lines for r in A.contract_lines_report(ct(spark, SF_SMALL)).collect()}
    counts = {}
    A.top_miners(A.Lines(bl(spark, SF_SMALL), counts=counts)).collect()
    assert dict(line_counts(*counts["blocks"])) == {r.reason: r.n_lines for r in A.block_lines_report(bl(spark, SF_SMALL)).collect()}
    assert isinstance(counts["blocks"][0], Observation)


def test_job_flags(spark, scratch):
    tx(spark, SF_SMALL).write.text(f"{scratch}/transactions")
    when = datetime(2022, 1, 2, 3, 4, 5)
    common = ["monthly_summary", "--transactions", f"{scratch}/transactions/*.txt", "--folded", f"{scratch}/folded", "--out", f"{scratch}/out", "--reject-counts"]
    path = jobs.run(spark, common, when)
    want = sorted((r.month, r.n, r.total_value) for r in A.monthly_summary(tx(spark, SF_SMALL)).collect())
    got = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted((r["month"], r["n"], str(r["total_value"])) for r in got) == want
    jobs.run(spark, ["monthly_count", "--transactions", f"{scratch}/transactions", "--out", f"{scratch}/out", "--reject-counts"], when)
    told = spark.read.json(f"{scratch}/out/monthly_count_lines02-01-2022_03-04-05").collect()
    assert sum(r.n_lines for r in told) == tx(spark, SF_SMALL).count() and {r.reason for r in told} >= {"ok", "arity"}
