"""Question jobs over export files equal the registered questions."""

import json
from datetime import datetime

import pytest
from conftest import SF_SMALL
from pyspark.errors import PySparkException

from ledgerlens.operators.sinks import emit_list_lines
from ledgerlens.plans import jobs
from ledgerlens.plans.registry import FIXTURE_SCAM_ID, QUERIES, bl, catalogue, ct, scam_list, tx
from ledgerlens.sources.object_store import s3a_settings


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_jobs_on_files(spark, scratch):
    tx(spark, SF_SMALL).write.text(f"{scratch}/transactions")
    ct(spark, SF_SMALL).write.text(f"{scratch}/contracts")
    bl(spark, SF_SMALL).write.text(f"{scratch}/blocks")
    emit_list_lines(scam_list(spark, SF_SMALL)).write.text(f"{scratch}/scams")
    catalogue(spark, SF_SMALL).write.text(f"{scratch}/catalogue")
    when = datetime(2022, 1, 2, 3, 4, 5)
    common = ["--transactions", f"{scratch}/transactions", "--contracts", f"{scratch}/contracts",
              "--blocks", f"{scratch}/blocks", "--scams", f"{scratch}/scams", "--out", f"{scratch}/out",
              "--scam-id", FIXTURE_SCAM_ID]
    for name in ("monthly_mean_value", "top_contracts", "top_miners", "hex_overhead_bits",
                 "scam_top_totals", "scam_id_monthly_mean"):
        path = jobs.run(spark, [name, *common], when)
        assert path.endswith(f"{name}02-01-2022_03-04-05")
        got = spark.read.json(path)
        expect = QUERIES[name](spark, SF_SMALL)
        assert rows(got.select(*expect.columns)) == rows(expect)
    path = jobs.run(spark, ["scam_flatten", "--catalogue", f"{scratch}/catalogue", "--out", f"{scratch}/out2"], when)
    assert rows(spark.read.json(path).select("id", "address")) == rows(QUERIES["scam_flatten"](spark, SF_SMALL))
    path = jobs.run(spark, ["monthly_count", *common, "--format", "pairs"], when)
    pairs = sorted(json.loads(r.value) for r in spark.read.text(path).collect())
    expect = sorted([r.month, r.n] for r in QUERIES["monthly_count"](spark, SF_SMALL).collect())
    assert pairs == expect


def test_s3a_settings():
    conf = s3a_settings("http://store:9000", "k", "s")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.access.key"] == "k"


def test_silver_job(spark, scratch):
    tx(spark, SF_SMALL).write.text(f"{scratch}/transactions")
    ct(spark, SF_SMALL).write.text(f"{scratch}/contracts")
    when = datetime(2022, 1, 2, 3, 4, 5)
    silver = jobs.run(spark, ["build_silver", "--transactions", f"{scratch}/transactions",
                              "--out", f"{scratch}/silver"], when)
    path = jobs.run(spark, ["top_contracts", "--transactions-silver", silver,
                            "--contracts", f"{scratch}/contracts", "--out", f"{scratch}/out"], when)
    expect = QUERIES["top_contracts"](spark, SF_SMALL)
    assert rows(spark.read.json(path).select(*expect.columns)) == rows(expect)


def test_line_endings_do_not_change_answers(spark, scratch):
    from ledgerlens.plans import analyses as A
    from ledgerlens.sources.text import read_lines
    lines = [r.value for r in tx(spark, SF_SMALL).collect()]
    results = []
    for i, sep in enumerate(["\n", "\r\n", "\r"]):
        path = f"{scratch}/tx{i}.csv"
        with open(path, "w", newline="") as fh:
            fh.write(sep.join(lines) + sep)
        results.append(rows(A.monthly_mean_value(read_lines(spark, path))))
    assert results[0] == results[1] == results[2]
    assert results[0] == rows(QUERIES["monthly_mean_value"](spark, SF_SMALL))


def test_catalogue_document_job(spark, scratch):
    doc = {"result": {"a": {"id": 5622, "addresses": ["0x1", "0x2"]}, "b": {"id": "7", "addresses": []}}}
    with open(f"{scratch}/scams.json", "w") as fh:
        json.dump(doc, fh, indent=2)
    when = datetime(2022, 1, 2, 3, 4, 5)
    path = jobs.run(spark, ["scam_flatten", "--catalogue", f"{scratch}/scams.json",
                            "--catalogue-multiline", "--out", f"{scratch}/out", "--format", "pairs"], when)
    got = sorted(json.loads(r.value) for r in spark.read.text(path).collect())
    assert got == [["5622", "0x1"], ["5622", "0x2"]]


def test_list_lines_feed_the_scam_questions(spark, scratch):
    """The catalogue's job writes the lines that the next job reads."""
    tx(spark, SF_SMALL).write.text(f"{scratch}/transactions")
    catalogue(spark, SF_SMALL).write.text(f"{scratch}/catalogue")
    when = datetime(2022, 1, 2, 3, 4, 5)
    listed = jobs.run(spark, ["scam_flatten", "--catalogue", f"{scratch}/catalogue", "--out", f"{scratch}/out", "--format", "lines"], when)
    for name in ("scam_monthly_mean", "scam_top_totals"):
        path = jobs.run(spark, [name, "--transactions", f"{scratch}/transactions", "--scams", listed, "--out", f"{scratch}/out"], when)
        expect = QUERIES[name](spark, SF_SMALL)
        assert rows(spark.read.json(path).select(*expect.columns)) == rows(expect)


def test_pair_shapes_and_line_rules(spark, scratch):
    ct(spark, SF_SMALL).write.text(f"{scratch}/contracts")
    lines = [r.value for r in tx(spark, SF_SMALL).collect()]
    bad = ",".join(["h", "0", "0xb", "1", "0", "0xf", "0xnone", "5", "1", "1", "0x", "soon", "", "", "2"])
    with open(f"{scratch}/tx.csv", "w") as fh:
        fh.write("\n".join([*lines, bad]) + "\n")
    when = datetime(2022, 1, 2, 3, 4, 5)
    common = ["--transactions", f"{scratch}/tx.csv", "--contracts", f"{scratch}/contracts", "--out", f"{scratch}/out"]
    path = jobs.run(spark, ["top_contracts", *common, "--format", "pairs-one"], when)
    pairs = sorted(json.loads(r.value) for r in spark.read.text(path).collect())
    assert pairs == sorted([r.address, [int(r.total_value), 1]] for r in QUERIES["top_contracts"](spark, SF_SMALL).collect())
    with pytest.raises(PySparkException, match="not a usable epoch"):
        jobs.run(spark, ["contract_monthly_mean_gas", *common], when)
    path = jobs.run(spark, ["contract_monthly_mean_gas", *common, "--on-bad-timestamp", "reject", "--skip-header"], datetime(2023, 1, 1))
    assert rows(spark.read.json(path).select("month", "mean_gas")) == rows(QUERIES["contract_monthly_mean_gas"](spark, SF_SMALL))


def test_reject_report_refuses_silver(spark, scratch):
    tx(spark, SF_SMALL).write.text(f"{scratch}/transactions")
    when = datetime(2022, 1, 2, 3, 4, 5)
    silver = jobs.run(spark, ["build_silver", "--transactions", f"{scratch}/transactions", "--out", f"{scratch}/s"], when)
    with pytest.raises(ValueError, match="silver"):
        jobs.run(spark, ["reject_report", "--transactions-silver", silver, "--out", f"{scratch}/out"], when)
