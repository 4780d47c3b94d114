"""Every question against a plain-Python evaluation of its specification.

The rendered sf0.001 ledger (lines from lineitem, supplier, orders) is
collected to the test process and each question is recomputed line by line
with Python's own ``int()``, ``time.gmtime`` and ``str.split``.
"""

import time
from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from ledgerlens.plans import analyses as A
from ledgerlens.plans.registry import (
    FIXTURE_LISTED_ADDRESSES,
    FIXTURE_SCAM_ID,
    QUERIES,
    bl,
    ct,
    scam_list,
    tx,
)


def ok_int(s):
    try:
        int(s)
        return True
    except ValueError:
        return False


def good(line, arity, ints):
    f = line.split(",")
    return len(f) == arity and all(ok_int(f[i]) for i in ints)


def month(f):
    return time.strftime("%Y - %m", time.gmtime(int(f[11])))


def mean_table(pairs):
    s, n = defaultdict(int), Counter()
    for k, v in pairs:
        s[k] += v
        n[k] += 1
    return {k: s[k] / n[k] for k in s}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k], (k, a[k], b[k])


def top10(totals):
    return sorted(totals, key=lambda kv: (-kv[1], kv[0]))[:10]


@pytest.fixture(scope="module")
def data(spark):
    return {
        "tx": [r.value for r in tx(spark, SF_SMALL).collect()],
        "ct": [r.value for r in ct(spark, SF_SMALL).collect()],
        "bl": [r.value for r in bl(spark, SF_SMALL).collect()],
        "pairs": [(r.id, r.address) for r in scam_list(spark, SF_SMALL).collect()],
    }


def q(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


def test_monthly(spark, data):
    lines = [l.split(",") for l in data["tx"] if good(l, 15, (11, 7))]
    assert {r.month: r.n for r in q(spark, "monthly_count")} == Counter(month(f) for f in lines)
    close({r.month: r.mean_value for r in q(spark, "monthly_mean_value")},
          mean_table((month(f), int(f[7])) for f in lines))
    gp = [l.split(",") for l in data["tx"] if good(l, 15, (9,))]
    close({r.month: r.mean_gas_price for r in q(spark, "monthly_mean_gas_price")},
          mean_table((month(f), int(f[9])) for f in gp))


def test_address_and_contract_questions(spark, data):
    vals = [l.split(",") for l in data["tx"] if good(l, 15, (7,))]
    totals = defaultdict(int)
    for f in vals:
        totals[f[6]] += int(f[7])
    assert {r.to_address: int(r.total_value) for r in q(spark, "address_totals")} == totals
    contracts = [l.split(",")[0] for l in data["ct"] if len(l.split(",")) == 6]
    joined = [(a, totals[a]) for a in contracts if a in totals]
    expect = top10(joined)
    assert [(r.address, int(r.total_value)) for r in q(spark, "top_contracts")] == expect

    gas = [l.split(",") for l in data["tx"] if good(l, 15, (8,))]
    mult = Counter(contracts)
    close({r.month: r.mean_gas for r in q(spark, "contract_monthly_mean_gas")},
          mean_table((month(f), int(f[8])) for f in gas for _ in range(mult[f[6]])))

    gv = [l.split(",") for l in data["tx"] if good(l, 15, (8, 7))]
    listed = set(FIXTURE_LISTED_ADDRESSES)
    close({r.month: r.mean_gas for r in q(spark, "listed_address_monthly_mean_gas")},
          mean_table((month(f), int(f[8])) for f in gv if f[6] in listed))
    top = {a for a, _ in expect}
    close({r.month: r.mean_gas for r in q(spark, "top_contract_monthly_mean_gas")},
          mean_table((month(f), int(f[8])) for f in gv if f[6] in top))


def test_block_questions(spark, data):
    sizes = defaultdict(int)
    for l in data["bl"]:
        if good(l, 19, (12,)):
            f = l.split(",")
            sizes[f[9]] += int(f[12])
    assert [(r.miner, int(r.total_size)) for r in q(spark, "top_miners")] == top10(sizes.items())
    bits = sum((sum(len(f[i]) for i in (4, 5, 6, 7, 8)) - 10) * 4
               for f in (l.split(",") for l in data["bl"]) if len(f) == 19)
    assert [(r.k, r.total_bits) for r in q(spark, "hex_overhead_bits")] == [(1, bits)]


def test_scam_questions(spark, data):
    vals = [l.split(",") for l in data["tx"] if good(l, 15, (7,))]
    pairs = data["pairs"]
    by_addr = Counter(a for _, a in pairs)
    close({r.month: r.mean_value for r in q(spark, "scam_monthly_mean")},
          mean_table((month(f), int(f[7])) for f in vals for _ in range(by_addr[f[6]])))
    totals = defaultdict(int)
    for f in vals:
        for i, a in pairs:
            if a == f[6]:
                totals[i] += int(f[7])
    expect = top10(totals.items())
    assert [(r.id, int(r.total_value)) for r in q(spark, "scam_top_totals")] == expect

    def one_id(scam_id):
        return mean_table((month(f), int(f[7])) for f in vals for i, a in pairs
                          if a == f[6] and i == scam_id)
    close({r.month: r.mean_value for r in q(spark, "scam_id_monthly_mean")}, one_id(FIXTURE_SCAM_ID))
    close({r.month: r.mean_value for r in q(spark, "scam_leader_monthly_mean")}, one_id(expect[0][0]))


def test_reject_report_counts_every_line(spark, data):
    rows = q(spark, "reject_report")
    per_family = Counter()
    for r in rows:
        per_family[r.family] += r.n_lines
    assert set(per_family.values()) == {len(data["tx"])}
    value = {r.reason: r.n_lines for r in rows if r.family == "value"}
    assert value["ok"] == sum(good(l, 15, (7,)) for l in data["tx"])
    assert value["arity"] == sum(len(l.split(",")) != 15 for l in data["tx"])




def test_plans_and_modes_agree_on_bad_lines(spark):
    """A question gives the same rows or the same error whatever the list's
    size, the fan-out bound or the ANSI mode."""
    from pyspark.errors import PySparkException

    def line(to, value="5", ts="1583020800"):
        return ",".join(["h", "0", "0xb", "1", "0", "0xf", to, value, "7", "1", "0x", ts, "", "", "2"])

    pairs = spark.createDataFrame([("1", "0xa"), ("1", "0xa"), ("2", "0xa")], "id string, address string")
    contracts = spark.createDataFrame([("0xa,0x,,False,False,1",)], "value string")
    wide = "9" * 38
    cases = [[line("0xa"), line("0xb", ts="soon")], [line("0xa", ts="soon")], [line("0xa", wide), line("0xa", wide)], [line("0xa"), line("0xb", "9" * 41)]]
    questions = [lambda t: A.scam_monthly_mean(t, pairs), lambda t: A.scam_top_totals(t, pairs), lambda t: A.scam_leader_monthly_mean(t, pairs),
                 lambda t: A.contract_monthly_mean_gas(t, contracts), lambda t: A.scam_id_monthly_mean(t, pairs, "1")]
    for lines in cases:
        tx = spark.createDataFrame([(x,) for x in lines], "value string")
        for question in questions:
            seen = set()
            for ansi, bound, fan in (("true", "1000000", "16"), ("false", "0", "16"), ("false", "1000000", "1")):
                spark.conf.set("spark.sql.ansi.enabled", ansi)
                spark.conf.set("spark.ledgerlens.broadcastMaxRows", bound)
                spark.conf.set("spark.ledgerlens.maxFanout", fan)
                try:
                    seen.add(str(sorted(map(str, question(tx).collect()))))
                except PySparkException:
                    seen.add("error")
                finally:
                    for key in ("spark.sql.ansi.enabled", "spark.ledgerlens.broadcastMaxRows", "spark.ledgerlens.maxFanout"):
                        spark.conf.unset(key)
            assert len(seen) == 1, (lines, seen)
