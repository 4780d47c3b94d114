"""Join strategies agree with each other; multiplicity; sinks and catalogues."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from conftest import lines_df
from ledgerlens.operators.catalogue import flatten_catalogue
from ledgerlens.operators.joins import aggregate_through, join_totals_with_copies, repeat_rows
from ledgerlens.operators.sinks import emit_list_lines, pairs_json, result_path, write_result
from ledgerlens.sources.text import read_catalogue, read_reference_list


def facts(spark):
    rows = [("a", 1, 10), ("a", 1, 5), ("a", 2, 7), ("b", 1, 3), ("c", 2, 100), ("hot", 1, 1)] + \
           [("hot", 2, 2)] * 50
    return spark.createDataFrame(rows, "address string, month int, value long") \
        .withColumn("value", F.col("value").cast("decimal(38,0)"))


def members(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("hot", "z"), ("zz", "q")]
    return spark.createDataFrame(rows, "address string, id string")


def brute(f, m, key):
    out = {}
    for fa, mo, v in f:
        for ma, i in m:
            if fa == ma:
                k = mo if key == "month" else i
                s, n = out.get(k, (0, 0))
                out[k] = (s + v, n + 1)
    return out


def as_dict(df, key):
    return {r[key]: (int(r.s), r.n) for r in df.collect()}


def test_broadcast_and_shuffle_paths_agree(spark):
    f, m = facts(spark), members(spark)
    fl = [(r.address, r.month, int(r.value)) for r in f.collect()]
    ml = [(r.address, r.id) for r in m.collect()]
    for bc in (True, False):
        by_month = aggregate_through(f, m.select("address"), "address", fact_keys=("month",),
                                     value="value", broadcast=bc)
        by_id = aggregate_through(f, m, "address", member_keys=("id",), value="value", broadcast=bc)
        assert as_dict(by_month, "month") == brute(fl, ml, "month")
        assert as_dict(by_id, "id") == brute(fl, ml, "id")


def test_copies_restore_multiplicity(spark):
    totals = spark.createDataFrame([("a", 5), ("b", 3)], "address string, total long")
    lst = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("c",)], "address string")
    got = sorted((r.address, r.total) for r in join_totals_with_copies(totals, lst, "address").collect())
    assert got == [("a", 5), ("a", 5), ("a", 5), ("b", 3)]
    capped = join_totals_with_copies(totals, lst, "address", max_copies=2).collect()
    assert sorted(r.address for r in capped) == ["a", "a", "b"]


def test_repeat_rows_large_weight(spark):
    df = spark.createDataFrame([("k", 2500), ("j", 1), ("z", 1024)], "k string, t long")
    got = {r.k: r.c for r in repeat_rows(df, "t").groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert got == {"k": 2500, "j": 1, "z": 1024}


def test_pairs_json_matches_json_dumps(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("2020 - 01", Decimal(12)), ('we"ird\\', Decimal(10**20))],
                               "k string, v decimal(38,0)")
    got = sorted(r.value for r in pairs_json(df).collect())
    assert got == sorted(json.dumps([k, v]) for k, v in [("2020 - 01", 12), ('we"ird\\', 10**20)])
    nested = pairs_json(df, nested_one=True).collect()
    assert sorted(r.value for r in nested)[0] == json.dumps(["2020 - 01", [12, 1]])


def test_write_result_stamps_folder(spark, scratch):
    when = datetime(2021, 3, 4, 5, 6, 7)
    df = spark.createDataFrame([("2020 - 01", 3)], "month string, n long")
    path = write_result(df, scratch, "monthly", when)
    assert path == result_path(scratch, "monthly", when) == f"{scratch}/monthly04-03-2021_05-06-07"
    assert ":" not in path.rsplit("/", 1)[1]
    back = spark.read.json(path).collect()
    assert [(r.month, r.n) for r in back] == [("2020 - 01", 3)]


def test_catalogue_document_and_list_round_trip(spark, scratch):
    doc = {"result": {"k1": {"id": 5622, "addresses": ["0xa", "0xb"]},
                      "k2": {"id": "7", "addresses": []},
                      "k3": {"id": "8", "addresses": ["0xc"]}}}
    path = f"{scratch}/scams.json"
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    pairs = flatten_catalogue(read_catalogue(spark, path, multi_line=True))
    got = sorted((r.id, r.address) for r in pairs.collect())
    assert got == [("5622", "0xa"), ("5622", "0xb"), ("8", "0xc")]
    lines = emit_list_lines(pairs)
    assert sorted(r.value for r in lines.collect()) == ["5622, 0xa", "5622, 0xb", "8, 0xc"]
    lines.write.text(f"{scratch}/scamsfixed")
    back = read_reference_list(spark, f"{scratch}/scamsfixed").filter("reason is null")
    assert sorted((r.id, r.address) for r in back.collect()) == got


def test_dedupe_option(spark):
    f, m = facts(spark), members(spark)
    by_id = aggregate_through(f, m, "address", member_keys=("id",), value="value", dedupe=True)
    got = {r.id: (int(r.s), r.n) for r in by_id.collect()}
    # ("a", "x") is listed twice but counts once
    assert got["x"] == (22, 3)
    totals = spark.createDataFrame([("a", 5)], "address string, total long")
    lst = spark.createDataFrame([("a",), ("a",)], "address string")
    assert join_totals_with_copies(totals, lst, "address", dedupe=True).count() == 1


def test_sums_beyond_38_digits_are_exact(spark):
    from decimal import Decimal

    from ledgerlens.operators.aggregates import sum_by
    big = Decimal(9 * 10**37)
    df = spark.createDataFrame([("k", big, None), ("k", big, None), ("w", None, "1" * 90), ("w", Decimal(-5), None)], "k string, v decimal(38,0), v_wide string")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            assert {r.k: int(r.total) for r in sum_by(df, "k", "v").collect()} == {"k": 18 * 10**37, "w": int("1" * 90) - 5}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    ok = spark.createDataFrame([("k", Decimal(5)), ("k", None)], "k string, v decimal(38,0)")
    assert sum_by(ok, "k", "v").first().total == "5"


def test_results_do_not_depend_on_partitioning(spark):
    from conftest import SF_SMALL
    from ledgerlens.plans import analyses as A
    from ledgerlens.plans.registry import ct, tx

    def run(parts):
        lines = tx(spark, SF_SMALL).repartition(parts)
        return (sorted(map(tuple, A.top_contracts(lines, ct(spark, SF_SMALL)).collect())),
                sorted(map(tuple, A.monthly_mean_value(lines).collect())))
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = run(1)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert run(7) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_wide_keys_take_the_pre_aggregated_path(spark):
    f, m = facts(spark), members(spark)
    fl = [(r.address, r.month, int(r.value)) for r in f.collect()]
    ml = [(r.address, r.id) for r in m.collect()]
    spark.conf.set("spark.ledgerlens.maxFanout", "1")
    try:
        by_id = aggregate_through(f, m, "address", member_keys=("id",), value="value")
        plan = by_id._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        assert as_dict(by_id, "id") == brute(fl, ml, "id")
    finally:
        spark.conf.unset("spark.ledgerlens.maxFanout")
    narrow = aggregate_through(f, m, "address", member_keys=("id",), value="value")
    assert "LeftSemi" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert as_dict(narrow, "id") == brute(fl, ml, "id")


def set_all(spark, **conf):
    for key, value in conf.items():
        spark.conf.set(f"spark.ledgerlens.{key}", str(value))


def unset_all(spark, *keys):
    for key in keys:
        spark.conf.unset(f"spark.ledgerlens.{key}")


def test_hot_list_key_is_dealt_over_tasks(spark):
    """One address in very many list entries: no task has them all."""
    import statistics

    from ledgerlens.operators import joins as J
    from ledgerlens.operators.aggregates import chunk_rows, fold

    n = 40_000
    lst = spark.range(n).select(F.lit("hot").alias("address"), F.concat(F.lit("id"), F.col("id")).alias("id")).unionByName(
        spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "address string, id string"))
    f = spark.createDataFrame([("hot", 1, "9" * 50), ("hot", 2, "1"), ("a", 1, "5"), ("b", 1, "-7"), ("zz", 1, "3")], "address string, month int, value string")
    expect = {"x": (-2, 2), "y": (5, 1), "id7": (int("9" * 50) + 1, 2)}
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for bound in (0, 10**6):
            set_all(spark, broadcastMaxRows=max(bound, 1), hotRows=200, maxFanout=16)
            got = {r.id: (int(r.s), r.n) for r in aggregate_through(f, lst, "address", member_keys=("id",), value="value").collect()}
            assert len(got) == n + 2 and {k: got[k] for k in expect} == expect
            assert len({v for k, v in got.items() if k.startswith("id")}) == 1
        set_all(spark, broadcastMaxRows=200, hotRows=200)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        listed = J.MemberList.of(lst, "address", ("id",))
        pre = fold(chunk_rows(f, ["address", "month"], {"s": "value"}, {"n": F.lit(1)}), ["address", "month"], ["s"], ["n"])
        joined = J._join_folded(pre, listed, "address", False)
        tasks = [r["count"] for r in joined.filter("address = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) > 2 and max(tasks) <= 2 * statistics.median(tasks)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        unset_all(spark, "broadcastMaxRows", "hotRows", "maxFanout")


def test_large_lists_filter_facts_before_the_exchange(spark):
    """Beyond the broadcast bound a bitmap drops unlisted facts below the
    aggregate; what it lets through wrongly leaves at the join."""
    from ledgerlens.operators import joins as J

    facts_ = spark.range(20_000).select(F.concat(F.lit("0x"), F.col("id")).alias("address"), F.lit(1).alias("month"), F.lit("2").alias("value"))
    lst = spark.range(0, 20_000, 100).select(F.concat(F.lit("0x"), F.col("id")).alias("address"))
    try:
        set_all(spark, broadcastMaxRows=0)
        listed = J.MemberList.of(lst, "address")
        assert listed.rows == 200 and not listed.fits_broadcast()
        kept = listed.narrowed(facts_, "address", False)
        assert 200 <= kept.count() < 200 + 20_000 // 8 and kept.columns == facts_.columns
        assert kept.join(listed.df, "address").count() == 200
        got = aggregate_through(facts_, listed, "address", fact_keys=("month",), value="value").collect()
        assert [(r.month, int(r.s), r.n) for r in got] == [(1, 400, 200)]
        monkey = J.BITMAP_WORDS
        J.BITMAP_WORDS = 1  # no room: all facts stay, the result too
        assert listed.narrowed(facts_, "address", False).count() == 20_000
        J.BITMAP_WORDS = monkey
    finally:
        unset_all(spark, "broadcastMaxRows")


def test_a_list_is_read_once(spark):
    """The count, the filter and the join of a question read one written table."""
    from ledgerlens.plans import analyses as A
    from ledgerlens.plans.registry import ct, tx
    from conftest import SF_SMALL

    seen = spark.sparkContext.accumulator(0)
    lines = ct(spark, SF_SMALL)
    rows = lines.count()
    counted = lines.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(lines.schema)
    top = sorted(map(tuple, A.top_contracts(tx(spark, SF_SMALL), counted).collect()))
    assert seen.value == rows and top == sorted(map(tuple, A.top_contracts(tx(spark, SF_SMALL), lines).collect()))
