"""One large JSON document read by many tasks.

A catalogue may be one document, ``{"result": {key: entry, ...}}``, on one line.
It is scanned as text with ``}`` for a line end, which Spark splits by bytes, and
every piece is summarised by what it does to the state of a JSON scanner: whether
it turns inside of a string to outside, and by how much it changes the depth of
brackets if it starts outside or inside.  Inside a byte range running sums compose
the summaries, and a row per range, composed in order, gives each range its state
at the start; no task needs to have read what comes before.  With the depth at
every piece known, whole entries are those that end at the depth of ``result``;
they are put together across ranges and each is decoded by itself.

The work of a task is a byte range or its entries; one entry is the least that is
decoded at once.  The document's members beside ``result`` are skipped, of which
there are few that hold objects.  Malformed text raises.  Of entries that repeat a
key all are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.materialize import shared

ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("addresses", T.ArrayType(T.StringType()))])
#: Depth of the object that holds the entries.
_INSIDE = 2


def _depth(outside: Column) -> Column:
    """Brackets opened less closed in text without strings."""
    opened, closed = (F.length(outside) - F.length(F.translate(outside, b, "")) for b in ("{[", "]}"))
    return opened - closed


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text up to each ``}``: ``file``, ``block`` (start of its byte range), ``row``
    (its order there), ``text``; whether its quotes turn the state; and the depth
    that it adds, with the ``}``, if it starts outside and inside of a string."""
    rows = (spark.read.option("lineSep", "}").text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")))
    # an escape is two characters inside of a string and hides a quote; its second
    # one is no bracket, so the } that ended a piece cannot belong to one
    plain = rows.withColumn("_t", F.regexp_replace("text", r"(?s)\\.", ""))
    string = F.lit(r'"[^"]*+(?:"|\z)')
    turns = F.pmod(F.length("_t") - F.length(F.translate("_t", '"', "")), F.lit(2))
    from_outside = F.regexp_replace("_t", string, F.lit(""))
    from_inside = F.regexp_replace(F.regexp_replace("_t", F.lit(r'\A[^"]*+(?:"|\z)'), F.lit("")), string, F.lit(""))
    return plain.select("file", "size", "block", "row", "text", turns.alias("turns"),
                        (_depth(from_outside) - F.when(turns == 0, 1).otherwise(0)).cast("long").alias("outside"),
                        (_depth(from_inside) - F.when(turns == 1, 1).otherwise(0)).cast("long").alias("inside"))


def _before(order: str, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(c: str | Column, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with the depth before (``start``) and after (``end``) them, and
    whether they end inside of a string."""
    own = _before("row", "file", "block")
    turned = pieces.withColumn("_p", F.pmod(_sum_before("turns", own), F.lit(2)))
    # under the two states that the range may start in
    either = turned.select("*", F.when(F.col("_p") == 0, F.col("outside")).otherwise(F.col("inside")).alias("_o"),
                           F.when(F.col("_p") == 0, F.col("inside")).otherwise(F.col("outside")).alias("_i"))
    either = shared(either.select("file", "size", "block", "row", "text", "turns", "_p", "_o", "_i",
                                  _sum_before("_o", own).alias("_so"), _sum_before("_i", own).alias("_si")), "pieces")
    ranges = either.groupBy("file", "block").agg(F.sum("turns").alias("turns"), F.sum("_o").alias("_o"), F.sum("_i").alias("_i"))
    earlier = _before("block", "file")  # a row per byte range
    states = ranges.select("file", "block", "_o", "_i", F.pmod(_sum_before("turns", earlier), F.lit(2)).alias("_state"))
    states = states.select("file", "block", "_state", _sum_before(F.when(F.col("_state") == 0, F.col("_o")).otherwise(F.col("_i")), earlier).alias("_base"))
    # text behind the last } of a file: its pieces, each with a }, are a byte too long
    tails = either.groupBy("file").agg(F.max(F.struct("block", "row")).alias("_at"), (F.sum(F.octet_length("text") + 1) > F.max("size")).alias("_tail"))
    known = either.join(F.broadcast(states), ["file", "block"]).join(F.broadcast(tails), "file")
    tail = F.col("_tail") & (F.col("_at") == F.struct("block", "row"))
    outside = F.col("_state") == 0
    start = F.col("_base") + F.when(outside, F.col("_so")).otherwise(F.col("_si"))
    end = start + F.when(outside, F.col("_o")).otherwise(F.col("_i")) + tail.cast("int")
    return known.select("file", "block", "row", "text", start.alias("start"), end.alias("end"), tail.alias("tail"),
                        (F.pmod(F.col("_state") + F.col("_p") + F.col("turns"), F.lit(2)) == 1).alias("open"))


def _entries(placed: DataFrame) -> DataFrame:
    """Texts from one end of an entry to the next: ``file``, ``number``, ``text``,
    and the depths before and after."""
    last = (~F.col("open") & ~F.col("tail") & (F.col("end") <= _INSIDE)).cast("long")
    counted = shared(placed.withColumn("_last", last).withColumn("_n", _sum_before("_last", _before("row", "file", "block"))), "placed")
    ranges = counted.groupBy("file", "block").agg(F.sum("_last").alias("_k"))
    bases = ranges.select("file", "block", _sum_before("_k", _before("block", "file")).alias("_base"))
    numbered = counted.join(F.broadcast(bases), ["file", "block"]).withColumn("number", F.col("_base") + F.col("_n"))
    first = F.struct("block", "row")
    whole = numbered.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("_p"),
        F.min_by("start", first).alias("start"), F.max_by("end", first).alias("end"), F.max("_last").alias("whole"))
    return whole.select("file", "number", F.array_join("_p.text", "}").alias("text"), "start", "end", F.col("whole") == 1)


def read_document(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents -> DataFrame[result: map of key to (id, addresses)], a row for
    each part of a document, of which none is more than the entries between two
    that are objects."""
    parts = _entries(_placed(_pieces(spark, paths))).toDF("file", "number", "text", "start", "end", "whole")
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    blank = F.regexp_replace(text, r"\s+", "") == ""
    body = F.concat(F.when(start == 0, text).otherwise(F.concat(F.lit("{"), F.regexp_replace(text, F.lit(r"\A\s*,"), F.lit("")))), F.lit("}"))
    depth = F.when(start >= _INSIDE, end - 1).otherwise(end)  # still open in ``body``
    # at the depth of the entries a member beside ``result`` may have an array open
    ends = [F.concat(body, F.repeat(F.lit("}"), depth.cast("int"))), F.concat(body, F.lit("]}"))]
    head = (start < _INSIDE) & (end == _INSIDE)
    json = F.when(head & F.json_object_keys(ends[0]).isNull(), ends[1]).otherwise(ends[0])
    wrong = (F.when((start < 0) | (end < 0) | (start > _INSIDE), "brackets of the document do not match: ")
             .when(~F.col("whole") & ((end != 0) | ~blank), "the document does not end: ")
             .when(F.col("whole") & (start < _INSIDE) & F.json_object_keys(json).isNull(), "not JSON: "))
    ended = parts.groupBy("file").agg(F.max_by("end", "number").alias("end")).filter(end != 0)
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.substring(text, 1, 80))).cast("boolean")).otherwise(F.col("whole"))
    # what follows, and filters that follow from it, stay above the checks
    known = _barrier(parts.select("file", "number", "start", "end", json.alias("json"), checked.alias("good"), F.when(head, F.element_at(F.json_object_keys(json), -1)).alias("member")))
    known = known.filter("good")
    opening = (known.filter(F.col("member").isNotNull())
               .groupBy("file").agg(F.sort_array(F.collect_list(F.struct("number", (F.col("member") == "result").alias("ours")))).alias("members")))
    later = known.filter(F.col("start") >= _INSIDE).join(F.broadcast(opening), "file")
    ours = F.element_at(F.filter("members", lambda m: m["number"] < F.col("number")), -1)["ours"]
    later = _barrier(later.filter(ours).select("json"))
    options, entries = {"mode": "FAILFAST"}, T.MapType(T.StringType(), ENTRY)
    heads = known.filter(F.col("start") < _INSIDE).filter(F.coalesce(F.col("member"), F.lit("result")) == "result")
    whole = F.from_json("json", T.StructType([T.StructField("result", entries)]), options)["result"]
    cut_off = ended.select(F.raise_error(F.concat(F.lit("the document does not end: "), F.col("file"))).cast("string").alias("json"))
    later = later.unionByName(_barrier(cut_off))
    return _barrier(heads.select(whole.alias("result"))).unionByName(_barrier(later.select(F.from_json("json", entries, options).alias("result"))))


def _barrier(df: DataFrame) -> DataFrame:
    """A generator of one row, through which no filter is pushed."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
