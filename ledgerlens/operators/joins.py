"""Joins of ledger facts with address lists, multiplicity preserved.

A list is broadcast only after its row count is checked against a bound
(``spark.ledgerlens.broadcastMaxRows``); beyond it the facts are pre-aggregated
per join key so the shuffle carries one row per (key, group) rather than raw
rows, and a recipient holding a third of all transactions stays one row.
Those shuffle joins carry a ``merge`` hint: a static size estimate (which does
not see generator fan-out) must not turn them back into broadcasts.

Duplicates in a list are kept as a weight: an address listed k times counts k
times, which is what a row-level inner join gives (a semi join would not).

A list is collapsed and written once (``MemberList``): the count, the filter and
the join read that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.wide import BASE
from ledgerlens.operators.aggregates import CHUNK, chunk_rows, finish, fold, times, value_columns
from ledgerlens.operators.materialize import shared

DEFAULT_BROADCAST_MAX_ROWS = 1_000_000
# bytes of a broadcast list's columns, whatever its rows
BROADCAST_MAX_BYTES = 256 << 20
# a fact row may be joined to at most this many list rows on the direct path
DEFAULT_MAX_FANOUT = 16
WEIGHT = "_w"
# list rows that may share one key before they are dealt over several tasks
DEFAULT_HOT_ROWS = 8192
# of the bitmap that filters by a list over the broadcast bound: words of 64
# bits, and bits for each listed key where there is room
BITMAP_WORDS = 1 << 20
BITS_PER_KEY = 16


def broadcast_max_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.ledgerlens.broadcastMaxRows", None)
    return int(conf) if conf else DEFAULT_BROADCAST_MAX_ROWS


def max_fanout(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.ledgerlens.maxFanout", None)
    return int(conf) if conf else DEFAULT_MAX_FANOUT


def hot_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.ledgerlens.hotRows", None)
    return int(conf) if conf else DEFAULT_HOT_ROWS


def _row_bytes(df: DataFrame):
    return F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns]))


def list_shape(w: DataFrame, on: str) -> tuple[int, int, int]:
    """(rows, largest number of rows sharing one key, bytes) of a weighted list.

    One job of partial aggregates; only the three numbers reach the driver.
    """
    per_key = w.groupBy(on).agg(F.count(F.lit(1)).alias("_k"), F.sum(_row_bytes(w)).alias("_b"))
    row = per_key.agg(F.sum("_k").alias("rows"), F.max("_k").alias("widest"), F.sum("_b").alias("bytes")).first()
    return int(row.rows or 0), int(row.widest or 0), int(row.bytes or 0)


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``BROADCAST_MAX_BYTES``.

    A plain ``count()`` (partial counts per task, one number per task to the
    final step) rather than ``limit(n + 1).count()``, whose global limit would
    funnel up to n + 1 rows of every task into a single task.
    """
    bound = broadcast_max_rows(df) if max_rows is None else max_rows
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")).first()
    return row.rows <= bound and (row.bytes or 0) <= BROADCAST_MAX_BYTES


def weighted(members: DataFrame, on: str, attrs: tuple[str, ...] = (), *,
             dedupe: bool = False) -> DataFrame:
    """(on, attrs..., _w): distinct list entries with their multiplicity.

    ``dedupe=True`` gives every distinct entry weight 1 (a list entered twice
    then counts once).
    """
    weight = F.lit(1).cast("bigint") if dedupe else F.count(F.lit(1))
    return members.groupBy(on, *attrs).agg(weight.alias(WEIGHT))


@dataclass(frozen=True)
class MemberList:
    """A list collapsed to (key, attributes, weight), written once, with its
    size: whatever asks for it, filters by it or joins it reads that table, so
    the export behind it is parsed once."""

    df: DataFrame
    rows: int
    widest: int  # rows that share a key
    size: int

    @staticmethod
    def of(members: DataFrame, on: str, attrs: tuple[str, ...] = (), *, dedupe: bool = False) -> MemberList:
        table = shared(weighted(members, on, attrs, dedupe=dedupe), "list")
        if not attrs:
            row = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(table)).alias("bytes")).first()
            return MemberList(table, row.rows, 1, int(row.bytes or 0))
        return MemberList(table, *list_shape(table, on))

    def narrowed(self, facts: DataFrame, on: str, broadcast: bool) -> DataFrame:
        """Facts without those whose key is not listed: all of these where the
        list may be broadcast, else most of them.

        Beyond the bound a bitmap of hashed keys is broadcast, which is of bounded
        size whatever the list: ``BITMAP_WORDS`` words of 64 bits at most.  Facts
        whose bit is not set are not listed; others that are not leave at the
        join.  A list that would set too many of the bits is not worth one."""
        keys = self.df.select(on).distinct()
        if broadcast:
            return facts.join(F.broadcast(keys), on, "left_semi")
        words = 1 << max(0, (self.rows * BITS_PER_KEY // 64 - 1).bit_length())
        words = min(words, BITMAP_WORDS)
        if self.rows > words * 64 // 2:
            return facts
        place = F.pmod(F.xxhash64(on), F.lit(words * 64))
        word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
        bitmap = shared(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_bits")), "bitmap")
        marked = facts.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(bitmap), "_word")
        return marked.filter(F.getbit(F.col("_bits"), F.col("_bit")) == 1).select(*facts.columns)

    def fits_broadcast(self, max_rows: int | None = None) -> bool:
        return self.rows <= (broadcast_max_rows(self.df) if max_rows is None else max_rows) and self.size <= BROADCAST_MAX_BYTES


def aggregate_through(facts: DataFrame, members: DataFrame | MemberList, on: str, *,
                      fact_keys: tuple[str, ...] = (), member_keys: tuple[str, ...] = (),
                      value: str | None = None, max_rows: int | None = None,
                      broadcast: bool | None = None, dedupe: bool = False) -> DataFrame:
    """Σ value and row count of ``facts ⋈ members`` per (fact_keys, member_keys).

    Equal to an inner row-level join followed by ``groupBy``; returns
    (fact_keys..., member_keys..., s, n), ``s`` an exact sum in text, null when
    ``value`` is None.  ``members`` is collapsed and written once (see
    :class:`MemberList`) unless it is such a list already.
    """
    lst = members if isinstance(members, MemberList) else MemberList.of(members, on, member_keys, dedupe=dedupe)
    w, keys, values = lst.df, [*fact_keys, *member_keys], ({"s": value} if value else {})
    columns = [on, *fact_keys, *(value_columns(facts, value) if value else [])]
    if broadcast is None:
        broadcast = lst.fits_broadcast(max_rows)
    if broadcast and lst.widest <= max_fanout(w):
        # at most ``max_fanout`` list rows per key (one when the list attaches
        # nothing): joining raw fact rows multiplies them by a proven bound
        joined = facts.select(*columns).join(F.broadcast(w), on)
        rows = chunk_rows(joined, keys, values, {"n": F.col(WEIGHT)}, F.col(WEIGHT))
    else:
        # a list over the bound, or a key that carries many attributes (one
        # address in many scam entries): filter by the key set, aggregate per key,
        # and only then fan out, so the fan-out applies to one row per key and
        # group, not to raw rows
        listed = lst.narrowed(facts.select(*columns), on, broadcast)
        pre_keys = [on, *fact_keys]
        pre = fold(chunk_rows(listed, pre_keys, values, {"n": F.lit(1).cast("bigint")}), pre_keys, list(values), ["n"])
        rows = _weighted_chunks(_join_folded(pre, lst, on, broadcast), keys, list(values))
    out = finish(fold(rows, keys, list(values), ["n"]), keys, list(values), ["n"])
    return out if value else out.select(*keys, F.lit(None).cast("string").alias("s"), "n")


def _join_folded(pre: DataFrame, lst: MemberList, on: str, broadcast: bool) -> DataFrame:
    """Pre-aggregated facts ⋈ list.

    Beyond the broadcast bound ``merge`` stops a size estimate from broadcasting
    what the row count ruled out, with the pre-aggregated side, one row per key
    and group, buffered.  Keys with more than ``hotRows`` list rows are joined
    apart: their list rows are dealt over as many parts as they fill, and their
    facts, a row per group, are copied to each part, so that no task has one
    key's whole list.  There are no more such keys than may be broadcast.
    """
    w, bound = lst.df, hot_rows(lst.df)
    if lst.widest <= bound:
        return pre.join(F.broadcast(w), on) if broadcast else w.join(pre.hint("merge"), on)
    pre, bound = shared(pre, "folded"), max(bound, -(-lst.rows // broadcast_max_rows(w)))
    parts = F.ceil(F.col("_k") / bound).cast("int").alias("_parts")
    hot = shared(w.groupBy(on).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > bound).select(on, parts), "hot")
    apart = lambda df: df.join(F.broadcast(hot.select(on)), on, "left_anti")
    cold = apart(pre).join(F.broadcast(apart(w)), on) if broadcast else apart(w).join(apart(pre).hint("merge"), on)
    rest = [c for c in w.columns if c != on]
    dealt = w.join(F.broadcast(hot), on).withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_parts")).cast("int")).drop("_parts")
    copied = pre.join(F.broadcast(hot), on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return cold.unionByName(dealt.join(copied.hint("merge"), [on, "_part"]).drop("_part"))


def _weighted_chunks(folded: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Folded sums times their weights as chunk rows again: what a sum has above
    its chunk goes to the next one first, so no product comes near its type."""
    low = [times((F.col(v) % F.lit(BASE)).cast("decimal(26,0)"), F.col(WEIGHT)).cast("decimal(38,0)").alias(v) for v in values]
    up = {v: F.call_function("div", F.col(v), F.lit(BASE)) for v in values}
    high = [times(c.cast("decimal(18,0)"), F.col(WEIGHT)).cast("decimal(38,0)").alias(v) for v, c in up.items()]
    here = F.struct(F.col(CHUNK), *low, (F.col("n") * F.col(WEIGHT)).alias("n"))
    above = F.struct((F.col(CHUNK) + 1).alias(CHUNK), *high, F.lit(None).cast("bigint").alias("n"))
    some = F.lit(False)
    for c in up.values():
        some = some | (F.coalesce(c, F.lit(0)) != 0)
    return folded.select(*keys, F.inline(F.when(some, F.array(here, above)).otherwise(F.array(here))))


def semi_filter(facts: DataFrame, keys: DataFrame, on: str, *,
                max_rows: int | None = None, bounded: bool = False) -> DataFrame:
    """Facts whose ``on`` is in ``keys`` (membership only: no multiplicity).

    ``bounded=True`` states that ``keys`` is small by construction (e.g. the
    output of a top-k), so it is broadcast without a counting job.
    """
    distinct_keys = keys.select(on).distinct()
    if bounded or fits_broadcast(distinct_keys, max_rows):
        return facts.join(F.broadcast(distinct_keys), on, "left_semi")
    return facts.join(distinct_keys.hint("merge"), on, "left_semi")


def attach(facts: DataFrame, lookup: DataFrame, on: str, *,
           max_rows: int | None = None) -> DataFrame:
    """Inner join with a lookup table, broadcast when its size is checked small."""
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on)
    return facts.join(lookup.hint("merge"), on)


def join_totals_with_copies(totals: DataFrame, members: DataFrame | MemberList, on: str,
                            max_copies: int | None = None, dedupe: bool = False) -> DataFrame:
    """Per-key totals ⋈ list, one output row per list entry (aggregate-then-join).

    The list is collapsed to (key, weight) first, so duplicate entries do not
    multiply shuffle input; the copies are restored after the join.  When only
    the first ``max_copies`` rows of an ordering will be kept (a top-k), more
    than ``max_copies`` identical copies can never be selected, so the
    expansion is bounded by it without changing the result.
    """
    lst = members if isinstance(members, MemberList) else MemberList.of(members, on, dedupe=dedupe)
    joined = totals.join(F.broadcast(lst.df), on) if lst.fits_broadcast() else totals.join(lst.df.hint("merge"), on)
    copies = F.col(WEIGHT) if max_copies is None else F.least(F.col(WEIGHT), F.lit(max_copies))
    return repeat_rows(joined.withColumn(WEIGHT, copies), WEIGHT).drop(WEIGHT)


REPEAT_CHUNK = 1024


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, with no array longer than ``REPEAT_CHUNK``.

    Two generator levels (chunks, then copies within a chunk) keep a row with
    a huge weight from materialising one huge array.
    """
    t = F.col(times).cast("bigint")
    n_chunks = F.floor((t + REPEAT_CHUNK - 1) / REPEAT_CHUNK).cast("int")
    chunked = df.select("*", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("_chunk"))
    in_chunk = F.least(F.lit(REPEAT_CHUNK).cast("bigint"), t - F.col("_chunk") * REPEAT_CHUNK)
    return chunked.select(
        "*", F.explode(F.sequence(F.lit(1), in_chunk.cast("int"))).alias("_copy")
    ).drop("_chunk", "_copy")
