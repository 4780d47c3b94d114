"""UTC month buckets for epoch seconds, independent of the session time zone.

Per row only an integer month index is computed (``year * 12 + month - 1``);
aggregations group by that integer and the ``"yyyy - MM"`` label is rendered
afterwards on the few result rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
# The Gregorian calendar repeats every 400 years.
_ERA_SECONDS, _ERA_MONTHS = 146097 * SECONDS_PER_DAY, 4800

# Epochs that gmtime and strftime take: the years of a C int, from 1900 on in
# a broken-down time below and as a plain number above.
MIN_EPOCH = -67768040609740800
MAX_EPOCH = 67767976233532799


def epoch_in_range(epoch: Column) -> Column:
    return epoch.between(F.lit(MIN_EPOCH), F.lit(MAX_EPOCH))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def month_index(epoch: Column) -> Column:
    """``year * 12 + month - 1`` of a UTC epoch-seconds value (bigint).

    Callers evaluate it only for epochs inside ``MIN_EPOCH..MAX_EPOCH`` (under
    a ``when``).  Spark's date type ends at 32-bit day numbers, so it only gets
    the day within an era of 400 years from 1970 on; the eras are counted.
    """
    seconds = epoch.cast("bigint")
    in_era = F.pmod(seconds, F.lit(_ERA_SECONDS))
    day = F.date_from_unix_date(_div(in_era, SECONDS_PER_DAY).cast("int"))
    return _div(seconds - in_era, _ERA_SECONDS) * _ERA_MONTHS + F.year(day) * 12 + F.month(day) - 1


def month_label(index: Column) -> Column:
    """The strftime("%Y - %m") label of a month index: ``"yyyy - MM"``, with
    the year in as many digits as it has."""
    month = F.pmod(index, F.lit(12))
    year = _div(index - month, 12)
    return F.concat(
        year.cast("string"), F.lit(" - "), F.lpad((month + 1).cast("string"), 2, "0")
    )


def epoch_seconds_of_local(ts: Column) -> Column:
    """Epoch seconds of a ``timestamp_ntz`` read as UTC wall-clock time (bigint)."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * SECONDS_PER_DAY
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )
