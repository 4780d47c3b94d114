"""Row renderers for text results (JSON text or ``id, address`` per row), equal
to what ``json.dumps`` and ``print`` give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What needs no escape between quotes: printable ASCII but for quote and backslash.
_PLAIN = r"\A[ !#-\[\]-~]*\z"
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(c: Column) -> Column:
    code = F.ascii(c)
    above = code - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(above, 10)), _unit(F.lit(0xDC00) + F.pmod(above, F.lit(1024))))
    out = F.when(c.rlike(_PLAIN), c)
    for raw, text in _SHORT.items():
        out = out.when(c == raw, F.lit(text))
    return out.when(code >= 0x10000, pair).otherwise(_unit(code))


def json_string(s: Column) -> Column:
    """JSON string literal of ``s``: ASCII, other characters as escapes, those
    beyond 16 bits as surrogate pairs."""
    quoted = lambda body: F.concat(F.lit('"'), body, F.lit('"'))
    # an empty pattern splits between characters; the text has one at least here
    return F.when(s.rlike(_PLAIN), quoted(s)).otherwise(
        quoted(F.array_join(F.transform(F.split(s, F.lit(""), F.lit(-1)), lambda c: F.when(c == "", c).otherwise(_escaped(c))), "")))


def json_int(n: Column) -> Column:
    """JSON number text of an integral column (decimal(38,0) or bigint)."""
    return n.cast("decimal(38,0)").cast("string")


def json_double(d: Column) -> Column:
    """JSON number text of a double as Python writes it: the fewest digits that
    read back as the same number, with an exponent below 1e-4 and from 1e16 on."""
    # whole numbers that fit 64 bits have exact digits; the digits that Java
    # gives are others at times, and more than needed before its version 19
    whole = (F.abs(d) < F.lit(2.0 ** 63)) & (F.abs(d) >= 1) & (d == F.floor(d))
    text = F.when(whole, F.when(whole, F.abs(d)).cast("bigint").cast("string")).otherwise(F.abs(d).cast("string"))
    part = lambda i: F.regexp_extract(text, r"^([0-9]+)\.?([0-9]*)(?:E(-?[0-9]+))?$", i)
    digits = F.concat(part(1), part(2))
    lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
    # the number is 0.<digits> times 10 to the power of ``place``
    place = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) - lead
    number = F.struct(F.rtrim(F.ltrim(digits, F.lit("0")), F.lit("0")).alias("digits"), place.alias("place"))

    def rounded(n: Column, k: Column) -> Column:
        """``n`` in ``k`` digits."""
        whole = F.rpad(n["digits"], 20, "0").cast("decimal(20,0)")
        unit = F.rpad(F.lit("1"), (F.lit(21) - k).cast("int"), F.lit("0")).cast("decimal(21,0)")
        half = F.call_function("div", unit, F.lit(2))
        up = F.call_function("div", (whole + half.cast("decimal(20,0)")).cast("decimal(21,0)"), unit).cast("string")
        more = F.length(up) - k  # one digit more after 9...9
        return F.struct(F.rtrim(up, F.lit("0")).alias("digits"), (n["place"] + more).cast("int").alias("place"))

    def reads_back(n: Column) -> Column:
        return F.concat(F.lit("0."), n["digits"], F.lit("E"), n["place"].cast("string")).cast("double") == F.abs(d)

    def shortest(n: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.length(n["digits"])), lambda k: rounded(n, k))
        return F.get(F.filter(tries, reads_back), F.lit(0))

    def shown(n: Column) -> Column:
        exponent, size = n["place"] - 1, F.length(n["digits"])
        fixed = (F.when(n["place"] <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -n["place"]), n["digits"]))
                 .when(size <= n["place"], F.concat(n["digits"], F.repeat(F.lit("0"), n["place"] - size), F.lit(".0")))
                 .otherwise(F.concat(F.substring(n["digits"], F.lit(1), n["place"]), F.lit("."), F.substring(n["digits"], n["place"] + 1, size))))
        mantissa = F.concat(F.substring(n["digits"], F.lit(1), F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substring(n["digits"], F.lit(2), size))).otherwise(""))
        power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
        return F.when((exponent >= -4) & (exponent < 16), fixed).otherwise(F.concat(mantissa, power))

    # folds stand for names: each step's result is computed once
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    sign = F.when((d < 0) | (text.isNotNull() & F.startswith(d.cast("string"), F.lit("-"))), "-").otherwise("")
    body = F.when(d == 0, F.lit("0.0")).otherwise(once(number, lambda n: once(shortest(n), shown)))
    return F.when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, body))


def json_array(*items: Column) -> Column:
    """``json.dumps([a, b, ...])`` given already rendered item texts."""
    parts = [F.lit("[")]
    for i, item in enumerate(items):
        if i:
            parts.append(F.lit(", "))
        parts.append(item)
    parts.append(F.lit("]"))
    return F.concat(*parts)


def list_line(id_: Column, address: Column) -> Column:
    """``print(id, end=''); print(",", address)`` -> ``"<id>, <address>"``."""
    return F.concat(id_, F.lit(", "), address)
