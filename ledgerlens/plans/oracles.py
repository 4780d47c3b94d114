"""DuckDB SQL computing each registered question straight from the test tables.

The oracle does not render or parse any text: it knows which rows the
renderers corrupt (``sources.fixtures``) and applies the question's predicate
set to the native columns.  Exact totals are HUGEINT rendered as VARCHAR;
a mean is the double nearest to the exact quotient of sum and count, by long
division of the sum's digits.
"""

from __future__ import annotations

from ledgerlens.plans.registry import FIXTURE_LISTED_ADDRESSES, FIXTURE_SCAM_ID

_M = "(l_orderkey * 7 + l_linenumber) % 101"
_ADDR = "'0x' || lpad(CAST({k} AS VARCHAR), 40, '0')"

TX = f"""tx AS (
  SELECT {_M} AS m,
         CASE WHEN {_M} = 4 THEN '' ELSE {_ADDR.format(k='l_suppkey')} END AS to_address,
         CAST(round(l_extendedprice * 100) AS HUGEINT) * CAST(10000000000000000 AS HUGEINT) AS value,
         CAST(round(l_quantity) AS BIGINT) * 1000 AS gas,
         CAST(round(l_discount * 100) AS BIGINT) AS gas_price,
         strftime(l_shipdate, '%Y - %m') AS month
  FROM lineitem)"""

# value checked; gas checked; gas price checked; gas and value checked
VALUE_OK = "m NOT IN (0, 1, 3)"
GAS_OK = "m NOT IN (0, 2, 3)"
GAS_PRICE_OK = "m NOT IN (0, 3, 5)"
GAS_VALUE_OK = "m NOT IN (0, 1, 2, 3)"

CONTRACTS = f"""ct0 AS (
  SELECT {_ADDR.format(k='s_suppkey')} AS address, s_suppkey FROM supplier
  WHERE s_suppkey % 17 <> 0),
ct AS (SELECT address FROM ct0 UNION ALL SELECT address FROM ct0 WHERE s_suppkey % 10 = 0)"""

PAIRS = f"""pairs AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS id, {_ADDR.format(k='s_suppkey')} AS address FROM supplier
  UNION ALL
  SELECT CAST(100 + s_suppkey % 3 AS VARCHAR) AS id, {_ADDR.format(k='s_suppkey')} AS address
  FROM supplier WHERE s_suppkey % 2 = 0)"""

BLOCKS = """bl AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS miner,
         CAST(floor(o_totalprice) AS BIGINT) AS size,
         (length(o_orderpriority) + length(o_orderstatus) + CAST(o_custkey % 40 AS BIGINT)
          + length(CAST(o_orderkey AS VARCHAR)) - 10) * 4 AS bits
  FROM orders WHERE o_orderkey % 61 <> 0)"""


def _quotient(t: str, n: str) -> str:
    """Double nearest to the quotient of digits ``t`` and a count ``n``: steps of
    18 digits, 126 digits behind the point, and a last one for a remainder."""
    k = f"((length({t}) + 17) // 18)"
    step = f"(a.rest * 1000000000000000000 + b.rest)"
    folded = f"""list_reduce(list_transform(range({k} + 7), lambda i: {{'rest': CASE WHEN i < {k} THEN substr(lpad({t}, {k}::INT * 18, '0'), (i * 18 + 1)::INT, 18) ELSE '0' END::HUGEINT,
    'text': CASE WHEN i = {k} THEN '.' ELSE '' END}}),
  lambda a, b: {{'rest': {step} % {n}, 'text': a.text || b.text || lpad(({step} // {n})::VARCHAR, 18, '0')}}, {{'rest': 0::HUGEINT, 'text': ''}})"""
    return f"(SELECT (x.text || CASE WHEN x.rest > 0 THEN '1' ELSE '0' END)::DOUBLE FROM (SELECT {folded} AS x))"


def _means(name: str, rows: str, more: str = "") -> str:
    """``month`` and mean of rows (month, t, n), with other columns."""
    return f"SELECT month, {more}{_quotient('t', 'n')} AS {name} FROM ({rows}) AS sums"


def _mean_by(measure: str, name: str, source: str, more: str = "") -> str:
    return _means(name, f"SELECT month, CAST(sum({measure}) AS VARCHAR) AS t, count(*) AS n {source}", more)


def _monthly_mean(where: str, measure: str, name: str, extra: str = "", join: str = "") -> str:
    return f"WITH {TX}{extra} " + _mean_by(measure, name, f"FROM tx {join} WHERE {where} GROUP BY month")


def _pairs(means: str, name: str) -> str:
    return f"""SELECT '["' || month || '", ' || CAST({name} AS VARCHAR) || ']' AS value FROM ({means}) AS m"""


# Fixed value: what Python strips around a number (Unicode white space).
_WHITE = r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _int_ok_sql(col: str) -> str:
    """Python's rule for integer text: one sign, decimal digits of any script,
    single underscores between digits, white space around."""
    return rf"regexp_full_match({col}, '[{_WHITE}]*[+-]?\p{{Nd}}+(_\p{{Nd}}+)*[{_WHITE}]*')"


TEXT_LINES = """l AS (
  SELECT unnest(string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n')) AS line
  FROM documents WHERE text <> '')"""

ODD = """odd AS (
  SELECT (l_orderkey * 7 + l_linenumber) % 11 AS m, CAST(round(l_discount * 100) AS BIGINT) AS gas_price,
         CASE (l_orderkey * 7 + l_linenumber) % 11 WHEN 3 THEN '12000 - 01' WHEN 6 THEN '500 - 01'
              ELSE strftime(l_shipdate, '%Y - %m') END AS month
  FROM lineitem)"""

# values of 32 and of 199 zeros behind are summed apart: each part is smaller
# than the place where the next one starts
WIDE = f"""wide AS (
  SELECT (l_orderkey * 7 + l_linenumber) % 11 AS m, {_ADDR.format(k='l_suppkey')} AS address,
         CAST(round(l_extendedprice * 100) AS HUGEINT) AS c, strftime(l_shipdate, '%Y - %m') AS month
  FROM lineitem)"""
_WIDE_PARTS = """coalesce(sum(c) FILTER (m = 1), 0) AS c2, coalesce(sum(c) FILTER (m = 0), 0) AS c1,
         coalesce(sum(CASE WHEN m = 2 THEN -c ELSE c END) FILTER (m NOT IN (0, 1)), 0) AS c0, count(*) AS n"""
_WIDE_TEXT = """regexp_replace(c2::VARCHAR || lpad(c1::VARCHAR || lpad(c0::VARCHAR, 32, '0'), 199, '0'), '^0+(.)', '\\1')"""

_LISTED = ", ".join(f"'{a}'" for a in FIXTURE_LISTED_ADDRESSES)

_TOP_CONTRACTS = f"""WITH {TX}, {CONTRACTS},
tot AS (SELECT to_address AS address, sum(value) AS total FROM tx WHERE {VALUE_OK} GROUP BY 1),
top AS (SELECT address, total FROM tot JOIN ct USING (address) ORDER BY total DESC, address LIMIT 10)"""

_SCAM_TOTALS = f"""WITH {TX}, {PAIRS},
tot AS (SELECT id, sum(value) AS total FROM tx JOIN pairs ON tx.to_address = pairs.address
        WHERE {VALUE_OK} GROUP BY id),
top AS (SELECT id, total FROM tot ORDER BY total DESC, id LIMIT 10)"""

ORACLES: dict[str, str] = {
    "line_arity_profile": f"""WITH {TEXT_LINES},
f AS (SELECT string_split(line, ',') AS f FROM l)
SELECT CAST(len(f) AS BIGINT) AS n_fields, count(*) AS n_lines,
       CAST(sum(CASE WHEN {_int_ok_sql('f[1]')} THEN 1 ELSE 0 END) AS BIGINT) AS n_int_first
FROM f GROUP BY 1""",

    "reject_report": f"""WITH {TX},
r AS (
  SELECT 'monthly' AS family, CASE WHEN m IN (0, 3) THEN 'arity' WHEN m = 1 THEN 'value' ELSE 'ok' END AS reason FROM tx
  UNION ALL
  SELECT 'value', CASE WHEN m IN (0, 3) THEN 'arity' WHEN m = 1 THEN 'value' ELSE 'ok' END FROM tx
  UNION ALL
  SELECT 'gas_price', CASE WHEN m IN (0, 3) THEN 'arity' WHEN m = 5 THEN 'gas_price' ELSE 'ok' END FROM tx
  UNION ALL
  SELECT 'gas', CASE WHEN m IN (0, 3) THEN 'arity' WHEN m = 2 THEN 'gas' ELSE 'ok' END FROM tx
  UNION ALL
  SELECT 'gas_value', CASE WHEN m IN (0, 3) THEN 'arity' WHEN m = 2 THEN 'gas'
                           WHEN m = 1 THEN 'value' ELSE 'ok' END FROM tx)
SELECT family, reason, count(*) AS n_lines FROM r GROUP BY family, reason""",

    "monthly_count": f"""WITH {TX}
SELECT month, count(*) AS n FROM tx WHERE {VALUE_OK} GROUP BY month""",

    "monthly_summary": f"""WITH {TX}
""" + _mean_by("value", "mean_value", f"FROM tx WHERE {VALUE_OK} GROUP BY month", "n, t AS total_value, "),

    "monthly_mean_gas_price_reject": f"""WITH {ODD}
""" + _mean_by("gas_price", "mean_gas_price", "FROM odd WHERE m NOT IN (4, 5) GROUP BY month"),

    "odd_lines_monthly_count": f"""WITH {ODD}
SELECT month, count(*) AS n FROM odd WHERE m NOT IN (4, 5) GROUP BY month""",

    "wide_monthly_summary": f"""WITH {WIDE},
p AS (SELECT month, {_WIDE_PARTS} FROM wide WHERE m <> 10 GROUP BY month)
""" + _means("mean_value", f"SELECT month, n, {_WIDE_TEXT} AS t FROM p", "n, t AS total_value, "),

    "wide_top_contracts": f"""WITH {WIDE}, {CONTRACTS},
p AS (SELECT address, {_WIDE_PARTS} FROM wide WHERE m <> 10 GROUP BY address)
SELECT address, {_WIDE_TEXT} AS total_value FROM p JOIN ct USING (address) ORDER BY c2 DESC, c1 DESC, c0 DESC, address LIMIT 10""",

    "wide_scam_totals": f"""WITH {WIDE}, {PAIRS},
p AS (SELECT id, {_WIDE_PARTS} FROM wide JOIN pairs USING (address) WHERE m <> 10 GROUP BY id)
SELECT id, {_WIDE_TEXT} AS total_value FROM p ORDER BY c2 DESC, c1 DESC, c0 DESC, id LIMIT 10""",

    "contract_lines_report": """SELECT CASE WHEN s_suppkey % 17 = 0 THEN 'arity' ELSE 'ok' END AS reason,
  CAST(sum(CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_lines FROM supplier GROUP BY 1""",

    "block_lines_report": """SELECT CASE WHEN o_orderkey % 61 = 0 THEN 'arity' WHEN o_orderkey % 53 = 0 THEN 'size' ELSE 'ok' END AS reason,
  count(*) AS n_lines FROM orders GROUP BY 1""",

    "list_lines_report": f"""WITH {TEXT_LINES}
SELECT CASE WHEN contains(line, ',') THEN 'ok' ELSE 'arity' END AS reason, count(*) AS n_lines FROM l GROUP BY 1""",

    "top_contracts_pairs_json": f"""{_TOP_CONTRACTS}
SELECT '["' || address || '", [' || CAST(total AS VARCHAR) || ', 1]]' AS value FROM top""",

    "monthly_mean_value": _monthly_mean(VALUE_OK, "value", "mean_value"),

    "monthly_mean_gas_price": _monthly_mean(GAS_PRICE_OK, "gas_price", "mean_gas_price"),

    "monthly_mean_value_pairs_json": _pairs(_monthly_mean(VALUE_OK, "value", "mean_value"), "mean_value"),

    "monthly_mean_gas_price_pairs_json": _pairs(_monthly_mean(GAS_PRICE_OK, "gas_price", "mean_gas_price"), "mean_gas_price"),

    "address_totals": f"""WITH {TX}
SELECT to_address, CAST(sum(value) AS VARCHAR) AS total_value
FROM tx WHERE {VALUE_OK} GROUP BY to_address""",

    "top_contracts": f"""{_TOP_CONTRACTS}
SELECT address, CAST(total AS VARCHAR) AS total_value FROM top""",

    "contract_monthly_mean_gas": f"""WITH {TX}, {CONTRACTS}
""" + _mean_by("gas", "mean_gas", f"""FROM tx JOIN ct ON tx.to_address = ct.address WHERE {GAS_OK} GROUP BY month"""),

    "top_contract_monthly_mean_gas": f"""{_TOP_CONTRACTS}
""" + _mean_by("gas", "mean_gas", f"""FROM tx WHERE {GAS_VALUE_OK} AND to_address IN (SELECT address FROM top) GROUP BY month"""),

    "listed_address_monthly_mean_gas": f"""WITH {TX}
""" + _mean_by("gas", "mean_gas", f"""FROM tx WHERE {GAS_VALUE_OK} AND to_address IN ({_LISTED}) GROUP BY month"""),

    "top_miners": f"""WITH {BLOCKS},
tot AS (SELECT miner, sum(size) AS total FROM bl WHERE o_orderkey % 53 <> 0 GROUP BY miner),
top AS (SELECT miner, total FROM tot ORDER BY total DESC, miner LIMIT 10)
SELECT miner, CAST(total AS VARCHAR) AS total_size FROM top""",

    "hex_overhead_bits": f"""WITH {BLOCKS}
SELECT CAST(1 AS BIGINT) AS k, CAST(sum(bits) AS BIGINT) AS total_bits FROM bl""",

    "scam_flatten": f"""WITH {PAIRS} SELECT id, address FROM pairs""",

    "scam_document_pairs": f"""WITH {PAIRS} SELECT id, address FROM pairs""",

    "scam_list_parse": f"""WITH {PAIRS} SELECT id, address FROM pairs""",

    "scam_monthly_mean": f"""WITH {TX}, {PAIRS}
""" + _mean_by("value", "mean_value", f"""FROM tx JOIN pairs ON tx.to_address = pairs.address WHERE {VALUE_OK} GROUP BY month"""),

    "scam_top_totals": f"""{_SCAM_TOTALS}
SELECT id, CAST(total AS VARCHAR) AS total_value FROM top""",

    "scam_id_monthly_mean": f"""WITH {TX}, {PAIRS}
""" + _mean_by("value", "mean_value", f"""FROM tx JOIN pairs ON tx.to_address = pairs.address
WHERE {VALUE_OK} AND pairs.id = '{FIXTURE_SCAM_ID}' GROUP BY month"""),

    "scam_leader_monthly_mean": f"""{_SCAM_TOTALS},
leader AS (SELECT id FROM top ORDER BY total DESC, id LIMIT 1)
""" + _mean_by("value", "mean_value", f"""FROM tx JOIN pairs ON tx.to_address = pairs.address
WHERE {VALUE_OK} AND pairs.id IN (SELECT id FROM leader) GROUP BY month"""),

    "broadcast_count_lookup": f"""WITH {TX}
""" + _mean_by("value", "mean_value", f"FROM tx WHERE {VALUE_OK} GROUP BY month", "n, t AS total_value, "),

    "limit_preview": f"""WITH {TX},
tot AS (SELECT to_address, sum(value) AS total FROM tx WHERE {VALUE_OK} GROUP BY to_address)
SELECT to_address, CAST(total AS VARCHAR) AS total_value FROM tot ORDER BY to_address LIMIT 10""",

    "result_pairs_json": f"""WITH {TX}
SELECT '["' || month || '", ' || CAST(count(*) AS VARCHAR) || ']' AS value
FROM tx WHERE {VALUE_OK} GROUP BY month""",
}
