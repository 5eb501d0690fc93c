"""SQL oracle: for each registered query, an independent ANSI/DuckDB SQL
text over the raw test tables (lineitem, orders, part, events), written from
the reference's semantics.  The fixture and cleaning rules are a CTE prefix.

Conventions shared with the Spark side so that values hash equal:
doubles summed without rounding (``xsum``); SQL ROUND as
``sign(x)*floor(abs(x)*10^n+0.5)/10^n``; pandas round as
``round_even(x*10^n, 0)/10^n``; integer sums cast to BIGINT; timestamps as
TIMESTAMP; dates as TIMESTAMP (midnight).
"""

from __future__ import annotations

ORDERS_RAW = """
raw AS (
  SELECT make_timestamp(CAST((1706140800 + dy * 86400 + sec) * 1000000 AS BIGINT)) AS event_time,
    CASE WHEN m < 2 AND tier >= 2 THEN 'purchase' WHEN m < 8 AND tier >= 1 THEN 'cart' ELSE 'view' END AS event_type,
    l_partkey AS product_id, CAST(p_size AS BIGINT) AS category_id,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE p_type END AS category_code,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
    l_extendedprice AS price, o_custkey AS user_id, CAST(l_orderkey AS VARCHAR) AS user_session
  FROM (SELECT l.*, o.o_custkey, p.p_size, p.p_type, p.p_brand, o.o_custkey % 4 AS tier,
          (l.l_orderkey * 31 + l.l_linenumber * 17) % 40 AS m,
          date_diff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE)) % 14 AS dy,
          (l.l_orderkey * 7919 + l.l_linenumber * 613) % 86400 AS sec
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey) x
)"""

EVENTS_RAW = """
raw AS (
  SELECT e.ts AS event_time,
    CASE e.event_type WHEN 'click' THEN 'cart' ELSE e.event_type END AS event_type,
    e.k AS product_id, CAST(p.p_size AS BIGINT) AS category_id,
    CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE p.p_type END AS category_code,
    CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE p.p_brand END AS brand,
    e.value AS price, e.user_id, CAST(e.user_id AS VARCHAR) AS user_session
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  LEFT JOIN part p ON p.p_partkey = e.k
)"""

CLEAN = """
ev AS (
  SELECT event_time, event_type, product_id, category_id,
    COALESCE(category_code, 'Unknown') AS category_code,
    COALESCE(brand, 'Unknown') AS brand,
    price, user_id, user_session,
    CASE WHEN brand IS NULL THEN 1 ELSE 0 END AS brand_was_missing,
    CASE WHEN category_code IS NULL THEN 1 ELSE 0 END AS category_was_missing,
    CAST(EXTRACT(HOUR FROM event_time) AS INTEGER) AS hour,
    CAST(EXTRACT(DOW FROM event_time) AS INTEGER) AS day_of_week,
    CASE WHEN EXTRACT(DOW FROM event_time) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    DATE_TRUNC('day', event_time) AS date
  FROM raw WHERE price > 0 AND price < 100000
)"""


def with_ev(body: str, *ctes: str, fixture: str = "orders") -> str:
    """``WITH raw, ev, <ctes> <body>`` over the given fixture."""
    parts = [ORDERS_RAW if fixture == "orders" else EVENTS_RAW, CLEAN, *ctes]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def rsql(x: str, n: int = 2) -> str:
    """SQL ROUND rule (half away from zero on the binary value)."""
    p = f"{10 ** n}.0"
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.5) / {p})"


def rnp(x: str, n: int = 2) -> str:
    """pandas/numpy round rule (half to even on x * 10^n)."""
    p = f"{10 ** n}.0"
    return f"(round_even(({x}) * {p}, 0) / {p})"


def nz(num: str, den: str) -> str:
    """num / NULLIF(den, 0) as double."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def z0(num: str, den: str) -> str:
    """guarded ratio: 0 when den = 0."""
    return f"(CASE WHEN {den} <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"


def xsum(x: str) -> str:
    """SUM of doubles without rounding, rounded once: in whole multiples of
    2^-60 as HUGEINT, then the high and the low 53 bits as doubles."""
    s = f"SUM(CAST(({x}) * 1152921504606846976.0 AS HUGEINT))"
    return (f"((CAST({s} // 9007199254740992 AS DOUBLE) * 9007199254740992.0 + CAST({s} % 9007199254740992 AS DOUBLE))"
            " / 1152921504606846976.0)")


def xavg(x: str) -> str:
    return f"({xsum(x)} / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0))"
