"""Relations that the queries derive from the test tables, the same in each dialect."""

from __future__ import annotations

from .dialect import Dialect


def mean(x: str) -> str:
    """Average of amounts in cents, exact up to one division."""
    return f"CAST(sum(CAST(round({x} * 100) AS BIGINT)) AS DOUBLE) / (1e2 * count(*))"


def ohlcv(d: Dialect) -> str:
    """Daily bars per order priority; the priority stands for a symbol."""
    return f"""SELECT o_orderpriority AS symbol, {d.day('o_orderdate')} AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
      min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"""


def daily(d: Dialect) -> str:
    """One value per day over all orders."""
    return f"SELECT {d.day('o_orderdate')} AS date, {mean('o_totalprice')} AS value FROM orders GROUP BY 1"


def nav(d: Dialect) -> str:
    """Monthly fund values with natural gaps."""
    return f"SELECT {d.month('o_orderdate')} AS date, o_orderpriority AS fund, {mean('o_totalprice')} AS nav FROM orders GROUP BY 1, 2"


def prices(d: Dialect) -> str:
    """Monthly close per market segment and the segment's shares."""
    return f"""SELECT p.date, p.ticker, p.close, s.shares FROM (SELECT {d.month('o_orderdate')} AS date, c_mktsegment AS ticker, {mean('o_totalprice')} AS close
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) p JOIN (SELECT c_mktsegment AS ticker, CAST(count(*) AS DOUBLE) AS shares FROM customer GROUP BY 1) s ON p.ticker = s.ticker"""


def quarters(d: Dialect) -> str:
    """Statements per year and quarter."""
    return """SELECT year, quarter, revenue, cost, cash_flow, revenue - cost AS gross, receivables FROM (
      SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS revenue,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 * CASE WHEN quarter(o_orderdate) % 2 = 1 THEN 6e-1 ELSE 65e-2 END AS cost,
      CAST(sum(CAST(round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE 0 END * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS cash_flow,
      CAST(sum(CAST(round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS receivables
      FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate)) q"""


def dirty(d: Dialect) -> str:
    """Customers with missing balances, padded names and repeated rows."""
    one = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS c_name, c_nationkey,
      CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment, 1 AS c_const,
      CASE WHEN c_custkey % 3 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') ELSE 'not an address' END AS c_mail FROM customer"""
    return f"{one} UNION ALL SELECT * FROM ({one}) r WHERE c_custkey % 50 = 0"


def logs(d: Dialect) -> str:
    """Log lines of events: a level, a message and the time, null for some."""
    return f"""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE {d.stamp('ts')} END AS stamp, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
      concat(event_type, ' by user ', CAST(user_id AS VARCHAR(20)), ' from 10.0.', CAST(user_id % 250 AS VARCHAR(20)), '.7 took ', CAST(event_id % 900 AS VARCHAR(20)), 'ms at /api/v1/items/', CAST(event_id AS VARCHAR(20))) AS message FROM events"""


def steps(d: Dialect) -> str:
    """Load-test steps: events per hour of the first day and on."""
    return f"""SELECT CAST(row_number() OVER (ORDER BY h) AS BIGINT) AS concurrency, rps, avg_latency_ms, p99_ms, errors, total_requests FROM (
      SELECT {d.day('ts')} AS h, CAST(count(*) AS DOUBLE) AS rps, round(avg(value), 6) AS avg_latency_ms, round({d.pct('value', 0.99)}, 6) AS p99_ms,
      CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS total_requests FROM events GROUP BY 1) s"""


def tasks(d: Dialect) -> str:
    """A binary tree of tasks: each depends on its half."""
    return "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey > 1 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS dep, CAST(p_size AS DOUBLE) AS duration FROM part"


def risks(d: Dialect) -> str:
    return "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(1 + p_size % 5 AS INT) AS probability, CAST(1 + p_partkey % 5 AS INT) AS impact, CASE WHEN p_partkey % 9 = 0 THEN 'closed' ELSE 'open' END AS status FROM part"


def cjk(d: Dialect) -> str:
    """Documents; every fifth has Chinese sentences put before it."""
    text = "系统已经上线——我们开始test工作。此外，值得注意的是，这不仅是开始，而且是挑战。"
    return f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat({d.lit(text)}, text) ELSE text END AS text FROM documents"
