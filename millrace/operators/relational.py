"""Projections, filters, joins, aggregations, set operations, sorts and limits."""

from __future__ import annotations

from ..plans import fixtures as fx
from ..plans.dialect import Registry
from ..plans.ranks import quantiles

R = Registry()
op = R.op


def C(x: str) -> str:  # noqa: N802
    return f"CAST({x} AS BIGINT)"


def ones(cond: str) -> str:
    return f"coalesce(CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT), 0)"


# --- projections and filters ---


@op("project_columns", "customer", columns=("c_custkey", "c_name"))
def project_columns(d, rel, columns):
    return f"SELECT {', '.join(columns)} FROM {rel} t"


@op("rename_alias", fx.ohlcv, aliases={"symbol": "Symbol", "date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume"})
def rename_alias(d, rel, aliases):
    return "SELECT " + ", ".join(f"{a} AS {b}" for a, b in aliases.items()) + f" FROM {rel} t"


@op("filter_not_null", fx.dirty, columns=("c_acctbal",))
def filter_not_null(d, rel, columns):
    return f"SELECT * FROM {rel} t WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns)


@op("filter_isin", "customer", column="c_mktsegment", values=("BUILDING", "MACHINERY"))
def filter_isin(d, rel, column, values):
    return f"SELECT * FROM {rel} t WHERE {column} IN ({', '.join(map(d.lit, values))})"


@op("filter_level_time", fx.logs, level="ERROR", since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
def filter_level_time(d, rel, level, since, until):
    """Rows without a time pass the time bounds."""
    return f"SELECT * FROM {rel} t WHERE level = {d.lit(level)} AND (stamp IS NULL OR (stamp >= {d.lit(since)} AND stamp <= {d.lit(until)}))"


@op("slice_timeseries", fx.daily, start="1996-01-01", end="1997-12-31")
def slice_timeseries(d, rel, start, end):
    """Dates in [start, end]; rows whose date is no date go."""
    return f"SELECT * FROM {rel} t WHERE try_cast(date AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'"


@op("slice_trades", lambda d: f"SELECT l_orderkey AS lot, l_linenumber AS n, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE {d.day('l_shipdate')} END AS exit_date, CASE WHEN l_orderkey % 5 = 0 THEN 'n/a' ELSE {d.day('l_shipdate')} END AS entry_date FROM lineitem", start="1996-01-01", end="1996-06-30")
def slice_trades(d, rel, start, end):
    """By exit, else entry date; rows whose date is no date stay."""
    at = "try_cast(coalesce(exit_date, entry_date) AS DATE)"
    return f"SELECT * FROM {rel} t WHERE {at} IS NULL OR {at} BETWEEN DATE '{start}' AND DATE '{end}'"


@op("search_substring", "documents", category="fr", text="que", category_column="lang", columns=("text", "source"))
def search_substring(d, rel, category, text, category_column, columns):
    joined = " || chr(10) || ".join(f"coalesce({c}, '')" for c in columns)
    return f"SELECT doc_id, lang, source FROM {rel} t WHERE {category_column} = {d.lit(category)} AND contains(lower({joined}), {d.lit(text.lower())})"


@op("lookup_by_id_or_alias", lambda d: f"SELECT CAST(p_partkey AS STRING) AS id, p_name AS name, {d.array("concat('size ', CAST(p_size AS STRING))", 'p_brand')} AS aliases FROM part", wanted="size 17", id_column="id", alias_column="aliases", columns=("id", "name"))
def lookup_by_id_or_alias(d, rel, wanted, id_column, alias_column, columns):
    """The row with the id, else the least id among those whose list of aliases has the name."""
    hit = f"CAST({id_column} AS STRING) = {d.lit(wanted)}"
    return f"SELECT {', '.join(columns)}, CASE WHEN {hit} THEN 0 ELSE 1 END AS priority FROM {rel} t WHERE {hit} OR array_contains({alias_column}, {d.lit(wanted)}) ORDER BY priority, {id_column} LIMIT 1"


# fixed values: words that mark an error
ERROR_WORDS = r"(?i)\b(?:error|err|fail|fatal|crit|critical|panic|exception|traceback|refus|timeout|deni|reject|abort|crash|segfault|oom|kill)\w*\b"
LEVELS = {"EMERGENCY": 0, "EMERG": 0, "ALERT": 1, "CRITICAL": 2, "CRIT": 2, "FATAL": 2, "ERROR": 3, "ERR": 3}


@op("predicate_error_entry", fx.logs)
def predicate_error_entry(d, rel):
    levels = ", ".join(map(d.lit, LEVELS))
    return f"SELECT event_id, level, (upper(level) IN ({levels}) OR {d.like('message', ERROR_WORDS)}) AS is_error FROM {rel} t"


@op("window_trim_around_event", fx.daily, event="1997-03-01", before=10, after=20)
def window_trim_around_event(d, rel, event, before, after):
    return f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM {rel} t), e AS (SELECT min(rn) AS rn0 FROM n WHERE date >= {d.lit(event)})
      SELECT date, value, {C('rn - rn0')} AS step FROM n CROSS JOIN e WHERE rn BETWEEN rn0 - {before} AND rn0 + {after}"""


# --- joins ---


@op("join_left_equi", lambda d: f"SELECT date, max(CASE WHEN symbol = '1-URGENT' THEN close END) AS stock, max(CASE WHEN symbol = '5-LOW' THEN close END) AS bench FROM ({fx.ohlcv(d)}) b GROUP BY date")
def join_left_equi(d, rel):
    """Stock dates with the benchmark rebased to the stock's first close."""
    return f"""WITH s AS (SELECT date, stock FROM {rel} t WHERE stock IS NOT NULL), b AS (SELECT date, bench FROM {rel} t WHERE bench IS NOT NULL),
      f AS (SELECT min_by(stock, date) AS s0 FROM s), g AS (SELECT min_by(bench, date) AS b0 FROM b)
      SELECT s.date, s.stock, round(b.bench / b0 * s0, 4) AS rebased FROM s CROSS JOIN f CROSS JOIN g LEFT JOIN b ON s.date = b.date"""


@op("join_map_lookup", "customer", dim=lambda d: "nation", key="c_nationkey", dim_key="n_nationkey", value="n_name", columns=("c_custkey",))
def join_map_lookup(d, rel, dim, key, dim_key, value, columns):
    """The value of each row's key, null where the lookup has none."""
    return f"SELECT {', '.join('t.' + c for c in columns)}, m.{value} FROM {rel} t LEFT JOIN {dim} m ON t.{key} = m.{dim_key}"


@op("join_self_prior_period", fx.quarters)
def join_self_prior_period(d, rel):
    return f"SELECT a.year, a.quarter, a.revenue, b.revenue AS prior FROM {rel} a LEFT JOIN {rel} b ON a.year = b.year + 1 AND a.quarter = b.quarter"


@op("join_drawdown_points", fx.daily)
def join_drawdown_points(d, rel):
    return f"""SELECT e.date, e.value, round(coalesce(p.drawdown, 0), 6) AS drawdown FROM {rel} e LEFT JOIN (
      SELECT date, value / max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM {rel} t) p ON e.date = p.date AND p.drawdown < 0"""


# fixed values: suffixes of plural forms
PLURALS = ("_zero", "_one", "_two", "_few", "_many", "_other")


@op("join_anti_missing_keys", lambda d: "SELECT concat('k', CAST(p_partkey % 400 AS STRING)) AS k FROM part", have=lambda d: "SELECT concat('k', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '_other' ELSE '' END) AS k FROM part WHERE p_partkey % 3 <> 0", key="k", suffixes=PLURALS)
def join_anti_missing_keys(d, rel, have, key, suffixes):
    """Used keys that the locale lacks, also in every plural form."""
    forms = " UNION ALL ".join(f"SELECT {key}, concat({key}, '{s}') AS f FROM u" for s in ("", *suffixes))
    return f"WITH u AS (SELECT DISTINCT {key} FROM {rel} t), f AS ({forms}) SELECT {key} FROM u EXCEPT SELECT f.{key} FROM f JOIN {have} h ON f.f = h.{key}"


@op("join_semi_fk", lambda d: f"SELECT id, dep FROM ({fx.tasks(d)}) r UNION ALL SELECT 1 + max(p_partkey), -max(p_partkey) FROM part")
def join_semi_fk(d, rel):
    """Dependencies without a task."""
    return f"SELECT t.id, t.dep FROM {rel} t LEFT JOIN (SELECT DISTINCT id AS known FROM {rel} s) k ON t.dep = k.known WHERE t.dep IS NOT NULL AND k.known IS NULL"


def _modules(d) -> str:
    """A file for each supplier, with a module of a depth of its own."""
    deep = " || ".join(f"CASE WHEN s_suppkey % 13 > {k} THEN 'p{k}.' ELSE '' END" for k in range(12))
    return f"SELECT concat('src/', CAST(s_suppkey AS VARCHAR(20)), '.py') AS file, {deep} || concat('m', CAST(s_suppkey AS VARCHAR(20))) AS module FROM supplier"


def _imports(d) -> str:
    """Each file imports the module of another, of itself, or none, behind parts that belong to no module."""
    last = "concat('m', CAST(s_suppkey + s_suppkey % 3 AS VARCHAR(20)))"
    front = " || ".join(f"CASE WHEN s_suppkey % 17 > {k} THEN 'x{k}.' ELSE '' END" for k in range(16))
    deep = " || ".join(f"CASE WHEN (s_suppkey + s_suppkey % 3) % 13 > {k} THEN 'p{k}.' ELSE '' END" for k in range(12))
    return f"SELECT concat('src/', CAST(s_suppkey AS VARCHAR(20)), '.py') AS file, {front} || {deep} || {last} AS wanted FROM supplier"


@op("join_import_resolution", _modules, imports=_imports)
def join_import_resolution(d, rel, imports):
    """Imports (file, wanted) of modules (file, module): the module itself, else its longest dotted suffix that is one; a file that imports itself has no edge.

    Slashes count as dots.  Each import is told by all of its suffixes, whatever its
    depth, and the longest that meets a module is kept.
    """
    dotted = f"SELECT DISTINCT file, {d.replace('wanted', '[/\\\\]', '.')} AS wanted FROM {imports} i WHERE wanted IS NOT NULL"
    parts = f"SELECT file, wanted, {d.split('wanted', '.')} AS parts FROM ({dotted}) w"
    if d.spark:
        cut = f"SELECT file, wanted, k, array_join(slice(parts, k + 1, size(parts) - k), '.') AS suffix FROM (SELECT file, wanted, parts, explode(sequence(0, size(parts) - 1)) AS k FROM ({parts}) p) c"
        known = f"SELECT module, max_by(file, file) AS target FROM {rel} m GROUP BY module"
        hit = f"SELECT file, wanted, min_by(target, k) AS target FROM ({cut}) s JOIN ({known}) m ON suffix = module GROUP BY file, wanted"
        return f"SELECT file, wanted, target FROM ({hit}) h WHERE target <> file"
    hit = f"SELECT w.file, w.wanted, m.target, row_number() OVER (PARTITION BY w.file, w.wanted ORDER BY length(m.module) DESC) AS rn FROM ({dotted}) w JOIN (SELECT module, max(file) AS target FROM {rel} x GROUP BY module) m ON w.wanted = m.module OR ends_with(w.wanted, concat('.', m.module))"
    return f"SELECT file, wanted, target FROM ({hit}) h WHERE rn = 1 AND target <> file"


@op("join_pairs_fill", lambda d: "SELECT n_nationkey AS zh, n_nationkey + 1 AS en FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 20", extra=lambda d: "SELECT n_nationkey AS zh, n_nationkey + 1 AS en FROM nation WHERE n_nationkey % 4 = 0",
    catalog=lambda d: "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS category FROM nation")
def join_pairs_fill(d, rel, extra, catalog):
    """Pairs (zh, en) plus extra ones not there yet; a missing category of the catalog (k, category) comes from the other side."""
    return f"""WITH a AS (SELECT zh, en FROM {rel} p UNION ALL SELECT x.zh, x.en FROM {extra} x LEFT JOIN (SELECT zh AS z2 FROM {rel} r) q ON x.zh = q.z2 WHERE q.z2 IS NULL)
      SELECT a.zh, a.en, coalesce(z.category, e.category) AS zh_category, coalesce(e.category, z.category) AS en_category, (z.k IS NULL OR e.k IS NULL) AS missing FROM a LEFT JOIN {catalog} z ON a.zh = z.k LEFT JOIN {catalog} e ON a.en = e.k"""


@op("join_cross_pairs", "lineitem", columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def join_cross_pairs(d, rel, columns):
    """All pairs of columns in one aggregate, then one row a pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(pairs))
    rows = d.long("", "m", [{"a": f"'{a}'", "b": f"'{b}'", "r": f"round(r{i}, 6)"} for i, (a, b) in enumerate(pairs)])
    return f"WITH m AS (SELECT {one} FROM {rel} t) {rows}"


# --- aggregations ---


@op("agg_count_by", "events", key="event_type")
def agg_count_by(d, rel, key):
    return f"SELECT {key}, count(*) AS n FROM {rel} t GROUP BY {key}"


@op("agg_top_n", "lineitem", key="l_partkey", n=10)
def agg_top_n(d, rel, key, n):
    return f"SELECT {key}, count(*) AS n FROM {rel} t GROUP BY {key} ORDER BY n DESC, {key} LIMIT {n}"


@op("agg_sum_add_del", lambda d: "SELECT p_brand AS file, CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE CAST(p_size AS STRING) END AS added, CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE CAST(p_partkey % 10 AS STRING) END AS deleted FROM part", file="file", added="added", deleted="deleted")
def agg_sum_add_del(d, rel, file, added, deleted):
    """Sums of added and deleted lines per file; '-' of binary files is no number."""
    return f"SELECT {file} AS file, {C(f'sum(try_cast({added} AS BIGINT))')} AS added, {C(f'sum(try_cast({deleted} AS BIGINT))')} AS deleted FROM {rel} t GROUP BY {file}"


@op("agg_share_pct", "orders", key="o_orderpriority")
def agg_share_pct(d, rel, key):
    return f"SELECT {key}, n, round(n * 100.0 / sum(n) OVER (), 1) AS pct FROM (SELECT {key}, CAST(count(*) AS DOUBLE) AS n FROM {rel} t GROUP BY {key}) x"


@op("agg_last_active", "orders", key="o_custkey", ts="o_orderdate")
def agg_last_active(d, rel, key, ts):
    return f"SELECT {key}, {d.day(f'max({ts})')} AS last_active FROM {rel} t GROUP BY {key}"


@op("agg_group_stats", "lineitem", group="l_returnflag", value="l_extendedprice")
def agg_group_stats(d, rel, group, value):
    a = f"SELECT {group}, count({value}) AS n, round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS std FROM {rel} t GROUP BY {group}"
    return f"SELECT a.*, round(q0, 4) AS median FROM ({a}) a JOIN ({quantiles(d, rel, value, (0.5,), group)}) m ON a.{group} IS NOT DISTINCT FROM m.g"


@op("agg_weighted_avg", "part", value="p_retailprice", weight="p_size")
def agg_weighted_avg(d, rel, value, weight):
    return f"SELECT round(coalesce(sum({value} * {weight}) / nullif(sum({weight}), 0), 0), 4) AS weighted FROM {rel} t"


@op("agg_distinct_count", "lineitem", columns=("l_partkey", "l_suppkey", "l_shipdate"))
def agg_distinct_count(d, rel, columns):
    return "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in columns) + f" FROM {rel} t"


@op("agg_mode", "customer", column="c_mktsegment")
def agg_mode(d, rel, column):
    return f"SELECT {column} AS mode, n FROM (SELECT {column}, count(*) AS n FROM {rel} t WHERE {column} IS NOT NULL GROUP BY {column}) x ORDER BY n DESC, {column} LIMIT 1"


@op("agg_quantile", "lineitem", column="l_extendedprice", qs=(0.25, 0.5, 0.75, 0.9, 0.99))
def agg_quantile(d, rel, column, qs):
    return "SELECT " + ", ".join(f"round(q{i}, 4) AS q{f'{q * 100:g}'.replace('.', '_')}" for i, q in enumerate(qs)) + f" FROM ({quantiles(d, rel, column, qs)}) t"


@op("agg_median_even", "lineitem", group="l_linestatus", column="l_extendedprice")
def agg_median_even(d, rel, group, column):
    return f"SELECT g AS {group}, round(q0, 4) AS median FROM ({quantiles(d, rel, column, (0.5,), group)}) t"


@op("agg_hhi", fx.prices)
def agg_hhi(d, rel):
    return f"""SELECT round(sum(w * w), 6) AS hhi, round(max(w), 6) AS top_weight, max_by(ticker, w) AS top, max(w) > 0.30 AS concentrated FROM (
      SELECT ticker, cap / sum(cap) OVER () AS w FROM (SELECT ticker, max_by(close, date) * max(shares) AS cap FROM {rel} t GROUP BY ticker) x) y"""


@op("agg_crosstab", "orders", a="o_orderstatus", b="o_orderpriority", values=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
def agg_crosstab(d, rel, a, b, values):
    return f"SELECT {a}, " + ", ".join(f"{ones(f'{b} = {d.lit(v)}')} AS c{i + 1}" for i, v in enumerate(values)) + f" FROM {rel} t GROUP BY {a}"


@op("agg_pivot_last", fx.prices, tickers=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
def agg_pivot_last(d, rel, tickers):
    return "SELECT date, " + ", ".join(f"max_by(CASE WHEN ticker = '{t}' THEN close END, CASE WHEN ticker = '{t}' THEN date END) AS {t.lower()}" for t in tickers) + f" FROM {rel} t GROUP BY date"


@op("pivot_table", "orders", rows="o_orderstatus", columns="year(o_orderdate)", values=(1995, 1996, 1997), measure="o_totalprice", where="o_totalprice > 1000")
def pivot_table(d, rel, rows, columns, values, measure, where):
    cell = lambda f, v: f"round({f}(CASE WHEN {columns} = {v} THEN {measure} END), 2)"
    parts = [f"{cell(f, v)} AS {f}_{v}" for v in values for f in ("sum", "avg", "max", "min")] + [f"{ones(f'{columns} = {v}')} AS count_{v}" for v in values]
    return f"SELECT {rows}, {', '.join(parts)} FROM {rel} t WHERE {where} GROUP BY {rows}"


@op("agg_time_hourly", "events")
def agg_time_hourly(d, rel):
    """Errors per hour of the day, zero where there are none."""
    return f"SELECT CAST(h.h AS BIGINT) AS hour, coalesce(e.n, 0) AS n FROM (SELECT {d.unnest(d.seq('0', '23'))} AS h) h LEFT JOIN (SELECT hour(ts) AS hr, count(*) AS n FROM {rel} t WHERE event_type = 'error' GROUP BY hour(ts)) e ON h.h = e.hr"


@op("agg_time_daily", "events")
def agg_time_daily(d, rel):
    return f"SELECT {d.day('ts')} AS day, count(*) AS n FROM {rel} t WHERE event_type = 'error' GROUP BY 1"


@op("agg_monthly_sun_hours", "events")
def agg_monthly_sun_hours(d, rel):
    """Fractions per month in three parts of the day."""
    part = lambda a, b: f"round(sum(CASE WHEN hour(ts) BETWEEN {a} AND {b} THEN least(value / 100.0, 1.0) ELSE 0 END), 4)"
    return f"SELECT CAST(month(ts) AS INT) AS month, {part(6, 10)} AS morning, {part(11, 14)} AS noon, {part(15, 19)} AS evening FROM {rel} t GROUP BY month(ts)"


@op("agg_grid_bucket", fx.risks)
def agg_grid_bucket(d, rel):
    """Open risks per cell with the level of its score."""
    return f"""SELECT probability, impact, {C('count(*)')} AS n, probability * impact AS score, CASE WHEN probability * impact >= 15 THEN 'critical' WHEN probability * impact >= 10 THEN 'high' WHEN probability * impact >= 5 THEN 'medium' ELSE 'low' END AS level,
      min(id) AS first_id, max(id) AS last_id FROM {rel} t WHERE status <> 'closed' GROUP BY probability, impact"""


@op("agg_level_distribution", fx.logs)
def agg_level_distribution(d, rel):
    return f"SELECT coalesce(level, 'UNKNOWN') AS level, count(*) AS n FROM {rel} t GROUP BY 1"


@op("agg_profile_rollup", "lineitem", fn="l_suppkey", own="l_quantity", cumulative="l_quantity + l_tax", sort="tottime", n=20)
def agg_profile_rollup(d, rel, fn, own, cumulative, sort, n):
    """Calls, own and cumulative time per function, with its part of the total; ``sort`` is calls, tottime or cumtime."""
    return f"""SELECT fn, calls, tottime, cumtime, round(tottime * 100 / sum(tottime) OVER (), 2) AS pct FROM (
      SELECT {fn} AS fn, count(*) AS calls, round(sum({own}), 4) AS tottime, round(sum({cumulative}), 4) AS cumtime FROM {rel} t GROUP BY {fn}) x ORDER BY {sort} DESC, fn LIMIT {n}"""


@op("agg_event_summary", lambda d: "SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE round(l_discount - 0.05, 4) END AS pnl_pct FROM lineitem")
def agg_event_summary(d, rel):
    a = f"SELECT count(*) AS total, round(avg(pnl_pct), 6) AS average, max(pnl_pct) AS best, min(pnl_pct) AS worst, round({ones('pnl_pct > 0')} * 1e2 / nullif(count(pnl_pct), 0), 4) AS win_rate FROM {rel} t"
    return f"SELECT total, average, round(q0, 6) AS median, best, worst, win_rate FROM ({a}) a CROSS JOIN ({quantiles(d, rel, 'pnl_pct', (0.5,))}) q"


# --- sets, sorts, limits ---


@op("set_except", lambda d: "SELECT c_custkey AS k FROM customer", other=lambda d: "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'", key="k")
def set_except(d, rel, other, key):
    return f"SELECT {key} FROM {rel} t EXCEPT SELECT {key} FROM {other} o ORDER BY {key}"


@op("set_union_then_except", lambda d: "SELECT CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE 'de' END AS locale, concat('k', CAST(n_nationkey % 10 AS STRING)) AS k FROM nation", locale="en", locale_column="locale", key="k")
def set_union_then_except(d, rel, locale, locale_column, key):
    """Keys of all other locales that one locale lacks."""
    return f"SELECT {key} FROM {rel} t WHERE {locale_column} <> {d.lit(locale)} EXCEPT SELECT {key} FROM {rel} u WHERE {locale_column} = {d.lit(locale)} ORDER BY {key}"


@op("set_dedup_key", "lineitem", keys=("l_partkey", "l_returnflag"), order=("l_shipdate", "l_orderkey", "l_linenumber"))
def set_dedup_key(d, rel, keys, order):
    """The first row of each key, all columns."""
    return f"SELECT {d.but('rn')} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS rn FROM {rel} t) x WHERE rn = 1"


URL = r"https?://[^\s\"'<>)]+"


@op("set_distinct_urls", "pages", column="html")
def set_distinct_urls(d, rel, column):
    found = d.extract_all(column, URL)
    return f"SELECT page_id, {d.size(found)} AS url_count, {d.size(d.distinct(found))} AS unique_urls FROM {rel} t"


@op("sort_multi_key", fx.prices)
def sort_multi_key(d, rel):
    return f"SELECT date, ticker, close FROM {rel} t ORDER BY date, ticker"


@op("limit_last_n", fx.daily, n=30)
def limit_last_n(d, rel, n):
    return f"SELECT date, value FROM {rel} t ORDER BY date DESC LIMIT {n}"


@op("topk_threshold", "documents", least=5000, n=40)
def topk_threshold(d, rel, least, n):
    return f"SELECT doc_id, n_chars FROM {rel} t WHERE n_chars >= {least} ORDER BY n_chars DESC, doc_id LIMIT {n}"


# --- scan-like queries that SQL can state ---


@op("catalog_preview", "customer", n=20, order="c_custkey")
def catalog_preview(d, rel, n, order):
    return f"SELECT * FROM {rel} t ORDER BY {order} LIMIT {n}"


@op("scan_nav_wide", fx.nav, funds=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
def scan_nav_wide(d, rel, funds):
    """Wide values with blanks, read back to typed long rows."""
    wide = "SELECT date, " + ", ".join(f"max(CASE WHEN fund = '{f}' THEN CAST(nav AS VARCHAR(40)) END) AS f{i}" for i, f in enumerate(funds)) + f" FROM {rel} t GROUP BY date"
    long = d.long("date", "w", [{"fund": f"'{f}'", "nav": f"try_cast(f{i} AS DOUBLE)"} for i, f in enumerate(funds)])
    return f"WITH w AS ({wide}) {long}"


@op("agg_vote_majority", lambda d: "SELECT concat(CASE p_size % 6 WHEN 0 THEN 'docs/' WHEN 1 THEN 'tests/' WHEN 2 THEN '.github/workflows/' ELSE 'src/' END, p_name, CASE p_partkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.yml' ELSE '.py' END) AS path, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS status, CAST(p_size AS BIGINT) AS added, CAST(p_partkey % 50 AS BIGINT) AS deleted, p_brand AS change_set FROM part")
def agg_vote_majority(d, rel):
    """Commit type of each change set by vote of its files."""
    kind = f"CASE WHEN {d.like('path', '(?i)test')} THEN 'test' WHEN {d.like('path', r'(?i)([.]md$|docs/)')} THEN 'docs' WHEN {d.like('path', r'(?i)[.]github/')} THEN 'ci' WHEN status = 'A' THEN 'feat' WHEN status IN ('D', 'R') THEN 'refactor' WHEN added > 0 AND deleted = 0 THEN 'feat' WHEN deleted > added * 2 THEN 'refactor' END"
    return f"""WITH v AS (SELECT change_set, {kind} AS kind, status, added, deleted FROM {rel} t), c AS (SELECT change_set, kind, count(*) AS n FROM v WHERE kind IS NOT NULL GROUP BY change_set, kind),
      r AS (SELECT change_set, kind, n, row_number() OVER (PARTITION BY change_set ORDER BY n DESC, kind) AS rn, CAST(sum(n) OVER (PARTITION BY change_set) AS DOUBLE) AS total FROM c),
      s AS (SELECT change_set, {C('sum(added)')} AS a, {C('sum(deleted)')} AS d, CAST(avg(CASE WHEN status = 'A' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS fresh FROM v GROUP BY change_set)
      SELECT s.change_set, CASE WHEN r.kind IS NULL THEN CASE WHEN a > d * 2 THEN 'feat' WHEN d > a * 2 THEN 'refactor' ELSE 'chore' END WHEN r.n > r.total * 0.6 THEN r.kind WHEN a > 0 AND d = 0 THEN 'feat' WHEN d > a * 2 THEN 'refactor' WHEN fresh > 0.5 THEN 'feat' ELSE r.kind END AS commit_type
      FROM s LEFT JOIN r ON s.change_set = r.change_set AND r.rn = 1"""
