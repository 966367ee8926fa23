"""Funds, backtests, event studies, valuation, statements and subscription metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans import fixtures as fx
from ..plans.blocks import meet, positions, scan
from ..plans.dialect import DUCK, Registry, on_tables
from ..session import cut
from .relational import C, ones

R = Registry()
op = R.op


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


# --- funds ---


def fund_sql(rel, per_year=252, rf=0.02):
    """Per fund; the span in periods is the distance in rows, gaps included."""
    rows = f"SELECT fund, date, nav, dense_rank() OVER (ORDER BY date) AS i, nav / nullif(lag(nav) OVER (PARTITION BY fund ORDER BY date), 0) - 1 AS r, max(nav) OVER (PARTITION BY fund ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {rel} t WHERE nav > 0"
    a = f"SELECT fund, pow(max_by(nav, i) / min_by(nav, i), {per_year:e} / (max(i) - min(i))) - 1 AS ann_return, stddev_samp(r) * sqrt({per_year:e}) AS ann_vol, max((peak - nav) / peak) AS max_drawdown, count(*) AS n FROM ({rows}) r GROUP BY fund"
    return f"SELECT *, (ann_return - {rf:e}) / nullif(ann_vol, 0) AS sharpe FROM ({a}) a"


@op("fund_ann_return", fx.nav, per_year=12)
def fund_ann_return(d, rel, per_year):
    return f"SELECT fund, round(ann_return, 6) AS ann_return FROM ({fund_sql(rel, per_year)}) f"


@op("fund_ann_vol", fx.nav, per_year=12)
def fund_ann_vol(d, rel, per_year):
    return f"SELECT fund, round(ann_vol, 6) AS ann_vol FROM ({fund_sql(rel, per_year)}) f"


@op("fund_sharpe", fx.nav, per_year=12, rf=0.02)
def fund_sharpe(d, rel, per_year, rf):
    return f"SELECT fund, round(sharpe, 6) AS sharpe FROM ({fund_sql(rel, per_year, rf)}) f"


@op("fund_metrics_all", fx.nav, per_year=12, rf=0.02)
def fund_metrics_all(d, rel, per_year, rf):
    return f"SELECT fund, n, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM ({fund_sql(rel, per_year, rf)}) f"


# --- backtests: curves and lots ---


@op("bt_annual_factor", fx.daily)
def bt_annual_factor(d, rel):
    gap = "datediff(CAST(date AS DATE), CAST(before AS DATE))" if d.spark else "date_diff('day', CAST(before AS DATE), CAST(date AS DATE))"
    g = f"SELECT median({gap}) AS gap FROM (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM {rel} t) x WHERE before IS NOT NULL"
    return f"SELECT CAST(CASE WHEN gap <= 2 THEN 252 WHEN gap <= 10 THEN 52 WHEN gap <= 40 THEN 12 WHEN gap <= 120 THEN 4 ELSE 1 END AS BIGINT) AS factor FROM ({g}) g"


@op("bt_window_summary", fx.daily, factor=252)
def bt_window_summary(d, rel, factor):
    """Percent; a curve that ends at zero or below has lost all."""
    s = f"SELECT date, value, value / nullif(lag(value) OVER (ORDER BY date), 0) - 1 AS r, max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {rel} t"
    a = f"SELECT min_by(value, date) AS v0, max_by(value, date) AS v1, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, min(CASE WHEN peak > 0 THEN value / peak - 1 ELSE 0 END) AS dd FROM ({s}) s"
    return f"""SELECT round((v1 / v0 - 1) * 100, 4) AS total, round(CASE WHEN v1 <= 0 THEN -100 ELSE (pow(v1 / v0, {factor:e} / (n - 1)) - 1) * 100 END, 4) AS annual,
      round(m / nullif(sd, 0) * sqrt({factor:e}), 4) AS sharpe, round(dd * 100, 4) AS max_drawdown FROM ({a}) a"""


def lots(d) -> str:
    """Buys and sells per part, in order; returned lines are sells."""
    order = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"
    return f"SELECT l_partkey AS symbol, CAST(row_number() OVER (PARTITION BY l_partkey {order}) AS BIGINT) AS seq, {d.day('l_shipdate')} AS date, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS size, CAST(round(l_extendedprice * 100) AS BIGINT) / (1e2 * l_quantity) AS price FROM {d.dealt('lineitem', 'l_partkey')}"


def last_known(d, x: str, over: str) -> str:
    """The last value that is not null of the rows up to this one."""
    return f"last_value({x}, true) OVER ({over} ROWS UNBOUNDED PRECEDING)" if d.spark else f"last_value({x} IGNORE NULLS) OVER ({over} ROWS UNBOUNDED PRECEDING)"


def sorted_by(d, t_plus_1):
    """What trades are in order by after the first window over them: Spark sorts anew for another name of the same order, so it keeps ``seq`` but for T+1, whose order is longer."""
    return "seq" if d.spark and not t_plus_1 else "nth"


def filled_sql(d, rel, t_plus_1=False, opens="buy"):
    """Trades in the order they act in, with the size that holdings allow: ``opens`` is the side that opens lots.

    Holdings are the running sum of sizes, reflected at zero: what the sum's
    running minimum falls by is the size that could not be closed.  With T+1 the
    closing trades of a bar act before its opening ones, as those lots are closed
    to them.
    """
    opening, by = f"CASE WHEN side = '{opens}' THEN 1 ELSE 0 END", sorted_by(d, t_plus_1)
    order = f"date, {opening}, seq" if t_plus_1 else "seq"
    run = f"SELECT symbol, seq, date, {opening} AS opening, size, price, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS nth, {C(f"sum(CASE WHEN side = '{opens}' THEN size ELSE -size END) OVER (PARTITION BY symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING)")} AS net FROM {rel} t WHERE size > 0 AND side IN ('buy', 'sell')"
    low = f"SELECT r.*, least(0, min(net) OVER (PARTITION BY symbol ORDER BY {by} ROWS UNBOUNDED PRECEDING)) AS low FROM ({run}) r"
    return f"SELECT l.*, {C(f'size - (coalesce(lag(low) OVER (PARTITION BY symbol ORDER BY {by}), 0) - low)')} AS filled FROM ({low}) l"


def segments_sql(d, rel, t_plus_1=False, opens="buy"):
    """Opened and closed sizes laid end to end and cut at all their ends: each piece is of one lot, and of one sale or still open.

    On Spark each side's running sum goes over the trades of both as they are
    sorted already, and the size of a piece looks the same way as what it is of.
    """
    run = lambda side: f"sum(CASE WHEN opening = {side} THEN filled ELSE 0 END) OVER (PARTITION BY symbol ORDER BY {sorted_by(d, t_plus_1)} ROWS UNBOUNDED PRECEDING)"
    upto = f"CASE WHEN opening = 1 THEN {run(1)} ELSE {run(0)} END" if d.spark else "sum(filled) OVER (PARTITION BY symbol, opening ORDER BY nth ROWS UNBOUNDED PRECEDING)"
    ends = f"SELECT f.*, {C(upto)} AS upto FROM ({filled_sql(d, d.dealt(rel, 'symbol'), t_plus_1, opens)}) f WHERE filled > 0"
    picked = ", ".join(f"max(CASE WHEN opening = {side} THEN {x} END) AS {name}" for side, x, name in ((1, "seq", "lot"), (1, "price", "entry_price"), (1, "date", "entry_date"), (0, "seq", "sale"), (0, "price", "exit_price"), (0, "date", "exit_date")))
    bounds = f"SELECT symbol, upto, {picked} FROM ({ends}) e GROUP BY symbol, upto"
    back = "PARTITION BY symbol ORDER BY upto DESC"
    known = ", ".join(f"{last_known(d, x, back)} AS {x}" for x in ("lot", "entry_price", "entry_date", "sale", "exit_price", "exit_date"))
    before = f"lead(upto) OVER ({back})" if d.spark else "lag(upto) OVER (PARTITION BY symbol ORDER BY upto)"
    return f"SELECT symbol, upto, {C(f'upto - coalesce({before}, 0)')} AS size, {known} FROM ({bounds}) b"


def fifo_sql(d, rel, t_plus_1=False, opens="buy"):
    """Closed pieces of lots, first in, first out."""
    return f"SELECT * FROM ({segments_sql(d, rel, t_plus_1, opens)}) g WHERE sale IS NOT NULL"


def unfilled_sql(d, rel, t_plus_1=False, opens="buy"):
    """What closing trades asked for beyond what was held when they acted."""
    return f"SELECT symbol, seq AS sale, size - filled AS size FROM ({filled_sql(d, rel, t_plus_1, opens)}) f WHERE filled < size"


def walk_sql(rel, opens="buy"):
    """The oracle's form: each symbol's trades one after the other, with the list of open lots. (symbol, seq, side, size, price, took), ``took`` the pieces closed."""
    taken = "greatest(0, least(x.size, t.size - CAST(coalesce(list_sum(list_transform(r.held[1:i - 1], lambda y: y.size)), 0) AS BIGINT)))"
    pieces = "list_transform(r.held, lambda x, i: {'lot': x.lot, 'price': x.price, 'size': " + taken + "})"
    rest = "list_filter(list_transform(r.held, lambda x, i: {'lot': x.lot, 'price': x.price, 'size': x.size - " + taken + "}), lambda z: z.size > 0)"
    kind = "STRUCT(lot BIGINT, price DOUBLE, size BIGINT)[]"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS nth FROM {rel} q), r AS (
      SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS seq, '' AS side, CAST(0 AS BIGINT) AS size, 0e0 AS price, CAST([] AS {kind}) AS held, CAST([] AS {kind}) AS took FROM t UNION ALL
      SELECT t.symbol, t.nth, t.seq, t.side, t.size, t.price, CAST(CASE WHEN t.side = '{opens}' THEN list_append(r.held, {{'lot': t.seq, 'price': t.price, 'size': t.size}}) ELSE {rest} END AS {kind}),
      CAST(CASE WHEN t.side = '{opens}' THEN [] ELSE list_filter({pieces}, lambda z: z.size > 0) END AS {kind}) FROM r JOIN t ON t.symbol = r.symbol AND t.nth = r.nth + 1)"""


def _walk_pieces(opens: str) -> str:
    """Pieces (symbol, lot, sale, entry_price, exit_price, size) as the oracle walks them."""
    return f"{walk_sql('(' + lots(DUCK) + ')', opens)}, p AS (SELECT symbol, k.lot AS lot, seq AS sale, k.price AS entry_price, price AS exit_price, k.size AS size FROM (SELECT symbol, seq, price, unnest(took) AS k FROM r WHERE side <> '{opens}') z), u AS (SELECT symbol, seq AS sale, size - CAST(coalesce(list_sum(list_transform(took, lambda y: y.size)), 0) AS BIGINT) AS size FROM r WHERE nth > 0 AND side <> '{opens}')"


@op("bt_close_fifo", lots, t_plus_1=False)
def bt_close_fifo(d, rel, t_plus_1):
    """First in, first out, of the lots bought before a sale (with T+1: on an earlier bar); ``bt_unfilled`` has what exceeds them."""
    return f"SELECT symbol, lot, sale, size, round((exit_price - entry_price) * size, 7) AS pnl FROM ({fifo_sql(d, rel, t_plus_1)}) f"


@op("bt_cover_fifo", lots, t_plus_1=False)
def bt_cover_fifo(d, rel, t_plus_1):
    """The same with sides swapped: sells open, buys cover."""
    return f"SELECT symbol, lot, sale, size, round((entry_price - exit_price) * size, 7) AS pnl FROM ({fifo_sql(d, rel, t_plus_1, 'sell')}) f"


@op("bt_unfilled", lots, t_plus_1=False, opens="buy")
def bt_unfilled(d, rel, t_plus_1, opens):
    """Sales, or with ``opens`` 'sell' covers, and the size for which there was no lot."""
    return f"SELECT symbol, sale, size FROM ({unfilled_sql(d, d.dealt(rel, 'symbol'), t_plus_1, opens)}) u"


@op("bt_open_lots", lots, t_plus_1=False)
def bt_open_lots(d, rel, t_plus_1):
    """What is left of each lot in the end."""
    return f"SELECT symbol, lot, entry_price, {C('sum(size)')} AS size FROM ({segments_sql(d, rel, t_plus_1)}) g WHERE sale IS NULL GROUP BY symbol, lot, entry_price"


def close_lot_sql(pieces, fee):
    return f"SELECT symbol, lot, sale, (cost + got) * {fee:e} AS fees, got - cost - (cost + got) * {fee:e} AS pnl, (got - cost - (cost + got) * {fee:e}) / (cost * (1 + {fee:e})) * 100 AS pnl_pct FROM ({pieces}) q"


def cover_short_sql(pieces, fee):
    return f"SELECT symbol, lot, sale, (cost + got) * {fee:e} AS fees, got - cost - (cost + got) * {fee:e} AS pnl FROM ({pieces}) q"


@op("bt_close_lot", lots, fee=0.001, t_plus_1=False)
def bt_close_lot(d, rel, fee, t_plus_1):
    """Fees by size; profit in percent of the cost with its entry fee."""
    return close_lot_sql(f"SELECT symbol, lot, sale, size, entry_price * size AS cost, exit_price * size AS got FROM ({fifo_sql(d, rel, t_plus_1)}) f", fee)


@op("bt_cover_short", lots, fee=0.001, t_plus_1=False)
def bt_cover_short(d, rel, fee, t_plus_1):
    return cover_short_sql(f"SELECT symbol, lot, sale, size, entry_price * size AS got, exit_price * size AS cost FROM ({fifo_sql(d, rel, t_plus_1, 'sell')}) f", fee)


R.sql["bt_close_fifo"] = f"{_walk_pieces('buy')} SELECT symbol, lot, sale, size, round((exit_price - entry_price) * size, 7) AS pnl FROM p"
R.sql["bt_cover_fifo"] = f"{_walk_pieces('sell')} SELECT symbol, lot, sale, size, round((entry_price - exit_price) * size, 7) AS pnl FROM p"
R.sql["bt_unfilled"] = f"{_walk_pieces('buy')} SELECT symbol, sale, size FROM u WHERE size > 0"
R.sql["bt_open_lots"] = f"{_walk_pieces('buy')} SELECT symbol, k.lot AS lot, k.price AS entry_price, k.size AS size FROM (SELECT symbol, unnest(max_by(held, nth)) AS k FROM r GROUP BY symbol) z"
R.sql["bt_close_lot"] = f"{_walk_pieces('buy')} {close_lot_sql('SELECT symbol, lot, sale, size, entry_price * size AS cost, exit_price * size AS got FROM p', 0.001)}"
R.sql["bt_cover_short"] = f"{_walk_pieces('sell')} {cover_short_sql('SELECT symbol, lot, sale, size, entry_price * size AS got, exit_price * size AS cost FROM p', 0.001)}"


@op("bt_buy_lot", lots, fee=0.001)
def bt_buy_lot(d, rel, fee):
    return f"SELECT symbol, seq AS lot, date AS entry_date, size, round(price * size, 7) AS entry_notional, round(price * size * {fee:e}, 7) AS entry_fee, round(price * size * (1 + {fee:e}), 7) AS cash_out FROM {rel} t WHERE side = 'buy'"


@op("bt_short_lot", lots, fee=0.001)
def bt_short_lot(d, rel, fee):
    return f"SELECT symbol, seq AS lot, date AS entry_date, -size AS size, round(price * size, 7) AS liability, round(price * size * (1 - {fee:e}), 7) AS cash_in FROM {rel} t WHERE side = 'sell'"


@op("bt_buy_margin", lots, fee=0.001, margin=0.5)
def bt_buy_margin(d, rel, fee, margin):
    return f"SELECT symbol, seq AS lot, size, round(price * size * {margin:e}, 7) AS own_cash, round(price * size * (1 - {margin:e}), 7) AS borrowed, round(price * size * {fee:e}, 7) AS fee FROM {rel} t WHERE side = 'buy'"


@op("bt_equity", lots, cash=1_000_000)
def bt_equity(d, rel, cash):
    """Cash plus holdings at the last price, short ones negative."""
    p = f"SELECT symbol, max_by(price, seq) AS last, {C(f'sum(CASE WHEN side = {d.lit("buy")} THEN size ELSE -size END)')} AS held, sum(CASE WHEN side = 'buy' THEN -price * size ELSE price * size END) AS flow FROM {rel} t GROUP BY symbol"
    return f"SELECT round({cash:e} + sum(flow) + sum(held * last), 2) AS equity, {ones('held < 0')} AS short_symbols FROM ({p}) p"


@op("bt_margin", lots, maintenance=0.25)
def bt_margin(d, rel, maintenance):
    return f"SELECT symbol, round(sum(price * size) * {maintenance:e}, 7) AS required, round(sum(price * size) * (5e-1 - {maintenance:e}), 7) AS excess FROM {rel} t WHERE side = 'buy' GROUP BY symbol"


@op("bt_interest", lots, rate=0.08, days=30, year=365)
def bt_interest(d, rel, rate, days, year):
    return f"SELECT symbol, seq, round(price * size * 5e-1 * {rate:e} * {days} / {year}e0, 6) AS interest FROM {rel} t WHERE side = 'buy'"


@op("bt_validate", lots)
def bt_validate(d, rel):
    """Rules broken: holdings left at the end, and more sold than was held."""
    n = "CASE WHEN side = 'buy' THEN size ELSE -size END"
    run = f"SELECT symbol, seq, sum({n}) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS held FROM {rel} t"
    return f"SELECT 'not flat at end' AS rule, count(*) AS n FROM (SELECT symbol FROM {rel} t GROUP BY symbol HAVING sum({n}) <> 0) a UNION ALL SELECT 'long only', count(*) FROM ({run}) r WHERE held < 0 UNION ALL SELECT 'size', count(*) FROM {rel} u WHERE size <= 0"


def trade_records(d) -> str:
    """Closed pieces as trade records; some are planted with faults that the rules are there for."""
    q = f"SELECT symbol, lot, sale, entry_date, exit_date, size, entry_price, exit_price, entry_price * size AS entry_notional, (exit_price - entry_price) * size AS pnl FROM ({fifo_sql(d, '(' + lots(d) + ')')}) f"
    return f"""SELECT symbol, CASE WHEN lot % 37 = 0 THEN ' ' ELSE CAST(lot AS VARCHAR(20)) END AS lot_id, CASE WHEN sale % 43 = 0 THEN 'Short' ELSE 'long' END AS side, entry_date, CASE WHEN sale % 29 = 0 THEN NULL ELSE exit_date END AS exit_date,
      size, entry_price, pnl, pnl / entry_notional * 100 + CASE WHEN sale % 31 = 0 THEN 1 ELSE 0 END AS pnl_pct, CASE WHEN lot % 2 = 0 THEN entry_notional END AS entry_notional, CAST(NULL AS DOUBLE) AS entry_fee, CAST(NULL AS DOUBLE) AS pnl_pct_basis FROM ({q}) q"""


@op("bt_validate_trades", trade_records, equity=fx.daily, base=1_000_000, market="china_a", accounting="lot_level", flat=True, tolerance=0.05)
def bt_validate_trades(d, rel, equity, base, market, accounting, flat, tolerance):
    """How many records break each rule of an export: (rule, n).

    Flat at the end (said by the caller), closed trades alone, no shorts where the
    market has none, lot ids where lots are accounted for and none where costs are
    averaged, a profit in percent of the cost with its fee, and no equity that
    moves without trades.
    """
    long_only = market.lower() in ("china_a", "cn", "cn-stock")
    named = "trim(coalesce(lot_id, '')) <> ''"
    basis = "coalesce(pnl_pct_basis, coalesce(entry_notional, abs(size * entry_price)) + coalesce(entry_fee, 0))"
    rules = {
        "flat at end": "0" if flat else "1",
        "closed trades": ones("trim(coalesce(exit_date, '')) = ''"),
        "long only": ones("lower(coalesce(side, 'long')) = 'short'") if long_only else "CAST(0 AS BIGINT)",
        "lot ids": ones(f"NOT ({named})") if accounting == "lot_level" else ones(named),
        "pnl_pct": ones(f"{basis} > 0 AND abs(pnl / ({basis}) * 100 - pnl_pct) > {tolerance:e}"),
        "equity without trades": "",
    }
    moved = f"SELECT CASE WHEN count(CASE WHEN abs(value - {base:e}) > 1e-9 THEN 1 END) > 0 THEN 1 ELSE 0 END AS moved FROM {equity} e"
    one = ", ".join(f"{C(x)} AS r{i}" for i, x in enumerate(rules.values()) if i < len(rules) - 1)
    a = f"SELECT {one}, count(*) AS n FROM {rel} t"
    rows = d.long("", "m", [{"rule": f"'{k}'", "n": f"r{i}" if i < len(rules) - 1 else C("CASE WHEN n = 0 THEN moved ELSE 0 END")} for i, k in enumerate(rules)])
    return f"WITH m AS (SELECT a.*, e.moved FROM ({a}) a CROSS JOIN ({moved}) e) {rows}"


@op("bt_win_rate", trade_records)
def bt_win_rate(d, rel):
    """Trades of a window and the share of those with a profit, in percent; 0 without trades."""
    return f"SELECT count(*) AS total_trades, round(coalesce({ones('pnl > 0')} * 1e2 / nullif(count(*), 0), 0e0), 4) AS win_rate_pct FROM {rel} t"


def average_cost(trades: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Average-cost position per symbol; a position of zero starts anew.

    A symbol of at most a block of trades is walked as one array of them; the
    trades of the others are scanned block by block.  ``counted`` may be the
    same trades where they are cheaper to count.
    """
    acts, columns = "size > 0 AND side IN ('buy', 'sell')", ["symbol", "seq", "side", "size", "price"]
    t = trades.where(acts).select(*columns)
    sizes = (trades if counted is None else counted).where(acts).groupBy("symbol").count()
    long = sizes.where(F.col("count") > blocks.ROWS).select("symbol")
    if long.isEmpty():
        return walked_cost(t)
    long = F.broadcast(cut(long).withColumnRenamed("symbol", "_long"))
    same = F.col("symbol").eqNullSafe(F.col("_long"))
    return walked_cost(t.join(long, same, "left_anti")).unionByName(scanned_cost(t.join(long, same, "left_semi")))


def walked_cost(t: DataFrame) -> DataFrame:
    """Average cost of symbols whose trades fit one array each."""
    sold = "least(s.held, x.size)"
    after = f"""CASE WHEN x.side = 'buy' THEN struct(s.held + x.size AS held, s.cost + x.price * x.size AS cost, s.pnl AS pnl)
      WHEN s.held > 0 THEN struct(s.held - {sold} AS held, CASE WHEN s.held <= x.size THEN 0D ELSE s.cost - s.cost / s.held * {sold} END AS cost, s.pnl + (x.price - s.cost / s.held) * {sold} AS pnl) ELSE s END"""
    trade = "struct(seq, side, CAST(size AS DOUBLE) AS size, coalesce(CAST(price AS DOUBLE), double('NaN')) AS price)"
    walk = f"aggregate(sort_array(collect_list({trade})), struct(0D AS held, 0D AS cost, 0D AS pnl), (s, x) -> {after})"
    told = t.groupBy("symbol").agg(F.expr(walk).alias("s"))
    return told.selectExpr("symbol", *(f"nullif(s.{c}, double('NaN')) AS {c}" for c in ("held", "cost", "pnl")))


def scanned_cost(trades: DataFrame) -> DataFrame:
    """Average cost of symbols of any number of trades.

    Sizes held follow from sums and running minima over blocks of a symbol's
    trades; given them, cost and profit are a recurrence, scanned block by block.
    """
    t = positions(trades, ["seq"], ["symbol"])
    t = t.withColumn("_x", F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")))
    inside = Window.partitionBy("symbol", "_block").orderBy("_pos")
    t = t.withColumn("_net", F.sum("_x").over(inside))
    ends = t.groupBy("symbol", "_block").agg(F.sum("_x").alias("sum"), F.min("_net").alias("low"))
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    ends = ends.select("symbol", "_block", "base", F.least(F.lit(0), F.min(F.col("base") + F.col("low")).over(earlier)).alias("low"))
    t = meet(t, ends, ["symbol", "_block"])
    lowest = F.least("low", F.col("base") + F.min("_net").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("_held", (F.col("base") + F.col("_net") - F.col("_x") - lowest).cast("double"))

    def maps(p: pd.DataFrame) -> np.ndarray:
        held, size, price, buy = p["_held"].to_numpy(float), p["size"].to_numpy(float), p["price"].to_numpy(float), (p["side"] == "buy").to_numpy(bool)
        sold = np.where(buy, 0.0, np.minimum(held, size))
        share = sold / np.where(held > 0, held, 1.0)
        m = np.zeros((len(p), 3, 3))
        m[:, 0, 0], m[:, 0, 2] = 1 - share, np.where(buy, price * size, 0.0)
        m[:, 1, 0], m[:, 1, 1], m[:, 1, 2] = -share, 1.0, price * sold
        m[:, 2, 2] = 1.0
        return m

    def out(p: pd.DataFrame, after: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        held, size = p["_held"].to_numpy(float), p["size"].to_numpy(float)
        return pd.DataFrame({"symbol": p["symbol"], "pos": p["_pos"], "held": np.where(p["side"] == "buy", held + size, np.maximum(0.0, held - size)), "cost": after[:, 0], "pnl": after[:, 1]})

    kind = t.schema["symbol"].dataType.simpleString()
    told = scan(t, ["symbol"], 2, maps, out, f"symbol {kind}, pos long, held double, cost double, pnl double")
    return told.groupBy("symbol").agg(*[F.max_by(c, "pos").alias(c) for c in ("held", "cost", "pnl")])


@R.query(
    "bt_avg_cost",
    "WITH RECURSIVE t AS MATERIALIZED (" + lots(DUCK) + """), r AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0e0 AS held, 0e0 AS cost, 0e0 AS pnl FROM (SELECT DISTINCT symbol FROM t) s UNION ALL
    SELECT t.symbol, t.seq, CASE WHEN side = 'buy' THEN held + size ELSE held - least(held, size) END, CASE WHEN side = 'buy' THEN cost + price * size WHEN held - least(held, size) = 0 THEN 0 ELSE cost - cost / held * least(held, size) END,
    CASE WHEN side = 'sell' AND held > 0 THEN pnl + (price - cost / held) * least(held, size) ELSE pnl END FROM r JOIN t ON t.symbol = r.symbol AND t.seq = r.seq + 1)
    SELECT symbol, max_by(held, seq) AS held, round(max_by(cost, seq), 2) AS cost, round(max_by(pnl, seq), 2) AS pnl FROM r GROUP BY symbol""",
    on=average_cost,
)
def bt_avg_cost(spark, sf_dir):
    from ..plans.dialect import SPARK

    return average_cost(on_tables(spark, sf_dir, lots), on_tables(spark, sf_dir, lots(SPARK))).selectExpr("symbol", "held", "round(cost, 2) AS cost", "round(pnl, 2) AS pnl")


# --- event study ---

PRE = "1996-06"


def caps_sql(rel):
    return f"SELECT date, ticker, close, close * shares AS cap FROM {rel} t"


@op("ev_market_cap", fx.prices)
def ev_market_cap(d, rel):
    return f"SELECT date, ticker, round(cap / 1e8, 4) AS cap FROM ({caps_sql(rel)}) c"


@op("ev_weights", fx.prices, pre=PRE)
def ev_weights(d, rel, pre):
    """By cap on the date before the event, and equal weights beside."""
    return f"SELECT ticker, round(cap / sum(cap) OVER (), 8) AS weight, round(1e0 / count(*) OVER (), 8) AS equal_weight FROM ({caps_sql(rel)}) c WHERE date = '{pre}'"


@op("ev_nav", fx.prices, pre=PRE)
def ev_nav(d, rel, pre):
    from .series import win_nav_compound

    return win_nav_compound(d, rel, pre)


@op("ev_constituent_stats", fx.prices, pre=PRE, event="1996-07")
def ev_constituent_stats(d, rel, pre, event):
    q = f"SELECT ticker, max(CASE WHEN date = '{pre}' THEN close END) AS p0, max(CASE WHEN date = '{event}' THEN close END) AS p1, max(CASE WHEN date >= '{event}' THEN close END) AS peak, max_by(close, date) AS last FROM {rel} t GROUP BY ticker"
    return f"SELECT ticker, round((p1 / p0 - 1) * 100, 4) AS event_day, round((peak / p0 - 1) * 100, 4) AS peak_change, round((last / p0 - 1) * 100, 4) AS latest_change FROM ({q}) q"


@op("ev_summary", fx.prices, pre=PRE)
def ev_summary(d, rel, pre):
    total = f"SELECT date, sum(cap) AS cap, sum(cap * cap) / (sum(cap) * sum(cap)) AS hhi, max(cap) / sum(cap) AS top FROM ({caps_sql(rel)}) c GROUP BY date"
    return f"SELECT round(p.cap / 1e8, 4) AS pre_cap, round(m.peak / 1e8, 4) AS peak_cap, round((m.peak / p.cap - 1) * 100, 4) AS to_peak, round((m.last / p.cap - 1) * 100, 4) AS to_latest, round(p.hhi, 6) AS hhi, round(p.top, 6) AS top_weight FROM ({total}) p CROSS JOIN (SELECT max(cap) AS peak, max_by(cap, date) AS last FROM ({total}) t WHERE date >= '{pre}') m WHERE p.date = '{pre}'"


@op("ev_validate", fx.prices, pre=PRE)
def ev_validate(d, rel, pre):
    w = f"SELECT ticker, cap / sum(cap) OVER () AS weight FROM ({caps_sql(rel)}) c WHERE date = '{pre}'"
    return f"SELECT 'weights sum to 100' AS rule, abs(sum(weight) * 100 - 100) <= 1e-1 AS passed FROM ({w}) a UNION ALL SELECT 'no weight above 30', max(weight) <= 3e-1 FROM ({w}) b UNION ALL SELECT 'positive closes', min(close) > 0 FROM {rel} t UNION ALL SELECT 'hash', {d.sha256(d.lit('abc'))} = 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad'"


# --- valuation ---


def dcf_sql(d, fcf, g, r, tg, years):
    y = d.unnest(d.seq("1", str(years)))
    return f"SELECT y, {fcf} * pow(1 + {g}, y) AS f, {fcf} * pow(1 + {g}, y) / pow(1 + {r}, y) AS pv FROM (SELECT {y} AS y) s"


@op("val_dcf", "supplier", company="s_suppkey", flow="s_acctbal", growth=0.06, rate=0.1, terminal=0.025, years=10)
def val_dcf(d, rel, company, flow, growth, rate, terminal, years):
    """Value of each company from its base flow; an error where the rate does not exceed the terminal growth."""
    if rate <= terminal:
        raise ValueError("the discount rate must exceed terminal growth")
    f = f"SELECT {company}, y, {flow} * pow(1 + {growth:e}, y) AS f FROM {rel} t CROSS JOIN (SELECT {d.unnest(d.seq('1', str(years)))} AS y) s"
    return f"SELECT {company}, round(sum(f / pow(1 + {rate:e}, y)), 2) AS pv_flows, round(max(CASE WHEN y = {years} THEN f END) * (1 + {terminal:e}) / ({rate - terminal:e}) / pow(1 + {rate:e}, {years}), 2) AS pv_terminal FROM ({f}) f GROUP BY {company}"


@op("val_sensitivity", "region", base=100.0, terminal=0.025, years=5)
def val_sensitivity(d, rel, base, terminal, years):
    grid = f"SELECT g / 1e2 AS g, r / 1e2 AS r FROM (SELECT {d.unnest(d.seq('2', '8'))} AS g) a CROSS JOIN (SELECT {d.unnest(d.seq('2', '12'))} AS r) b"
    flows = " + ".join(f"{base:e} * pow(1 + g, {y}) / pow(1 + r, {y})" for y in range(1, years + 1))
    return f"SELECT g, r, CASE WHEN r > {terminal:e} THEN round({flows} + {base:e} * pow(1 + g, {years}) * (1 + {terminal:e}) / nullif(r - {terminal:e}, 0) / pow(1 + r, {years}), 4) END AS value FROM ({grid}) q"


@op("val_equity", lambda d: "SELECT s_suppkey AS company, s_acctbal * 12 AS enterprise, s_acctbal / 4 AS net_debt, 500 AS cash, 100 + s_suppkey AS shares FROM supplier")
def val_equity(d, rel):
    """Enterprise value less net debt, plus cash; and per share, null without shares."""
    e = "(enterprise - net_debt + cash)"
    return f"SELECT company, round({e}, 4) AS equity, round({e} / nullif(shares, 0), 6) AS per_share FROM {rel} t"


# --- statements ---


def statements(d) -> str:
    """Per company and quarter, from sums of its orders."""
    cents = lambda c: f"CAST(sum(CAST(round(CASE WHEN {c} THEN o_totalprice ELSE 0 END * 100) AS BIGINT)) AS DOUBLE) / 1e2"
    q = f"SELECT o_orderpriority AS company, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, {cents('true')} AS revenue, {cents("o_orderstatus = " + d.lit("F"))} AS f, {cents('o_orderstatus = ' + d.lit('O'))} AS o, {cents('o_orderstatus = ' + d.lit('P'))} AS p FROM orders GROUP BY 1, 2, 3"
    return f"""SELECT company, year, quarter, revenue, revenue * CASE WHEN quarter % 2 = 1 THEN 6e-1 ELSE 65e-2 END AS cost_of_revenue, revenue * 2e-1 - p AS operating_income, revenue * 1e-1 - p AS net_income, o * 8e-1 AS accounts_receivable, f * 3e-1 AS inventory,
      f + o AS current_assets, o * 15e-1 AS current_liabilities, revenue * 3 AS total_assets, revenue * 2 + p AS total_liabilities, revenue - p AS equity, p * 4 AS goodwill, f * 2e-1 AS accounts_payable, f - p * 9 AS operating_cash_flow, revenue * 5e-2 AS capex, revenue * 2e-2 AS interest, revenue * 3e-2 AS tax, revenue * 4e-2 AS depreciation, f * 1e-1 AS cash FROM ({q}) q"""


def growth(new, old):
    """(new - old) / |old|; 0 from 0 to 0, NULL from 0 to something."""
    return f"CASE WHEN {old} = 0 AND {new} = 0 THEN 0e0 WHEN {old} <> 0 THEN ({new} - {old}) / abs({old}) END"


def yoy_sql(rel, columns):
    cols = ", ".join(f"{growth(f'a.{c}', f'b.{c}')} AS {c}_yoy, {growth(f'a.{c}', f'p.{c}')} AS {c}_qoq" for c in columns)
    return f"SELECT a.company, a.year, a.quarter, {cols} FROM {rel} a LEFT JOIN {rel} b ON a.company = b.company AND a.year = b.year + 1 AND a.quarter = b.quarter LEFT JOIN {rel} p ON a.company = p.company AND a.year * 4 + a.quarter = p.year * 4 + p.quarter + 1"


@op("fin_yoy_qoq", statements, columns=("revenue", "net_income"))
def fin_yoy_qoq(d, rel, columns):
    return "SELECT company, year, quarter, " + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in columns for k in ("yoy", "qoq")) + f" FROM ({yoy_sql(rel, columns)}) y"


RATIOS = {
    "gross_margin": div("revenue - cost_of_revenue", "revenue"), "operating_margin": div("operating_income", "revenue"), "net_margin": div("net_income", "revenue"), "debt_ratio": div("total_liabilities", "total_assets"),
    "current_ratio": div("current_assets", "current_liabilities"), "goodwill_ratio": div("goodwill", "total_assets"), "ar_to_revenue": div("accounts_receivable", "revenue"), "inventory_to_revenue": div("inventory", "revenue"),
    "ocf_to_ni": div("operating_cash_flow", "net_income"), "roe": div("net_income", "equity"), "free_cash_flow": "operating_cash_flow - capex",
    "dso": div("accounts_receivable", "revenue") + " * 90", "dio": div("inventory", "cost_of_revenue") + " * 90", "dpo": div("accounts_payable", "cost_of_revenue") + " * 90",
}


@op("fin_ratios", statements)
def fin_ratios(d, rel):
    """Day counts are per quarter."""
    return "SELECT company, year, quarter, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in RATIOS.items()) + f" FROM {rel} t"


# fixed values: limits of the ten rules
LIMITS = {"ar": "2e-1", "inventory": "15e-2", "ocf": "5e-1", "margin": "5e-2", "net_margin": "3e-2", "debt": "7e-1", "current": "1e0", "goodwill": "3e-1", "ap": "2e-1", "streak": 2}


@op("fin_anomalies", statements)
def fin_anomalies(d, rel):
    """One row for each rule that a company's quarter breaks."""
    key = "company, year, quarter"
    by = "PARTITION BY company ORDER BY year, quarter"
    y = yoy_sql(rel, ("revenue", "accounts_receivable", "inventory", "cost_of_revenue", "accounts_payable"))
    r = f"SELECT {key}, operating_cash_flow AS ocf, net_income AS ni, " + ", ".join(f"{e} AS {n}" for n, e in RATIOS.items() if n in ("gross_margin", "net_margin", "debt_ratio", "current_ratio", "goodwill_ratio")) + f" FROM {rel} t"
    m = f"SELECT *, gross_margin - lag(gross_margin) OVER ({by}) AS dg, net_margin - lag(net_margin) OVER ({by}) AS dn, row_number() OVER ({by}) - row_number() OVER (PARTITION BY company, ocf < 0 ORDER BY year, quarter) AS run FROM r"
    s = f"SELECT *, row_number() OVER (PARTITION BY company, ocf < 0, run ORDER BY year, quarter) AS nth FROM m"
    L = LIMITS  # noqa: N806
    rules = [
        ("receivables", "y", f"accounts_receivable_yoy - revenue_yoy > {L['ar']}"), ("inventory", "y", f"inventory_yoy - revenue_yoy > {L['inventory']}"), ("payables", "y", f"abs(accounts_payable_yoy - cost_of_revenue_yoy) > {L['ap']}"),
        ("cash_against_profit", "s", f"ni > 0 AND (ocf < 0 OR ocf / nullif(ni, 0) < {L['ocf']})"), ("gross_margin", "s", f"abs(dg) > {L['margin']}"), ("net_margin", "s", f"abs(dn) > {L['net_margin']}"),
        ("negative_cash_flow", "s", f"ocf < 0 AND nth >= {L['streak']}"), ("goodwill", "s", f"goodwill_ratio > {L['goodwill']}"), ("debt", "s", f"debt_ratio > {L['debt']}"), ("liquidity", "s", f"current_ratio < {L['current']}"),
    ]
    return f"WITH y AS ({y}), r AS ({r}), m AS ({m}), s AS ({s}) " + " UNION ALL ".join(f"SELECT {key}, '{n}' AS rule FROM {src} WHERE {c}" for n, src, c in rules)


INDICATORS = {
    "roe": div("net_income", "equity"), "roa": div("net_income", "total_assets"), "gross_margin": RATIOS["gross_margin"], "net_margin": RATIOS["net_margin"], "operating_margin": RATIOS["operating_margin"], "ebitda_margin": div("ebit + depreciation", "revenue"),
    "debt_to_assets": div("total_liabilities", "total_assets"), "debt_to_equity": div("total_liabilities", "equity"), "equity_multiplier": div("total_assets", "equity"), "interest_cover": div("ebit", "interest"),
    "current_ratio": RATIOS["current_ratio"], "quick_ratio": div("current_assets - inventory", "current_liabilities"), "cash_ratio": div("cash", "current_liabilities"),
    "inventory_turnover": div("cost_of_revenue", "inventory"), "receivables_turnover": div("revenue", "accounts_receivable"), "asset_turnover": div("revenue", "total_assets"),
    "working_capital_turnover": "CASE WHEN current_assets > current_liabilities THEN revenue / nullif(current_assets - current_liabilities, 0) END",
    "days_inventory": "365 / nullif(" + div("cost_of_revenue", "inventory") + ", 0)", "days_receivables": "365 / nullif(" + div("revenue", "accounts_receivable") + ", 0)",
    "eps": "net_income / 1e3", "bps": "equity / 1e3", "pe": "5e1 / nullif(net_income / 1e3, 0)", "ocf_to_liabilities": div("operating_cash_flow", "current_liabilities"), "ocf_to_income": div("operating_cash_flow", "net_income"), "free_cash_flow": RATIOS["free_cash_flow"],
}


@op("fin_indicators", statements)
def fin_indicators(d, rel):
    q = f"SELECT *, net_income + tax + interest AS ebit FROM {rel} t"
    y = yoy_sql(rel, ("revenue", "net_income"))
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in INDICATORS.items())
    return f"SELECT i.*, round(g.revenue_yoy, 6) AS revenue_growth, round(g.net_income_yoy, 6) AS income_growth FROM (SELECT company, year, quarter, {cols} FROM ({q}) q) i JOIN ({y}) g ON i.company = g.company AND i.year = g.year AND i.quarter = g.quarter"


@op("fin_dupont", statements)
def fin_dupont(d, rel):
    return f"SELECT company, year, quarter, round({div('net_income', 'revenue')}, 6) AS margin, round({div('revenue', 'total_assets')}, 6) AS turnover, round({div('total_assets', 'equity')}, 6) AS multiplier, round({div('net_income', 'revenue')} * {div('revenue', 'total_assets')} * {div('total_assets', 'equity')}, 6) AS roe, round({div('net_income', 'equity')}, 6) AS direct_roe FROM {rel} t"


# --- subscriptions ---


def saas(d) -> str:
    return """SELECT s_suppkey AS id, 10000 + abs(s_acctbal) AS mrr, 9500 + abs(s_acctbal) AS mrr_last, 103e0 + s_suppkey AS customers, s_suppkey % 7 * 1e0 AS churned, s_suppkey % 11 * 1e0 AS new_customers, 4000e0 AS sm_spend,
      7e-1 AS gross_margin, s_suppkey % 5 * 1e2 AS expansion, s_suppkey % 3 * 1e2 AS churned_mrr, s_suppkey % 2 * 1e2 AS contraction, s_suppkey % 40 * 1e0 AS profit_margin FROM supplier"""


@op("saas_metrics", saas)
def saas_metrics(d, rel):
    """Each step uses the rounded result of the one before."""
    a = f"SELECT *, round(mrr, 2) AS r_mrr, round(mrr * 12, 2) AS arr, round({div('mrr', 'customers')}, 2) AS arpa, round(({div('mrr - mrr_last', 'mrr_last')}) * 100, 2) AS growth_pct, round(({div('churned', 'customers')}) * 100, 2) AS churn_pct, round({div('sm_spend', 'new_customers')}, 2) AS cac FROM {rel} t"
    b = f"SELECT *, CASE WHEN churn_pct > 0 THEN round(arpa / nullif(churn_pct / 100, 0) * gross_margin, 2) END AS ltv, round(cac / nullif(arpa * gross_margin, 0), 1) AS payback_months, CASE WHEN expansion + churned_mrr + contraction > 0 THEN round((mrr_last + expansion - churned_mrr - contraction) / mrr_last * 100, 2) WHEN churn_pct > 0 THEN round((1 - churn_pct / 100) * 100, 2) END AS nrr_pct, CASE WHEN growth_pct <> 0 THEN round(growth_pct * 12 + profit_margin, 1) END AS rule_of_40 FROM ({a}) a"
    return f"SELECT id, r_mrr AS mrr, arr, arpa, growth_pct, churn_pct, cac, ltv, CASE WHEN cac > 0 AND ltv > 0 THEN round(ltv / nullif(cac, 0), 2) END AS ltv_cac, payback_months, nrr_pct, rule_of_40 FROM ({b}) b"


@op("saas_quick_ratio", saas)
def saas_quick_ratio(d, rel):
    q = f"SELECT id, new_customers * 90 + expansion AS gained, churned_mrr + contraction AS lost FROM {rel} t"
    return f"SELECT id, round({div('gained', 'lost')}, 4) AS quick_ratio, CASE WHEN gained = 0 AND lost = 0 THEN 'NO_DATA' WHEN lost = 0 THEN 'EXCELLENT' WHEN gained >= 4 * lost THEN 'EXCELLENT' WHEN gained >= 2 * lost THEN 'HEALTHY' WHEN gained >= lost THEN 'WATCH' ELSE 'CRITICAL' END AS status FROM ({q}) q"


@op("saas_project", saas, growth_pct=5.0, churn_pct=2.0, months=12)
def saas_project(d, rel, growth_pct, churn_pct, months):
    return f"SELECT id, CAST(m AS BIGINT) AS month, round(mrr * pow(1 + {(growth_pct - churn_pct) / 100:e}, m), 2) AS mrr FROM {rel} t CROSS JOIN (SELECT {d.unnest(d.seq('1', str(months)))} AS m) s"


@op("saas_churn_impact", saas)
def saas_churn_impact(d, rel):
    """Gain from better saves (10 to 25 %) and recoveries (20 to 50 %), and what to do first."""
    a = f"SELECT id, customers, mrr, churned / customers AS rate, mrr * churned / customers * 7e-1 AS voluntary, mrr * churned / customers * 3e-1 AS involuntary, mrr / customers AS each FROM {rel} t"
    b = "voluntary * (25e-2 - 1e-1)"
    c = "involuntary * (5e-1 - 2e-1)"
    return f"SELECT id, round({b} + {c}, 4) AS monthly_gain, round(({b} + {c}) * 12, 4) AS annual_gain, round(({b} + {c}) / each, 4) AS customers_kept, round(coalesce(({b} + {c}) / each * (each / nullif(rate, 0)), 0), 2) AS ltv_impact, CASE WHEN {b} > {c} * 15e-1 THEN 'save offers' WHEN {c} > {b} * 15e-1 THEN 'payment recovery' ELSE 'both' END AS first_step FROM ({a}) a"


@op("price_project", saas, new_price=1.2, churn=0.03, months=12)
def price_project(d, rel, new_price, churn, months):
    """A quarter of the increase leaks as churn at once; then a linear recurrence in closed form."""
    hit = max(0.0, new_price - 1) * 0.25
    keep = f"pow(1 - {churn:e}, m)"
    return f"SELECT id, CAST(m AS BIGINT) AS month, round((customers * (1 - {hit:e}) * {keep} + new_customers * (1 - {keep}) / {churn:e}) * mrr / customers * {new_price:e}, 2) AS mrr FROM {rel} t CROSS JOIN (SELECT {d.unnest(d.seq('1', str(months)))} AS m) s"


@op("price_tiers", saas)
def price_tiers(d, rel):
    q = f"SELECT id, greatest(mrr / customers * 3e-1 / (1 - 7e-1), mrr / customers * 5e-1 * 9e-1) AS entry_price, mrr / customers AS arpu, (mrr / customers + 1e2) / 2 AS market FROM {rel} t"
    return f"SELECT id, round(entry_price, 4) AS entry_price, round(entry_price * 25e-1, 4) AS middle, round(entry_price * 625e-2, 4) AS premium, CASE WHEN abs(arpu - market) / market < 15e-2 THEN 'at-market' WHEN arpu < market THEN 'below-market' ELSE 'above-market' END AS stand FROM ({q}) q"


@op("price_elasticity", "part", key="p_partkey", rate="p_size")
def price_elasticity(d, rel, key, rate):
    """Bands of trial conversion in percent and the room they leave."""
    band = lambda *v: f"CASE WHEN {rate} > 40 THEN {v[0]} WHEN {rate} > 25 THEN {v[1]} WHEN {rate} > 15 THEN {v[2]} WHEN {rate} > 8 THEN {v[3]} ELSE {v[4]} END"
    names = band("'strong-underpricing'", "'possible-underpricing'", "'market-priced'", "'possible-overpricing'", "'high-friction'")
    return f"SELECT {key}, {names} AS signal, {band('3e-1', '15e-2', '5e-2', '-5e-2', '-15e-2')} AS headroom FROM {rel} t"
