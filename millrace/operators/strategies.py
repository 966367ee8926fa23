"""Strategy backtests: a sequential fold per symbol in pandas, parallel across symbols.

Signals of bar i are filled at the open of bar i + 1, in lots of 100.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..plans import fixtures as fx
from ..plans.dialect import SPARK, Registry, on_tables
from .series import ewm

R = Registry()
TRADES = "symbol string, entry_date string, exit_date string, size double, entry_price double, exit_price double, pnl double, reason string, entry_signal string, exit_signal string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRADES.split(", ")])


def _trade(symbol, lot, date, price, reason, signal=None):
    """A closed lot; ``signal`` is the date of the bar that closed it, none at the end of the data."""
    return (symbol, lot["date"], date, float(lot["size"]), float(lot["price"]), float(price), float((price - lot["price"]) * lot["size"]), reason, lot["signal"], signal)


def _bars(p: pd.DataFrame) -> list[tuple[int, dict, str | None]]:
    """(place, bar, date of the bar before) of a symbol's bars in order."""
    rows = p.to_dict("records")
    return [(i, row, rows[i - 1]["date"] if i else None) for i, row in enumerate(rows)]


def ma_cross(bars: DataFrame, fast: int = 20, slow: int = 60, filter_: int = 120, trail: float = 0.08, cash: float = 1e9) -> DataFrame:
    """Buy where the fast mean passes the slow one above the filter; sell on the reverse or the trailing stop.

    The stop is tested against the peak so far before the bar's high raises it.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date").reset_index(drop=True)
        a, b, f = ewm(p["close"], fast), ewm(p["close"], slow), p["close"].rolling(filter_).mean()
        up = (a.shift(1) <= b.shift(1)) & (a > b) & (p["close"] > f)
        down = (a.shift(1) >= b.shift(1)) & (a < b)
        money, lot, order, peak, out = cash, None, None, 0.0, []
        for i, row, before in _bars(p):
            if order == "buy" and lot is None:
                size = int(money / row["open"] // 100) * 100
                if size:
                    lot, peak = {"date": row["date"], "price": row["open"], "size": size, "signal": before}, row["open"]
                    money -= size * row["open"]
            elif order in ("cross", "stop") and lot is not None:
                out.append(_trade(row["symbol"], lot, row["date"], row["open"], order, before))
                money, lot = money + lot["size"] * row["open"], None
            order = None
            if lot is None:
                order = "buy" if up[i] else None
            else:
                order = "stop" if row["low"] <= peak * (1 - trail) else "cross" if down[i] else None
                peak = max(peak, row["high"])
        if lot is not None:
            out.append(_trade(p["symbol"].iloc[0], lot, p["date"].iloc[-1], p["close"].iloc[-1], "end"))
        return _frame(out)

    return bars.groupBy("symbol").applyInPandas(run, TRADES)


def grid(bars: DataFrame, step: float = 0.05, layers: int = 5, take: float = 0.05, size: int = 100) -> DataFrame:
    """Buy a lot for each step below the anchor, up to the layers; each lot takes its own profit."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date").reset_index(drop=True)
        anchor, lots, out, orders = p["close"].iloc[0], {}, [], []
        for i, row, before in _bars(p):
            for kind, layer in orders:
                if kind == "buy" and layer not in lots:
                    lots[layer] = {"date": row["date"], "price": row["open"], "size": size, "signal": before}
                elif kind == "sell" and layer in lots:
                    out.append(_trade(row["symbol"], lots.pop(layer), row["date"], row["open"], "profit", before))
            orders = [("buy", k) for k in range(1, layers + 1) if k not in lots and row["close"] <= anchor * (1 - k * step)]
            orders += [("sell", k) for k, lot in lots.items() if row["close"] >= lot["price"] * (1 + take)]
        out += [_trade(p["symbol"].iloc[0], lot, p["date"].iloc[-1], p["close"].iloc[-1], "end") for lot in lots.values()]
        return _frame(out)

    return bars.groupBy("symbol").applyInPandas(run, TRADES)


def scale_in(bars: DataFrame, size: int = 100) -> DataFrame:
    """One lot for each buy signal; each sell signal closes half of what is held, first in first out."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date").reset_index(drop=True)
        mean = p["close"].rolling(20).mean()
        lots, out, order = [], [], None
        for i, row, before in _bars(p):
            if order == "buy":
                lots.append({"date": row["date"], "price": row["open"], "size": size, "signal": before})
            elif order == "sell":
                left = sum(x["size"] for x in lots) / 2
                while left > 0 and lots:
                    part = min(left, lots[0]["size"])
                    out.append(_trade(row["symbol"], {**lots[0], "size": part}, row["date"], row["open"], "half", before))
                    lots[0]["size"] -= part
                    left -= part
                    if lots[0]["size"] <= 0:
                        lots.pop(0)
            order = "buy" if row["close"] < mean[i] * 0.9 else "sell" if row["close"] > mean[i] * 1.1 else None
        out += [_trade(p["symbol"].iloc[0], x, p["date"].iloc[-1], p["close"].iloc[-1], "end") for x in lots]
        return _frame(out)

    return bars.groupBy("symbol").applyInPandas(run, TRADES)


for _name, _run in (("bt_strategy_ma", ma_cross), ("bt_strategy_grid", grid), ("bt_strategy_scale_in", scale_in)):
    R.query(_name, on=_run)(lambda spark, sf_dir, run=_run: run(on_tables(spark, sf_dir, fx.ohlcv(SPARK))))

# fixed values: rules that no trade may break
RULES = {
    "entry filled after its signal": "entry_signal IS NULL OR entry_signal >= entry_date",
    "exit filled after its signal": "exit_signal IS NOT NULL AND exit_signal >= exit_date OR exit_signal IS NULL AND reason <> 'end'",
    "exit not before entry": "exit_date < entry_date",
}


def lookahead(trades: DataFrame) -> DataFrame:
    """How many trades break each rule against looking ahead: a signal of bar i may be filled at bar i + 1 at the earliest."""
    sums = trades.selectExpr(*[f"coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END), 0) AS r{i}" for i, bad in enumerate(RULES.values())])
    return sums.selectExpr("stack(" + str(len(RULES)) + ", " + ", ".join(f"'{name}', r{i}" for i, name in enumerate(RULES)) + ") AS (rule, violations)")


@R.query("ev_lookahead_rules", "SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES " + ", ".join(f"('{k}')" for k in RULES) + ") v(rule)", lookahead)
def ev_lookahead_rules(spark, sf_dir):
    """The rules over the trades of all strategies."""
    bars = on_tables(spark, sf_dir, fx.ohlcv(SPARK))
    return lookahead(ma_cross(bars).union(grid(bars)).union(scale_in(bars)))
