"""Ordered work in blocks against the same over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.operators import finance, series
from millrace.plans import blocks

from .test_accounting import random_trades


@pytest.fixture(params=[50])
def rows(request, monkeypatch):
    """Blocks of a few rows, so that series go over many."""
    monkeypatch.setattr(blocks, "ROWS", request.param)
    return request.param


def bars(n, gaps=True, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for symbol, size in (("a", n), ("b", n // 3), ("c", 3), ("d", 1)):
        close = 100 + np.cumsum(rng.standard_normal(size))
        low, high = close - rng.random(size), close + rng.random(size)
        flat = rng.random(size) < 0.05
        low[flat], high[flat] = close[flat], close[flat]
        if gaps:
            close[rng.random(size) < 0.1] = np.nan
            if symbol == "b":
                close[:7] = np.nan
                close[60:180] = np.nan
        out.append(pd.DataFrame({"symbol": symbol, "date": [f"{i:07d}" for i in range(size)], "open": close, "high": high, "low": low, "close": close, "volume": 1.0}))
    return pd.concat(out).sample(frac=1, random_state=1)


def frame(spark, pdf):
    schema = "symbol string, date string, open double, high double, low double, close double, volume double"
    return spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)], schema)


def same(df, want, columns):
    got = df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "date"]).reset_index(drop=True)
    assert got[["symbol", "date"]].equals(want[["symbol", "date"]])
    for c in columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-7, equal_nan=True)


def ewm(x, span=None, alpha=None):
    return x.ewm(span=span, alpha=alpha, adjust=False).mean()


def plain(pdf):
    out = []
    for _, p in pdf.sort_values("date").groupby("symbol"):
        p = p.copy()
        p["ema"] = ewm(p["close"], 12)
        p["macd"] = p["ema"] - ewm(p["close"], 26)
        p["signal"] = ewm(p["macd"], 9)
        p["histogram"] = p["macd"] - p["signal"]
        e = ewm(ewm(ewm(p["close"], 12), 12), 12)
        p["trix"] = (e - e.shift(1)) / e.shift(1).replace(0, np.nan) * 100
        low, high = p["low"].rolling(9, min_periods=9).min(), p["high"].rolling(9, min_periods=9).max()
        rsv = (p["close"] - low) / (high - low).replace(0, np.nan) * 100
        p["k"] = ewm(rsv, alpha=1 / 3)
        p["d"] = ewm(p["k"], alpha=1 / 3)
        p["j"] = 3 * p["k"] - 2 * p["d"]
        out.append(p)
    return pd.concat(out)


@pytest.mark.parametrize("name, columns", [("ind_ema", ["ema"]), ("ind_macd", ["macd", "signal", "histogram"]), ("ind_trix", ["trix"]), ("ind_kdj", ["k", "d", "j"])])
def test_exponential_means_equal_pandas(spark, rows, name, columns):
    pdf = bars(700)
    same(registry.OPS[name](frame(spark, pdf)), plain(pdf), columns)


def test_a_long_series_is_dealt_to_many_tasks(spark):
    """One symbol of 10^6 bars: as pandas, and no group holds more than a block."""
    n = 1_000_000
    x = np.cumsum(np.random.default_rng(1).standard_normal(n)) + 500
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "date": [f"{i:07d}" for i in range(n)], "close": x}))
    placed = blocks.positions(df, ["date"], ["symbol"])
    sizes = [r["count"] for r in placed.groupBy("symbol", "_block").count().collect()]
    assert max(sizes) == blocks.ROWS and len(sizes) == -(-n // blocks.ROWS)
    got = series.ema(df).orderBy("date").toPandas()["ema"].to_numpy()
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=12, adjust=False).mean().to_numpy(), rtol=1e-9)


def test_empty_series(spark):
    assert series.macd(frame(spark, bars(3).iloc[:0])).count() == 0
    assert finance.average_cost(spark.createDataFrame([], "symbol long, seq long, side string, size long, price double")).count() == 0


def test_average_cost_equals_a_loop(spark, rows):
    trades = random_trades(900, 4, 8)
    want = {}
    for symbol, _, _, side, size, price in trades:
        held, cost, pnl = want.get(symbol, (0, 0.0, 0.0))
        if side == "buy":
            held, cost = held + size, cost + price * size
        elif held:
            sold = min(held, size)
            held, cost, pnl = held - sold, cost - cost / held * sold, pnl + (price - cost / held) * sold
        want[symbol] = (held, cost if held else 0.0, pnl)
    df = spark.createDataFrame(trades, "symbol long, seq long, date string, side string, size long, price double")
    got = {r["symbol"]: (r["held"], r["cost"], r["pnl"]) for r in registry.OPS["bt_avg_cost"](df).collect()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-6)


def test_places_count_up_and_halos_reach_back(spark, rows):
    df = spark.range(333).select((F.col("id") * 7919 % 333).alias("k"), (F.col("id") % 3).alias("g"))
    placed = blocks.positions(df, ["k"])
    assert [r["_pos"] for r in placed.orderBy("k").collect()] == list(range(333))
    seen = blocks.halo(placed, 4).groupBy("_in").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.count("*").alias("n")).orderBy("_in").collect()
    for r in seen:
        assert (r["lo"], r["hi"]) == (max(0, r["_in"] * rows - 4), min(332, (r["_in"] + 1) * rows - 1)) and r["n"] == r["hi"] - r["lo"] + 1
    by = blocks.positions(df, ["k"], ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("_pos")).alias("p")).collect()
    assert all(r["p"] == list(range(111)) for r in by)
    with pytest.raises(ValueError):
        blocks.halo(placed, rows + 1)
