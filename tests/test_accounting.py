"""Lot accounting against plain loops."""

import random

import pytest

from millrace.operators import finance

TRADES = "symbol long, seq long, date string, side string, size long, price double"


def loop(trades, t_plus_1=False, opens="buy"):
    """(closed, unfilled, open) of each trade in turn, with the list of open lots."""
    closed, unfilled, held = [], [], {}
    for symbol, seq, date, side, size, price in sorted(trades, key=lambda t: (t[0], t[1])):
        lots = held.setdefault(symbol, [])
        if side == opens:
            lots.append([seq, size, price, date])
            continue
        for lot in lots:
            take = min(lot[1], size)
            if take and not (t_plus_1 and date <= lot[3]):
                closed.append((symbol, lot[0], seq, take, round((price - lot[2]) * take * (1 if opens == "buy" else -1), 7)))
                lot[1] -= take
                size -= take
        if size:
            unfilled.append((symbol, seq, size))
    return closed, unfilled, [(s, x[0], x[2], x[1]) for s, lots in held.items() for x in lots if x[1]]


def told(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def random_trades(n, symbols, seed):
    rng = random.Random(seed)
    day = dict.fromkeys(range(symbols), 0)
    out = []
    for seq in range(n):
        s = rng.randrange(symbols)
        day[s] += rng.random() < 0.6
        out.append((s, seq, f"2024-01-{1 + day[s] // 100:02d}.{day[s] % 100:02d}", rng.choice(["buy", "sell", "sell"] if s % 2 else ["buy", "buy", "sell"]), rng.randint(1, 30), float(rng.randint(1, 50))))
    return out


@pytest.mark.parametrize("t_plus_1", [False, True])
@pytest.mark.parametrize("opens", ["buy", "sell"])
def test_fifo_equals_a_loop(spark, t_plus_1, opens):
    trades = random_trades(600, 7, 4)
    df = spark.createDataFrame(trades, TRADES)
    closed, unfilled, left = loop(trades, t_plus_1, opens)
    assert unfilled and left
    op = finance.bt_close_fifo if opens == "buy" else finance.bt_cover_fifo
    assert told(op.apply(df, t_plus_1=t_plus_1)) == sorted(closed, key=repr)
    assert told(finance.bt_unfilled.apply(df, t_plus_1=t_plus_1, opens=opens)) == sorted(unfilled, key=repr)
    if opens == "buy":
        assert told(finance.bt_open_lots.apply(df, t_plus_1=t_plus_1)) == sorted(left, key=repr)


def test_a_sale_before_its_buy_stays_unfilled(spark):
    df = spark.createDataFrame([(1, 1, "a", "sell", 100, 10.0), (1, 2, "b", "buy", 100, 8.0)], TRADES)
    assert told(finance.bt_unfilled.apply(df)) == [(1, 1, 100)]
    assert finance.bt_close_fifo.apply(df).count() == 0
    assert finance.bt_close_lot.apply(df).count() == 0
    assert told(finance.bt_cover_fifo.apply(df)) == [(1, 1, 2, 100, 200.0)]


def test_lots_of_the_bar_are_kept_with_t_plus_1(spark):
    df = spark.createDataFrame([(1, 1, "a", "buy", 10, 1.0), (1, 2, "b", "buy", 10, 2.0), (1, 3, "b", "sell", 15, 3.0), (1, 4, "c", "sell", 15, 4.0), (1, 5, "c", None, 3, 1.0), (1, 6, "c", "buy", 0, 1.0)], TRADES)
    assert told(finance.bt_close_fifo.apply(df, t_plus_1=True)) == [(1, 1, 3, 10, 20.0), (1, 2, 4, 10, 20.0)]
    assert told(finance.bt_unfilled.apply(df, t_plus_1=True)) == [(1, 3, 5), (1, 4, 5)]


def test_no_pairs_are_joined(spark):
    df = spark.createDataFrame(random_trades(20, 2, 1), TRADES)
    assert "Join" not in finance.bt_close_fifo.apply(df)._jdf.queryExecution().optimizedPlan().toString()


RECORD = "lot_id string, side string, exit_date string, size double, entry_price double, pnl double, pnl_pct double, entry_notional double, entry_fee double, pnl_pct_basis double"


def test_trade_records_by_hand(spark):
    good = ("L1", "long", "2024-01-02", 10.0, 2.0, 1.0, 5.0, None, None, None)
    rows = [
        good, ("L2", None, "2024-01-02", 10.0, 2.0, 1.0, 4.97, None, None, None), ("L3", "SHORT", " ", 10.0, 2.0, 1.0, 4.9, None, None, None), (" ", "short", None, 10.0, 2.0, 1.0, 5.0, 20.0, 5.0, None),
        (None, "long", "d", 10.0, 2.0, 1.0, 10.0, 99.0, 1.0, 10.0), ("L6", "long", "d", None, 2.0, 1.0, 77.0, None, None, None), ("L7", "long", "d", 10.0, 2.0, None, 77.0, None, None, None), ("L8", "long", "d", 10.0, 0.0, 1.0, 77.0, None, None, None),
    ]
    df, equity = spark.createDataFrame(rows, RECORD), spark.createDataFrame([("a", 100.0), ("b", 101.0)], "date string, value double")
    run = lambda d, e, **kw: {r["rule"]: r["n"] for r in finance.bt_validate_trades.apply(d, equity=e, base=100, **kw).collect()}
    assert run(df, equity) == {"flat at end": 0, "closed trades": 2, "long only": 2, "lot ids": 2, "pnl_pct": 2, "equity without trades": 0}
    other = run(df, equity, market="us_stock", accounting="aggregate_average_cost", flat=False)
    assert (other["flat at end"], other["long only"], other["lot ids"]) == (1, 0, 6)
    assert run(df.limit(0), equity)["equity without trades"] == 1
    assert run(df.limit(0), equity.where("value = 100"))["equity without trades"] == 0
    assert set(run(df.where("lot_id = 'L1'"), equity).values()) == {0}
    assert tuple(finance.bt_win_rate.apply(df).first()) == (8, 87.5) and tuple(finance.bt_win_rate.apply(df.limit(0)).first()) == (0, 0.0)


def test_event_files_that_were_changed_are_told(spark, tmp_path):
    from millrace.sources import files

    rows = [(f"2024-01-0{d}", t, 10.0 + d * k, 5.0 * k) for d in range(1, 6) for k, t in enumerate(("a", "b"), 1) if (d, t) != (3, "b")]
    prices = spark.createDataFrame(rows, "date string, ticker string, close double, shares double")

    def export(name):
        path = str(tmp_path / name)
        files.export_event_study(prices, {"a": ("A", "core"), "b": ("B", "edge")}, "2024-01-01", path)
        return path

    told = lambda path: {r["rule"]: r["n"] for r in files.validate_event_study(spark, path).collect() if r["n"]}
    assert told(export("sound")) == {}
    path = export("changed")
    part = next(p for p in (tmp_path / "changed" / "portfolio.csv").iterdir() if p.suffix == ".csv" and p.stat().st_size)
    text = part.read_text()
    part.write_text(text.replace("100.0,", "90.0,", 1))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    got = told(path)
    assert got["changed files"] == 1 and got["not 100 at the start"] == 1
    path = export("lost")
    next(p for p in (tmp_path / "lost" / "prices.csv").iterdir() if p.suffix == ".csv" and p.stat().st_size).unlink()
    assert told(path)["missing files"] >= 1
