"""Work of a task does not grow with the tables."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.operators import finance
from millrace.plans import dialect
from millrace.streaming import state

SF = "/root/testdata/sf0.001"
LOTS = "bt_close_fifo bt_close_lot bt_open_lots bt_win_rate bt_cover_fifo bt_cover_short bt_validate_trades".split()
KEPT_APART = "bt_close_lot bt_open_lots bt_win_rate bt_cover_fifo bt_cover_short bt_validate_trades".split()


def test_upserts_of_a_stream_call_no_python(spark, tmp_path):
    """A change of a smaller id that comes later moves the first time only."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema, src = "k long, event_id long, ts timestamp, summary string", str(tmp_path / "in")
    for part in ([(1, 5, at(5), "five"), (2, 1, at(9), "one")], [(1, 3, at(3), "three"), (1, 4, at(7), "four"), (2, 8, at(10), None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = state.stream_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = state.last_update(state.run_to_end(stream, str(tmp_path / "out")), ["k"]).select("k", F.hour("created_at"), "event_id", "summary").collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 5, "five"), (2, 9, 8, None)]


def shuffles(df):
    """Key and number of partitions of each shuffle by hash."""
    return re.findall(r"hashpartitioning\((.*?)#\d+.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", LOTS)
def test_lots_take_more_tasks_of_more_trades(spark, name, monkeypatch):
    """One shuffle of the trades, to tasks of TASK_ROWS rows, and the same rows."""
    want = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    df = registry.QUERIES[name](spark, SF)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and {s for s in shuffles(df) if s[0] in ("l_partkey", "symbol")} == {("l_partkey", str(n))}
    assert sorted(map(repr, df.collect())) == want


def test_trades_of_a_frame_are_dealt_too(spark, monkeypatch):
    monkeypatch.setattr(dialect, "TASK_ROWS", 100)
    df = spark.createDataFrame([(i % 50, i, "a", "buy" if i % 3 else "sell", 1, 1.0) for i in range(600)], "symbol long, seq long, date string, side string, size long, price double")
    for op in (finance.bt_close_fifo, finance.bt_unfilled, finance.bt_open_lots):
        assert set(shuffles(op.apply(df))) == {("symbol", "6")}


@pytest.mark.parametrize("name", KEPT_APART)
def test_lots_are_not_joined_to_larger_tasks(spark, name, monkeypatch):
    """As many tasks as the rows ask for also where the session has more partitions, which adaptive execution would join by their bytes."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert n < 200 and re.search(rf"hashpartitioning\(l_partkey#\d+L?, {n}\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\((l_partkey|symbol)#\d+L?, 200\)", plan)


@pytest.mark.parametrize("name", ["bt_open_lots", "bt_win_rate", "bt_cover_fifo", "bt_cover_short", "bt_validate_trades"])
def test_lots_are_sorted_no_more_than_their_orders_ask_for(spark, name):
    """By what numbers the trades, by their number and by the ends of pieces (bt_validate_trades: its aggregates of text, too), as each sort holds its rows in memory."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) <= (4 if name == "bt_validate_trades" else 3)


@pytest.mark.parametrize("name", ["bt_win_rate", "bt_cover_fifo", "bt_cover_short", "bt_validate_trades"])
def test_reading_of_lots_holds_no_rows(spark, name, monkeypatch):
    """Spark's shuffle writer holds a split's rows if it has more than 200 partitions, so there are no more while tasks take up to five times the rows; the rows are the same."""
    want = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for rows, n in ((lines // 150, 151), (lines // 300, 200), (lines // 900, 200), (lines // 1500, 1500)):
        monkeypatch.setattr(dialect, "TASK_ROWS", rows)
        df = registry.QUERIES[name](spark, SF)
        dealt = {int(k) for key, k in shuffles(df) if key in ("l_partkey", "symbol")}
        assert len(dealt) == 1 and abs(dealt.pop() - n) <= (0 if n == 200 else 1)
        if n == 200 and rows == lines // 300:
            assert sorted(map(repr, df.collect())) == want


def test_exported_trades_are_dealt(spark, monkeypatch):
    from millrace.sources import files

    told, export = [], files.export_backtest
    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    monkeypatch.setattr(files, "export_backtest", lambda equity, trades, *rest: (told.append(shuffles(trades)), export(equity, trades, *rest))[1])
    assert sorted(r["name"] for r in registry.QUERIES["sink_backtest"](spark, SF).collect()) == ["equity.csv", "trades.csv"]
    assert {s for s in told[0] if s[0] in ("l_partkey", "symbol")} == {("l_partkey", str(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)))}


def test_exported_trades_are_not_joined_to_larger_tasks(spark, monkeypatch):
    """As the lots above, also where the session has more partitions than the rows ask for; no query before it has named lineitem."""
    from millrace.sources import files

    spark.catalog.dropTempView("lineitem")
    told, export, parts = [], files.export_backtest, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    monkeypatch.setattr(files, "export_backtest", lambda equity, trades, *rest: (told.append(shuffles(trades)), export(equity, trades, *rest))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert registry.QUERIES["sink_backtest"](spark, SF).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert n < 20 and {s for s in told[0] if s[0] in ("l_partkey", "symbol")} == {("l_partkey", str(n))}


def test_join_and_characters_are_dealt(spark, monkeypatch):
    from millrace.operators import text

    want = {name: sorted(map(repr, registry.QUERIES[name](spark, SF).collect())) for name in ("win_cum_event_curve", "str_shannon_entropy")}
    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    monkeypatch.setattr(text, "STRINGS", 20)
    for name, key, table, rows in (("win_cum_event_curve", "l_orderkey", "lineitem", 500), ("str_shannon_entropy", "p_partkey", "part", 20)):
        df = registry.QUERIES[name](spark, SF)
        assert shuffles(df).count((key, str(-(-spark.read.parquet(f"{SF}/{table}.parquet").count() // rows)))) == 1
        assert df._jdf.queryExecution().executedPlan().toString().count("Join") <= 1
        assert sorted(map(repr, df.collect())) == want[name]


@pytest.fixture
def unasked(spark):
    """No join is broadcast but by a hint, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_levene_shuffles_no_rows_by_group(spark, unasked):
    """Rows dealt by a group of three values are three tasks; what is shuffled by group is counts of values or of groups."""
    df = registry.QUERIES["test_levene"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line and "g3" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_ranges_by_halves(spark):
    from millrace.plans.ranks import CUTS, range_of

    for n in (0, 1, 2, 7, CUTS - 1):
        cuts = ", ".join(f"{i * 2}D" for i in range(n))
        got = spark.sql(f"SELECT v, {range_of('v')} AS at, size(filter(cuts, x -> x < v)) AS n FROM (SELECT CAST(id AS DOUBLE) - 1 AS v, CAST(array({cuts}) AS ARRAY<DOUBLE>) AS cuts FROM range(420))").collect()
        assert all(r["at"] == r["n"] for r in got)


def test_rates_search_only_texts_that_can_match(spark):
    """The same counts as without the tests before the patterns, nulls too."""
    from millrace.operators import text

    texts = [None, "", "plain words — no", "café “quoted”", "好像在走——缓缓地——走", "想像 轻轻松 图像是", "不是一而是二", "没有\n只有", "轻轻 宛若 映像"]
    spark.createDataFrame([(t,) for t in texts], "text string").createOrReplaceTempView("rate_texts")
    for rate, (pattern, no, _) in text.RATES.items():
        p, n = dialect.SPARK.lit(pattern), dialect.SPARK.lit(no or "^$")
        told = text.rate_hits(dialect.SPARK, rate)
        assert "octet_length" in told
        assert all(a == b for a, b in spark.sql(f"SELECT {told}, size(filter(regexp_extract_all(text, {p}, 0), v -> NOT v RLIKE {n})) FROM rate_texts").collect() if a is not None), rate


def test_auto_select_sends_the_medians_to_the_rows(spark, unasked, monkeypatch):
    """Each equality of variances that is asked for, not the query of its own alone."""
    from millrace.operators import statistics

    plans, apply = [], statistics.test_levene.apply
    monkeypatch.setattr(statistics.test_levene, "apply", lambda df, **kw: (plans.append(apply(df, **kw)), plans[-1])[1])
    assert registry.QUERIES["test_auto_select"](spark, SF).count() == 6
    assert plans and all("BroadcastHashJoin" in line for p in plans for line in p._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and re.search(r"g[23]#", line))


def test_auto_select_looks_at_groups_once(spark, monkeypatch):
    """Equal variances and normality of the same groups are not told anew for a forced test."""
    from millrace.operators import statistics

    calls, levene, normality = [], statistics.test_levene.apply, statistics.normality
    monkeypatch.setattr(statistics.test_levene, "apply", lambda df, **kw: (calls.append(tuple(kw.values())), levene(df, **kw))[1])
    monkeypatch.setattr(statistics, "normality", lambda df, column, *rest: (calls.append(column), normality(df, column, *rest))[1])
    assert [r["test"] for r in registry.QUERIES["test_auto_select"](spark, SF).collect()][4] == "anova"
    assert calls.count(("g3", "y")) == calls.count(("g2", "y")) == 1 and calls.count("y") <= 5


def test_average_cost_of_short_symbols_calls_no_python(spark, monkeypatch):
    """Trades dealt once, and arrays walked by Spark; symbols longer than a block go over blocks, with the same positions."""
    from millrace.plans import blocks

    monkeypatch.setattr(dialect, "TASK_ROWS", 500)
    df = registry.QUERIES["bt_avg_cost"](spark, SF)
    assert "Python" not in df._jdf.queryExecution().analyzed().toString() and "Pandas" not in df._jdf.queryExecution().analyzed().toString()
    assert set(shuffles(df)) == {("l_partkey", str(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)))}

    trades = [(s, i, "sell" if (i * 7 + (s or 0)) % 3 == 0 else "buy", 1 + i % 5, 1.0 + i % 11) for s, n in ((1, 20), (2, 21), (3, 90), (None, 70), (4, 1)) for i in range(n)]
    df = spark.createDataFrame([*trades, (5, 1, "buy", 2, None), (6, 1, "sell", 3, 1.0), (7, 1, "hold", 1, 1.0)], "symbol long, seq long, side string, size long, price double")
    told = lambda: {r["symbol"]: (r["held"], round(r["cost"], 6) if r["cost"] is not None else None, round(r["pnl"], 6)) for r in finance.average_cost(df).collect()}
    want = told()
    assert want.keys() == {1, 2, 3, 4, 5, 6, None} and want[5] == (2.0, None, 0.0) and want[6] == (0.0, 0.0, 0.0)
    monkeypatch.setattr(blocks, "ROWS", 20)
    assert told() == want
