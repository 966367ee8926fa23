"""Window functions and sequential state over ordered series.

Rolling operators give NULL until a full window, unless said otherwise.  Every
operator takes its order explicitly and is partitioned by a symbol, so symbols
are independent of each other.  Exponential means are recurrences that SQL windows
lack; they are scans over blocks of a symbol's history (`plans/blocks.py`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.blocks import halo, positions, scan, since_valid
from ..plans.dialect import DUCK, SPARK, Registry, on_tables

R = Registry()
op = R.op
W = "PARTITION BY symbol ORDER BY date"


def full(agg: str, x: str, n: int, by: str = W) -> str:
    """``agg`` of the last n rows, NULL until n values of ``x`` are there."""
    frame = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {agg}({x}) {frame} END"


def running(agg: str, x: str, by: str = W) -> str:
    return f"{agg}({x}) OVER ({by} ROWS UNBOUNDED PRECEDING)"


def lag(x: str, n: int = 1, by: str = W) -> str:
    return f"lag({x}, {n}) OVER ({by})"


def rounded(cols: dict[str, str], rel: str, digits: int = 6) -> str:
    return "SELECT symbol, date, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in cols.items()) + f" FROM {rel} t"


def sma_sql(d, rel, windows=(5, 10, 20, 60)):
    return rounded({f"sma_{n}": full("avg", "close", n) for n in windows}, rel)


@op("ind_sma", fx.ohlcv, windows=(5, 10, 20, 60))
def ind_sma(d, rel, windows):
    return sma_sql(d, rel, windows)


def rsi_sql(rel, n=14):
    diff = f"SELECT symbol, date, close - {lag('close')} AS diff FROM {rel} t"
    gain = f"SELECT symbol, date, CASE WHEN diff > 0 THEN diff ELSE 0e0 END AS gain, CASE WHEN diff < 0 THEN -diff ELSE 0e0 END AS loss FROM ({diff}) d"
    mean = f"SELECT symbol, date, {full('avg', 'gain', n)} AS g, {full('avg', 'loss', n)} AS l FROM ({gain}) g"
    return f"SELECT symbol, date, 1e2 - 1e2 / (1 + g / nullif(l, 0)) AS rsi FROM ({mean}) m"


@op("ind_rsi", fx.ohlcv, n=14)
def ind_rsi(d, rel, n):
    """Simple means of gains and losses; the first difference counts as neither."""
    return f"SELECT symbol, date, round(rsi, 6) AS rsi FROM ({rsi_sql(rel, n)}) r"


def bollinger_sql(rel, n=20, k=2):
    return f"SELECT symbol, date, mid, mid + {k} * sd AS upper, mid - {k} * sd AS lower FROM (SELECT symbol, date, {full('avg', 'close', n)} AS mid, {full('stddev_pop', 'close', n)} AS sd FROM {rel} t) b"


@op("ind_bollinger", fx.ohlcv, n=20, k=2)
def ind_bollinger(d, rel, n, k):
    """Population standard deviation."""
    return f"SELECT symbol, date, round(mid, 4) AS mid, round(upper, 4) AS upper, round(lower, 4) AS lower FROM ({bollinger_sql(rel, n, k)}) b"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@op("ind_atr", fx.ohlcv, n=14)
def ind_atr(d, rel, n):
    return rounded({"atr": full("avg", "tr", n)}, f"(SELECT symbol, date, {TR} AS tr FROM {rel} x)", 4)


def obv_sql(rel):
    step = f"SELECT symbol, date, CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0e0 END AS s FROM {rel} t"
    return f"SELECT symbol, date, {running('sum', 's')} AS obv FROM ({step}) o"


@op("ind_obv", fx.ohlcv)
def ind_obv(d, rel):
    return obv_sql(rel)


@op("ind_vwap", fx.ohlcv)
def ind_vwap(d, rel):
    """Cumulative, not per day."""
    amount = "CAST(high + low + close AS DECIMAL(18, 4)) * CAST(volume AS DECIMAL(18, 0))"
    return f"SELECT symbol, date, CAST({running('sum', 'amount')} AS DOUBLE) / nullif(3 * {running('sum', 'volume')}, 0) AS vwap FROM (SELECT symbol, date, {amount} AS amount, volume FROM {rel} x) t"


def cci_sql(d, rel, n=20):
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    items = f"collect_list(tp) {frame}" if d.spark else f"list(tp) {frame}"
    base = f"SELECT symbol, date, tp, avg(tp) {frame} AS m, {items} AS xs FROM (SELECT symbol, date, (high + low + close) / 3 AS tp FROM {rel} x) y"
    dev = f"aggregate(transform(xs, x -> abs(x - m)), 0D, (a, x) -> a + x) / {n}" if d.spark else f"list_sum(list_transform(xs, lambda x: abs(x - m))) / {n}"
    return f"SELECT symbol, date, CASE WHEN {d.size('xs')} >= {n} THEN (tp - m) / nullif(15e-3 * ({dev}), 0) END AS cci FROM ({base}) b"


@op("ind_cci", fx.ohlcv, n=20)
def ind_cci(d, rel, n):
    """Mean absolute deviation around each window's own mean."""
    return f"SELECT symbol, date, round(cci, 4) AS cci FROM ({cci_sql(d, rel, n)}) c"


def williams_sql(rel, n=14):
    return f"SELECT symbol, date, 0e0 - (hh - close) / nullif(hh - ll, 0) * 100 AS williams_r FROM (SELECT symbol, date, close, {full('max', 'high', n)} AS hh, {full('min', 'low', n)} AS ll FROM {rel} t) w"


@op("ind_williams_r", fx.ohlcv, n=14)
def ind_williams_r(d, rel, n):
    return f"SELECT symbol, date, round(williams_r, 6) AS williams_r FROM ({williams_sql(rel, n)}) w"


def adx_sql(rel, n=14):
    """+DM is masked before -DM is compared with it."""
    a = f"SELECT symbol, date, high - {lag('high')} AS up, -(low - {lag('low')}) AS dn, {TR} AS tr FROM {rel} t"
    b = f"SELECT symbol, date, dn, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0e0 END AS pdm FROM ({a}) a"
    c = f"SELECT symbol, date, tr, pdm, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0e0 END AS mdm FROM ({b}) b"
    m = f"SELECT symbol, date, 1e2 * {full('avg', 'pdm', n)} / nullif({full('avg', 'tr', n)}, 0) AS pdi, 1e2 * {full('avg', 'mdm', n)} / nullif({full('avg', 'tr', n)}, 0) AS mdi FROM ({c}) c"
    x = f"SELECT symbol, date, pdi, mdi, 1e2 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM ({m}) m"
    return f"SELECT symbol, date, pdi, mdi, {full('avg', 'dx', n)} AS adx FROM ({x}) x"


@op("ind_adx", fx.ohlcv, n=14)
def ind_adx(d, rel, n):
    return f"SELECT symbol, date, round(adx, 4) AS adx, round(pdi, 4) AS plus_di, round(mdi, 4) AS minus_di FROM ({adx_sql(rel, n)}) a"


def roc_sql(rel, n=12):
    return f"SELECT symbol, date, (close - {lag('close', n)}) / nullif({lag('close', n)}, 0) * 100 AS roc FROM {rel} t"


@op("ind_roc", fx.ohlcv, n=12)
def ind_roc(d, rel, n):
    return f"SELECT symbol, date, round(roc, 6) AS roc FROM ({roc_sql(rel, n)}) r"


def mfi_sql(rel, n=14):
    tp = f"SELECT symbol, date, (high + low + close) / 3 AS tp, volume FROM {rel} t"
    flow = f"SELECT symbol, date, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0e0 END AS p, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0e0 END AS q FROM ({tp}) x"
    return f"SELECT symbol, date, 1e2 - 1e2 / (1 + p / nullif(q, 0)) AS mfi FROM (SELECT symbol, date, {full('sum', 'p', n)} AS p, {full('sum', 'q', n)} AS q FROM ({flow}) f) s"


@op("ind_mfi", fx.ohlcv, n=14)
def ind_mfi(d, rel, n):
    return f"SELECT symbol, date, round(mfi, 4) AS mfi FROM ({mfi_sql(rel, n)}) m"


# --- exponential means ---

BY = ["symbol"]


def ewm(x: pd.Series, span: float | None = None, alpha: float | None = None) -> pd.Series:
    """Exponential mean of a whole series, seeded by the first value; decays over inner missing values."""
    return x.ewm(span=span, alpha=alpha, adjust=False).mean()


def ewm_terms(p: pd.DataFrame, column: str, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(keep, gain) of an exponential mean e' = keep e + gain at each row.

    The first value seeds it; a missing value leaves it, and lets the next one
    weigh more, as the weights of the rows before go on to decay.
    """
    x, pos = p[column].to_numpy(float), p["_pos"].to_numpy(float)
    valid, first = ~np.isnan(x), pos == p["_start"].to_numpy(float)
    old = (1 - alpha) ** (pos - np.nan_to_num(p["_last"].to_numpy(float), nan=-1.0))
    keep = np.where(first, 0.0, np.where(valid, old / (old + alpha), 1.0))
    return keep, np.where(valid, np.where(first, 1.0, alpha / (old + alpha)) * np.nan_to_num(x), 0.0)


def _live(p: pd.DataFrame, later: int = 0) -> np.ndarray:
    return (p["_pos"] - later >= p["_start"]).to_numpy(bool)


def _carried(p: pd.DataFrame, alpha: float) -> np.ndarray:
    """Weight of the old value in a mean of a mean: seeded where that begins, and without gaps after."""
    return np.where(p["_pos"] == p["_start"], 0.0, np.where(_live(p), 1 - alpha, 1.0))


def _maps(n: int, states: int) -> np.ndarray:
    m = np.zeros((n, states + 1, states + 1))
    m[:, states, states] = 1.0
    return m


def _then(m: np.ndarray, row: int, old: np.ndarray, of: np.ndarray) -> None:
    """State ``row`` becomes the mean of itself and of ``of``, a row of coefficients for what it averages."""
    m[:, row] = (1 - old)[:, None] * of
    m[:, row, row] += old


def _recurrence(df: DataFrame, column: str, states: int, maps, out, columns: list[str]) -> DataFrame:
    """``out`` gives columns from rows, their states and those before; rows need not be placed yet."""
    placed = df if "_pos" in df.columns else positions(df, ["date"], BY)
    placed = since_valid(placed.select("symbol", "date", column, "_pos", "_block"), BY, column)

    def told(p: pd.DataFrame, after: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        live = _live(p)
        return pd.DataFrame({"symbol": p["symbol"], "date": p["date"], **{c: np.where(live, x, np.nan) for c, x in zip(columns, out(p, after, before))}})

    return scan(placed, BY, states, maps, told, "symbol string, date string, " + ", ".join(f"{c} double" for c in columns))


def _round(df: DataFrame, digits: int) -> DataFrame:
    return df.selectExpr("symbol", "date", *[f"round({c}, {digits}) + 0D AS {c}" for c in df.columns[2:]])


def ema(df: DataFrame, span: int = 12) -> DataFrame:
    """Exponential mean of close per symbol, by blocks of its history."""

    def maps(p: pd.DataFrame) -> np.ndarray:
        m = _maps(len(p), 1)
        m[:, 0, 0], m[:, 0, 1] = ewm_terms(p, "close", 2 / (span + 1))
        return m

    return _recurrence(df, "close", 1, maps, lambda p, after, before: [after[:, 0]], ["ema"])


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """States: the two means of close, and the signal, the mean of their difference."""

    def maps(p: pd.DataFrame) -> np.ndarray:
        m = _maps(len(p), 3)
        for k, span in enumerate((fast, slow)):
            m[:, k, k], m[:, k, 3] = ewm_terms(p, "close", 2 / (span + 1))
        _then(m, 2, _carried(p, 2 / (signal + 1)), m[:, 0] - m[:, 1])
        return m

    def out(p: pd.DataFrame, after: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        line = after[:, 0] - after[:, 1]
        return [line, after[:, 2], line - after[:, 2]]

    return _recurrence(df, "close", 3, maps, out, ["macd", "signal", "histogram"])


def kdj(df: DataFrame, n: int = 9) -> DataFrame:
    """The place of close within the range of n bars, which a block's halo completes, and two means on it."""
    placed = positions(df.select("symbol", "date", "high", "low", "close"), ["date"], BY)
    frame = Window.partitionBy("symbol", "_in").orderBy("_pos").rowsBetween(1 - n, 0)
    low, high = (F.when(F.count(c).over(frame) >= n, f(c).over(frame)) for c, f in (("low", F.min), ("high", F.max)))
    ranged = halo(placed, n - 1).withColumns({"ll": low, "hh": high}).where("_own").selectExpr("symbol", "date", "_pos", "_block", "(close - ll) / nullif(hh - ll, 0) * 100 AS rsv")

    def maps(p: pd.DataFrame) -> np.ndarray:
        m = _maps(len(p), 2)
        m[:, 0, 0], m[:, 0, 2] = ewm_terms(p, "rsv", 1 / 3)
        _then(m, 1, _carried(p, 1 / 3), m[:, 0])
        return m

    return _recurrence(ranged, "rsv", 2, maps, lambda p, after, before: [after[:, 0], after[:, 1], 3 * after[:, 0] - 2 * after[:, 1]], ["k", "d", "j"])


def trix(df: DataFrame, span: int = 12) -> DataFrame:
    """Change of a mean of a mean of a mean, in percent of the one before."""

    def maps(p: pd.DataFrame) -> np.ndarray:
        m = _maps(len(p), 3)
        m[:, 0, 0], m[:, 0, 3] = ewm_terms(p, "close", 2 / (span + 1))
        for k in (1, 2):
            _then(m, k, _carried(p, 2 / (span + 1)), m[:, k - 1])
        return m

    def out(p: pd.DataFrame, after: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        was = np.where(_live(p, 1) & (before[:, 2] != 0), before[:, 2], np.nan)
        return [(after[:, 2] - was) / was * 100]

    return _recurrence(df, "close", 3, maps, out, ["trix"])


BARS = fx.ohlcv(SPARK)
_NUMBERED = f"n AS (SELECT symbol, date, open, high, low, close, row_number() OVER ({W}) AS rn FROM ({fx.ohlcv(DUCK)}) b)"


def _ema_cte(name: str, source: str, column: str, alpha: str) -> str:
    """A recursive CTE of an exponential mean over numbered rows."""
    return f"{name} AS (SELECT symbol, date, rn, {column} AS e FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.date, s.rn, p.e + {alpha} * (s.{column} - p.e) FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"


@R.query("ind_ema", f"WITH RECURSIVE {_NUMBERED}, e AS MATERIALIZED (SELECT * FROM n), {_ema_cte('x', 'e', 'close', '2e0 / 13')} SELECT symbol, date, round(e, 4) AS ema FROM x", on=ema)
def ind_ema(spark, sf_dir):
    return _round(ema(on_tables(spark, sf_dir, BARS)), 4)


@R.query(
    "ind_macd",
    f"""WITH RECURSIVE {_NUMBERED}, m AS MATERIALIZED (SELECT * FROM n), {_ema_cte('a', 'm', 'close', '2e0 / 13')}, {_ema_cte('b', 'm', 'close', '2e0 / 27')},
    l AS MATERIALIZED (SELECT a.symbol, a.date, a.rn, a.e - b.e AS line FROM a JOIN b ON a.symbol = b.symbol AND a.rn = b.rn), {_ema_cte('s', 'l', 'line', '2e-1')}
    SELECT l.symbol, l.date, round(line, 4) AS macd, round(s.e, 4) AS signal, round(line - s.e, 4) AS histogram FROM l JOIN s ON l.symbol = s.symbol AND l.rn = s.rn""",
    on=macd,
)
def ind_macd(spark, sf_dir):
    return _round(macd(on_tables(spark, sf_dir, BARS)), 4)


@R.query(
    "ind_trix",
    f"""WITH RECURSIVE {_NUMBERED}, m AS MATERIALIZED (SELECT * FROM n), {_ema_cte('a', 'm', 'close', '2e0 / 13')}, a1 AS MATERIALIZED (SELECT * FROM a), {_ema_cte('b', 'a1', 'e', '2e0 / 13')}, b1 AS MATERIALIZED (SELECT * FROM b),
    {_ema_cte('c', 'b1', 'e', '2e0 / 13')} SELECT symbol, date, round((e - lag(e) OVER ({W})) / nullif(lag(e) OVER ({W}), 0) * 100, 4) + 0e0 AS trix FROM c""",
    on=trix,
)
def ind_trix(spark, sf_dir):
    return _round(trix(on_tables(spark, sf_dir, BARS)), 4)


def _kdj_sql() -> str:
    hl = f"SELECT symbol, date, close, {full('min', 'low', 9)} AS ll, {full('max', 'high', 9)} AS hh, row_number() OVER ({W}) AS rn0 FROM ({fx.ohlcv(DUCK)}) b"
    rsv = f"SELECT symbol, date, rn0 - 8 AS rn, (close - ll) / nullif(hh - ll, 0) * 100 AS rsv FROM ({hl}) h WHERE rn0 >= 9"
    k = _ema_cte("k", "m", "rsv", "(1e0 / 3)")
    q = _ema_cte("q", "k1", "e", "(1e0 / 3)")
    every = f"SELECT symbol, date FROM ({fx.ohlcv(DUCK)}) z"
    return f"WITH RECURSIVE m AS MATERIALIZED ({rsv}), {k}, k1 AS MATERIALIZED (SELECT * FROM k), {q} SELECT a.symbol, a.date, round(k1.e, 4) AS k, round(q.e, 4) AS d, round(3 * k1.e - 2 * q.e, 4) AS j FROM ({every}) a LEFT JOIN k1 ON a.symbol = k1.symbol AND a.date = k1.date LEFT JOIN q ON a.symbol = q.symbol AND a.date = q.date"


@R.query("ind_kdj", _kdj_sql(), on=kdj)
def ind_kdj(spark, sf_dir):
    return _round(kdj(on_tables(spark, sf_dir, BARS)), 4)


VOTES = {
    "ma_cross": "CASE WHEN sma5 > sma20 THEN 'bullish' WHEN sma5 <= sma20 THEN 'bearish' END",
    "rsi": "CASE WHEN rsi < 30 THEN 'bullish' WHEN rsi > 70 THEN 'bearish' WHEN rsi IS NOT NULL THEN 'neutral' END",
    "bollinger": "CASE WHEN close < lower THEN 'bullish' WHEN close > upper THEN 'bearish' WHEN upper IS NOT NULL THEN 'neutral' END",
    "cci": "CASE WHEN cci < -100 THEN 'bullish' WHEN cci > 100 THEN 'bearish' WHEN cci IS NOT NULL THEN 'neutral' END",
    "williams_r": "CASE WHEN williams_r < -80 THEN 'bullish' WHEN williams_r > -20 THEN 'bearish' WHEN williams_r IS NOT NULL THEN 'neutral' END",
    "adx_dmi": "CASE WHEN adx > 25 AND pdi > mdi THEN 'bullish' WHEN adx > 25 THEN 'bearish' WHEN adx IS NOT NULL THEN 'neutral' END",
    "roc": "CASE WHEN roc > 0 THEN 'bullish' WHEN roc <= 0 THEN 'bearish' END",
    "mfi": "CASE WHEN mfi < 20 THEN 'bullish' WHEN mfi > 80 THEN 'bearish' WHEN mfi IS NOT NULL THEN 'neutral' END",
    "obv": "CASE WHEN obv > obv_before THEN 'bullish' WHEN obv <= obv_before THEN 'bearish' END",
    "macd": "CASE WHEN histogram > 0 THEN 'bullish' WHEN histogram <= 0 THEN 'bearish' END",
    "kdj": "CASE WHEN j < 20 THEN 'bullish' WHEN j > 80 THEN 'bearish' WHEN k > d THEN 'bullish' WHEN d IS NOT NULL THEN 'bearish' END",
    "trix": "CASE WHEN trix > 0 THEN 'bullish' WHEN trix <= 0 THEN 'bearish' END",
}


def _signal_rows(d, bars: str, macd_rel: str, kdj_rel: str, trix_rel: str) -> str:
    """The last row of each symbol with all indicators; OBV also as of the fifth row from the end."""
    parts = {
        "s": f"SELECT symbol, date, {full('avg', 'close', 5)} AS sma5, {full('avg', 'close', 20)} AS sma20 FROM bars t", "r": rsi_sql("bars"), "b": bollinger_sql("bars"), "c": cci_sql(d, "bars"), "w": williams_sql("bars"),
        "a": adx_sql("bars"), "o": roc_sql("bars"), "m": mfi_sql("bars"), "v": f"SELECT symbol, date, obv, lag(obv, 4) OVER ({W}) AS obv_before FROM ({obv_sql('bars')}) z",
    }
    last = f"SELECT symbol, date, close FROM (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars t) l WHERE back = 1"
    cols = "l.symbol, l.date, l.close, sma5, sma20, rsi, upper, lower, cci, williams_r, adx, pdi, mdi, roc, mfi, obv, obv_before, histogram, k, d, j, trix"
    joins = " ".join(f"JOIN ({q}) {n} ON l.symbol = {n}.symbol AND l.date = {n}.date" for n, q in parts.items())
    joins += "".join(f" JOIN {rel} {n} ON l.symbol = {n}.symbol AND l.date = {n}.date" for n, rel in (("x1", macd_rel), ("x2", kdj_rel), ("x3", trix_rel)))
    rows = f"SELECT {cols} FROM ({last}) l {joins}"
    votes = d.long("symbol", "p", [{"indicator": f"'{n}'", "signal": e} for n, e in VOTES.items()])
    return f"p AS ({rows}), votes AS (SELECT * FROM ({votes}) u WHERE signal IS NOT NULL)"


_VERDICT = """SELECT symbol, CASE WHEN bull > bear THEN 'bullish' WHEN bear > bull THEN 'bearish' ELSE 'neutral' END AS verdict, bull AS bullish_count, bear AS bearish_count, total - bull - bear AS neutral_count, total AS total_indicators,
  round(bull * 1e2 / total, 1) AS bullish_pct, round(bear * 1e2 / total, 1) AS bearish_pct FROM (SELECT symbol, CAST(sum(CASE WHEN signal = 'bullish' THEN 1 ELSE 0 END) AS BIGINT) AS bull, CAST(sum(CASE WHEN signal = 'bearish' THEN 1 ELSE 0 END) AS BIGINT) AS bear, count(*) AS total FROM votes GROUP BY symbol) v"""


def _signal_oracle(tail: str) -> str:
    sub = {n: R.sql[f"ind_{n}"] for n in ("macd", "kdj", "trix")}
    return f"WITH bars AS MATERIALIZED ({fx.ohlcv(DUCK)}), macd AS MATERIALIZED ({sub['macd']}), kdj AS MATERIALIZED ({sub['kdj']}), trix AS MATERIALIZED ({sub['trix']}), {_signal_rows(DUCK, 'bars', 'macd', 'kdj', 'trix')} {tail}"


def signals(bars: DataFrame, tail: str = "SELECT * FROM votes") -> DataFrame:
    """Votes of twelve indicators on each symbol's last row."""
    text = f"WITH bars AS (SELECT * FROM {{bars}}), {_signal_rows(SPARK, 'bars', '{macd}', '{kdj}', '{trix}')} {tail}"
    return bars.sparkSession.sql(text, bars=bars, macd=_round(macd(bars), 4), kdj=_round(kdj(bars), 4), trix=_round(trix(bars), 4))


@R.query("ind_signals", _signal_oracle("SELECT * FROM votes"))
def ind_signals(spark, sf_dir):
    return signals(on_tables(spark, sf_dir, BARS))


@R.query("ind_verdict", _signal_oracle(_VERDICT))
def ind_verdict(spark, sf_dir):
    return signals(on_tables(spark, sf_dir, BARS), _VERDICT)


# --- returns, drawdowns, curves ---

BY_FUND = "PARTITION BY fund ORDER BY date"
FUND = lambda d: fx.nav(d)


@op("win_daily_return", FUND)
def win_daily_return(d, rel):
    return f"SELECT fund, date, round(nav / nullif(lag(nav) OVER ({BY_FUND}), 0) - 1, 8) AS ret FROM {rel} t"


@op("win_ffill", lambda d: f"SELECT a.fund, a.date, b.nav FROM (SELECT fund, date FROM (SELECT DISTINCT fund FROM ({fx.nav(d)}) x) f CROSS JOIN (SELECT DISTINCT date FROM ({fx.nav(d)}) y) g) a LEFT JOIN ({fx.nav(d)}) b ON a.fund = b.fund AND a.date = b.date")
def win_ffill(d, rel):
    """The last known value, then the change against the row before."""
    last = f"last_value(nav, true) OVER ({BY_FUND} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if d.spark else f"last_value(nav IGNORE NULLS) OVER ({BY_FUND} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT fund, date, filled, round(filled / lag(filled) OVER ({BY_FUND}) - 1, 8) AS change FROM (SELECT fund, date, {last} AS filled FROM {rel} t) x"


@op("win_running_max_drawdown", FUND)
def win_running_max_drawdown(d, rel):
    return f"SELECT fund, round(max((peak - nav) / peak), 8) AS max_drawdown FROM (SELECT fund, nav, max(nav) OVER ({BY_FUND} ROWS UNBOUNDED PRECEDING) AS peak FROM {rel} t WHERE nav > 0) x GROUP BY fund"


@op("win_drawdown_curve", FUND)
def win_drawdown_curve(d, rel):
    """Percent below the peak so far; a peak of zero or less gives 0 or -100."""
    return f"SELECT fund, date, round(CASE WHEN peak > 0 THEN (nav / peak - 1) * 100 WHEN nav < peak THEN -100 ELSE 0 END, 6) AS drawdown FROM (SELECT fund, date, nav, max(nav) OVER ({BY_FUND} ROWS UNBOUNDED PRECEDING) AS peak FROM {rel} t) x"


@op("win_moving_avg_partial", fx.daily, n=5)
def win_moving_avg_partial(d, rel, n):
    """Trailing mean over what rows there are."""
    return f"SELECT date, round(avg(value) OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 7) AS mean FROM {rel} t"


@op("win_cross_event", fx.ohlcv, short=5, long=20)
def win_cross_event(d, rel, short, long):
    """The row on which the short mean passes the long one, in either direction."""
    m = f"SELECT symbol, date, {full('avg', 'close', short)} AS a, {full('avg', 'close', long)} AS b FROM {rel} t"
    p = f"SELECT symbol, date, a, b, lag(a) OVER ({W}) AS pa, lag(b) OVER ({W}) AS pb FROM ({m}) m"
    return f"SELECT symbol, date, CASE WHEN a > b THEN 'up' ELSE 'down' END AS cross_to FROM ({p}) p WHERE (pa <= pb AND a > b) OR (pa >= pb AND a < b)"


@op("win_dedup_consecutive", "events")
def win_dedup_consecutive(d, rel):
    return f"SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {rel} t) x WHERE before IS DISTINCT FROM event_type"


@op("win_streak", fx.quarters, alert=2)
def win_streak(d, rel, alert):
    """Length of each run of negative cash flow, with an alert from ``alert`` on."""
    g = f"SELECT year, quarter, cash_flow, row_number() OVER (ORDER BY year, quarter) - row_number() OVER (PARTITION BY cash_flow < 0 ORDER BY year, quarter) AS g FROM {rel} t"
    return f"SELECT min(year * 10 + quarter) AS first_period, max(year * 10 + quarter) AS last_period, count(*) AS length, count(*) >= {alert} AS alert FROM ({g}) g WHERE cash_flow < 0 GROUP BY g"


def inflection_sql(rel):
    lags = ", ".join(f"lag({c}, {n}) OVER (ORDER BY concurrency) AS {c[:3]}{n}" for c in ("p99_ms", "rps", "concurrency", "errors", "total_requests") for n in (1, 2))
    q = f"SELECT *, {lags} FROM {rel} t"
    return f"""SELECT concurrency, CAST(concurrency - 1 AS BIGINT) AS step_index, (p991 - p992 > 0 AND p99_ms - p991 > 2 * (p991 - p992)) AS latency_up, (rps1 / con1 > 0 AND rps / concurrency < 6e-1 * rps1 / con1) AS efficiency_down,
      (rps1 > 0 AND p991 > 0 AND (rps - rps1) / rps1 * 100 < 10 AND (p99_ms - p991) / p991 * 100 > 50) AS saturated, (errors * 1e2 / total_requests > 1 AND (err1 = 0 OR errors * 1e2 / total_requests > 2 * err1 * 1e2 / tot1)) AS errors_up
      FROM ({q}) q WHERE p992 IS NOT NULL"""


@op("win_inflection", fx.steps)
def win_inflection(d, rel):
    return f"SELECT * FROM ({inflection_sql(rel)}) i WHERE latency_up OR efficiency_down OR saturated OR errors_up"


@op("perf_optimal", fx.steps)
def perf_optimal(d, rel):
    """The step before the first inflection, else the one with most requests a second."""
    return f"SELECT coalesce((SELECT min(step_index) FROM ({inflection_sql(rel)}) i WHERE latency_up OR efficiency_down OR saturated OR errors_up), (SELECT max_by(concurrency, rps) FROM {rel} t)) AS concurrency"


@op("win_rebase", fx.ohlcv, base=100.0)
def win_rebase(d, rel, base):
    return f"SELECT symbol, date, round(close / first_value(close) OVER ({W}) * {base:e}, 4) AS rebased FROM {rel} t"


@op("win_nav_compound", fx.prices, anchor="1996-06")
def win_nav_compound(d, rel, anchor):
    """Cap-weighted return compounded and set to 100 at the anchor."""
    ret = f"SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, w FROM {rel} t JOIN (SELECT ticker AS tk, cap / sum(cap) OVER () AS w FROM (SELECT ticker, close * shares AS cap FROM {rel} z WHERE date = '{anchor}') c) u ON ticker = tk"
    port = f"SELECT date, coalesce(sum(r * w), 0) AS r FROM ({ret}) a GROUP BY date"
    logs = f"SELECT date, sum(ln(1 + greatest(r, -0.999999))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM ({port}) p"
    return f"WITH l AS ({logs}) SELECT l.date, round(100 * exp(l.s - a.s), 4) AS nav FROM l CROSS JOIN (SELECT s FROM l WHERE date = '{anchor}') a"


@op("win_cum_event_curve", lambda d: f"SELECT l_orderkey, {d.day('l_shipdate')} AS exit_date, {d.day('o_orderdate')} AS entry_date, CAST(round((l_discount - 0.05) * 100) AS DOUBLE) AS pct FROM {d.dealt('lineitem', 'l_orderkey')} JOIN orders ON l_orderkey = o_orderkey")
def win_cum_event_curve(d, rel):
    """100 plus the running sum of realised percent; entry dates are zero points."""
    rows = f"SELECT exit_date AS date, pct AS p FROM {rel} t UNION ALL SELECT entry_date, 0e0 FROM {rel} u"
    if d.spark:  # one pass: the rows may be a join
        rows = d.long("", rel, [{"date": "exit_date", "p": "pct"}, {"date": "entry_date", "p": "0e0"}])
    return f"SELECT date, 100 + sum(p) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT date, sum(p) AS p FROM ({rows}) x GROUP BY date) y"


@op("win_rank_final", lambda d: "SELECT c_nationkey AS opt, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey", option="opt", total="total", order="opt")
def win_rank_final(d, rel, option, total, order):
    """Places by total, and by the order of the input where totals are equal; one row an option, so the window is small."""
    return f"SELECT {option}, {total}, CAST(row_number() OVER (ORDER BY {total} DESC, {order}) AS BIGINT) AS place FROM {rel} t"
