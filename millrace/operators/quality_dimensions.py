"""Data-quality dimensions and outliers.

All per-column measures of a dimension come from one aggregate over the table;
a row per column is unfolded from its single result row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans import fixtures as fx
from ..plans.blocks import halo, positions
from ..plans.dialect import Registry, on_tables
from ..plans.ranks import quantiles
from .relational import C, ones

R = Registry()
op = R.op

NUM, TEXT = ("c_custkey", "c_nationkey", "c_acctbal", "c_const"), ("c_name", "c_mktsegment", "c_mail")
ALL = (*NUM, *TEXT)
STRIP = r"[ \t\n\r\x0b\x0c]"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$"


def unfolded(d, rel: str, columns, measures: dict[str, str], extra: str = "") -> str:
    """One aggregate of all measures ({c} is the column), then a row for each column."""
    agg = ", ".join(f"{e.format(c=c)} AS m{i}_{j}" for i, c in enumerate(columns) for j, e in enumerate(measures.values()))
    rows = d.long("", "m", [{"col": f"'{c}'"} | {n: f"m{i}_{j}" for j, n in enumerate(measures)} | {"n": "n"} for i, c in enumerate(columns)])
    return f"WITH m AS (SELECT {agg}, count(*) AS n{extra} FROM {rel} t) {rows}"


def kinds(d, rel, columns) -> str:
    """(col, k, filled): different and all values of each column, from one table of counts."""
    cells = d.long("", rel, [{"col": f"'{c}'", "v": f"CAST({c} AS {'STRING' if d.spark else 'VARCHAR'})"} for c in columns])
    return f"SELECT col, count(v) AS k, {C('coalesce(sum(CASE WHEN v IS NOT NULL THEN n END), 0)')} AS filled FROM (SELECT col, v, count(*) AS n FROM ({cells}) c GROUP BY col, v) g GROUP BY col"


@op("dq_missing_values", fx.dirty, columns=ALL)
def dq_missing_values(d, rel, columns):
    q = unfolded(d, rel, columns, {"missing": ones("{c} IS NULL")})
    return f"SELECT col, missing, round(missing * 1e2 / n, 2) AS pct, round(100 * (1 - sum(missing) OVER () / (1e0 * sum(n) OVER ())), 2) AS score FROM ({q}) q"


@op("dq_duplicates", fx.dirty, columns=ALL)
def dq_duplicates(d, rel, columns):
    return f"SELECT {C('sum(k - 1)')} AS duplicates, round(100 * (1 - sum(k - 1) / (1e0 * sum(k))), 2) AS score FROM (SELECT count(*) AS k FROM {rel} t GROUP BY {', '.join(columns)}) x"


@op("dq_type_consistency", lambda d: "SELECT CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR(20)) END AS a, p_brand AS b, CAST(p_partkey AS VARCHAR(20)) AS c FROM part", columns=("a", "b", "c"))
def dq_type_consistency(d, rel, columns):
    """Text columns of which more than half, but not all, values are numbers."""
    q = unfolded(d, rel, columns, {"numeric_n": "count(try_cast({c} AS DOUBLE))", "filled": "count({c})"})
    return f"SELECT col, numeric_n, filled, numeric_n > filled * 5e-1 AND numeric_n < filled AS mixed FROM ({q}) q"


@op("dq_value_range", fx.dirty, columns=NUM)
def dq_value_range(d, rel, columns):
    """Share outside 1.5 IQR per numeric column with four values or more; quantiles come from counts of values."""
    cells = f"({d.long('', rel, [{'col': f"'{c}'", 'x': f'CAST({c} AS DOUBLE)'} for c in columns])})"
    out = ones("x < q0 - 15e-1 * (q1 - q0) OR x > q1 + 15e-1 * (q1 - q0)")
    rows = f"SELECT col, {out} AS outliers, count(x) AS filled FROM {cells} c JOIN ({quantiles(d, cells, 'x', (0.25, 0.75), 'col')}) q ON col = g GROUP BY col"
    return f"SELECT col, outliers, filled, filled >= 4 AND outliers * 1e2 / nullif(filled, 0) > 1 AS problem FROM ({rows}) r"


@op("dq_format_detect", fx.dirty, column="c_mail", order="c_custkey")
def dq_format_detect(d, rel, column, order):
    """The format that more than half of the first 100 values have."""
    test = {"email": EMAIL, "phone": r"^([+]?[0-9]{1,4}[ -]?)?[(]?[0-9]{2,4}[)]?[ -]?[0-9]{3,4}[ -]?[0-9]{4}$", "url": r"^https?://[^ \t\n]+$"}
    whens = " ".join(f"WHEN {ones(d.like('v', p))} > count(*) * 5e-1 THEN '{k}'" for k, p in test.items())
    return f"SELECT CASE {whens} WHEN count(try_cast(v AS DATE)) > count(*) * 7e-1 THEN 'date' END AS format, count(*) AS sampled FROM (SELECT trim({column}) AS v FROM {rel} t WHERE {column} IS NOT NULL ORDER BY {order}, {column} LIMIT 100) s"


@op("dq_format_compliance", fx.dirty, column="c_mail", pattern=EMAIL)
def dq_format_compliance(d, rel, column, pattern):
    bad = ones(f"{column} IS NOT NULL AND NOT {d.like(f'trim({column})', pattern)}")
    return f"SELECT {bad} AS invalid, count({column}) AS filled, round({bad} * 1e2 / nullif(count({column}), 0), 2) AS pct FROM {rel} t"


@op("dq_uniqueness", fx.dirty, column="c_custkey", n=5)
def dq_uniqueness(d, rel, column, n):
    """Repeated ids: how many values are beyond the first, and the most frequent."""
    return f"""WITH g AS (SELECT {column} AS k, count(*) AS c FROM {rel} t WHERE {column} IS NOT NULL GROUP BY {column})
      SELECT k, c, dup, round(dup * 1e2 / total, 2) AS pct FROM (SELECT k, c FROM g WHERE c > 1 ORDER BY c DESC, k LIMIT {n}) x CROSS JOIN (SELECT {C('sum(c - 1)')} AS dup, {C('sum(c)')} AS total FROM g) y"""


@op("dq_whitespace", fx.dirty, columns=TEXT)
def dq_whitespace(d, rel, columns):
    """Untrimmed, empty and blank values; blank ones count among the first two also."""
    edge = lambda c: d.like(c, f"(^{STRIP}|{STRIP}$)").replace("{", "{{").replace("}", "}}")
    blank = lambda c: d.like(c, f"^{STRIP}+$").replace("{", "{{").replace("}", "}}")
    bare = lambda f: f("@@").replace("@@", "{c}")
    return f"SELECT col, untrimmed, empty, blank FROM ({unfolded(d, rel, columns, {'untrimmed': ones(bare(edge)), 'empty': ones(bare(blank) + ' OR {c} = ' + chr(39) * 2), 'blank': ones(bare(blank))})}) q"


@op("dq_constant_columns", fx.dirty, columns=ALL)
def dq_constant_columns(d, rel, columns):
    return f"SELECT col, k, k <= 1 AS is_constant FROM ({kinds(d, rel, columns)}) q"


@op("dq_distribution_skew", "lineitem", columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def dq_distribution_skew(d, rel, columns):
    """Sample-adjusted skewness of columns with eight values or more."""
    skew = "skewness({c}) * sqrt(1e0 * count({c}) * (count({c}) - 1)) / (count({c}) - 2)" if d.spark else "skewness({c})"
    return f"SELECT col, round(skew, 4) + 0e0 AS skew, abs(skew) > 3 AS problem, abs(skew) > 1 AS note FROM ({unfolded(d, rel, columns, {'skew': skew, 'k': 'count({c})'})}) q WHERE k >= 8"


@op("dq_cardinality", fx.dirty, numeric=NUM, text=TEXT)
def dq_cardinality(d, rel, numeric, text):
    q = kinds(d, rel, (*numeric, *text))
    names = ", ".join(f"'{c}'" for c in numeric)
    return f"SELECT col, k, filled, CASE WHEN col IN ({names}) THEN k <= 2 AND filled > 20 ELSE k * 1e0 / nullif(filled, 0) > 95e-2 AND filled > 50 END AS problem FROM ({q}) q"


@op("dq_cross_column", lambda d: "SELECT l_shipdate AS start_date, CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE o_orderdate END AS end_date, l_extendedprice AS total, l_tax * 10000 AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey", pairs=(("start_date", "end_date"), ("tax", "total")))
def dq_cross_column(d, rel, pairs):
    """Rows that break an order of two columns."""
    agg = ", ".join(f"{ones(f'{a} > {b}')} AS v{i}, {ones(f'{a} IS NOT NULL AND {b} IS NOT NULL')} AS k{i}" for i, (a, b) in enumerate(pairs))
    rows = d.long("", "m", [{"low": f"'{a}'", "high": f"'{b}'", "violations": f"v{i}", "valid": f"k{i}", "pct": f"round(v{i} * 1e2 / nullif(k{i}, 0), 2)"} for i, (a, b) in enumerate(pairs)])
    return f"WITH m AS (SELECT {agg} FROM {rel} t) {rows}"


# fixed values: weights of the twelve dimensions
WEIGHTS = {"missing_values": 15, "duplicates": 10, "type_consistency": 10, "value_range": 10, "format_compliance": 10, "uniqueness": 8, "whitespace": 7, "constant_columns": 5, "distribution_skew": 5, "column_naming": 5, "cardinality": 5, "cross_column": 10}


# fixed values: the least score of each grade
GRADES = {"A+": 95, "A": 90, "B": 80, "C": 60, "D": 40}


def graded(score: float) -> str:
    return next((g for g, least in GRADES.items() if score >= least), "F")


def dimension_scores(d) -> str:
    """Two measured dimensions of the customers with gaps: missing cells, and rows that repeat others."""
    missing = " + ".join(ones(f"{c} IS NULL") for c in ALL)
    rel = f"({fx.dirty(d)})"
    return f"SELECT 'missing_values' AS dimension, 100 * (1 - ({missing}) / (1e0 * count(*) * {len(ALL)})) AS score FROM {rel} t UNION ALL SELECT 'duplicates', 100e0 * count(*) / sum(n) FROM (SELECT {', '.join(ALL)}, count(*) AS n FROM {rel} u GROUP BY {', '.join(ALL)}) g"


@op("dq_overall_score", dimension_scores)
def dq_overall_score(d, rel):
    """Weighted mean of the scores (dimension, score) and its grade; dimensions that were not measured count as 100."""
    lost = " ".join(f"WHEN {d.lit(k)} THEN {w}" for k, w in WEIGHTS.items())
    s = f"SELECT 100 - coalesce(sum((100 - score) * CASE dimension {lost} ELSE 0 END), 0) / {sum(WEIGHTS.values())}e0 AS s FROM {rel} t"
    return f"SELECT round(s, 2) AS score, CASE WHEN s >= 95 THEN 'A+' WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS grade FROM ({s}) x"


def column_naming(df: DataFrame) -> DataFrame:
    """Problems of column names, a row for mixed cases over all of them, and the score on each row."""
    plain = re.compile(r"^[a-zA-Z_一-鿿][a-zA-Z0-9_一-鿿]*$")
    rows = []
    for c in df.columns:
        bare = c.strip()
        found = [n for n, bad in (("padded", c != bare), ("blanks", " " in bare), ("characters", not plain.match(bare))) if bad]
        if found:
            rows.append((c, ",".join(found)))
    styles = {"lower" if c == c.lower() else "upper" if c == c.upper() else "mixed" for c in map(str.strip, df.columns)}
    if len(styles) > 1:
        rows.append(("(all)", "mixed case"))
    score = max(0.0, round(100 * (1 - len(rows) / (max(1, len(df.columns)) + 1)), 2))
    return df.sparkSession.createDataFrame([(*r, score) for r in rows] or [("(all)", "none", score)], "col string, problems string, score double")


@R.query("dq_column_naming", "SELECT * FROM (VALUES ('Customer Name', 'blanks,characters', 25e0), ('2nd', 'characters', 25e0), ('(all)', 'mixed case', 25e0)) v(col, problems, score)", column_naming)
def dq_column_naming(spark, sf_dir):
    return column_naming(on_tables(spark, sf_dir, "SELECT c_custkey, c_name AS `Customer Name`, c_acctbal AS `2nd` FROM customer"))


def numeric_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


@R.query("project_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem", numeric_columns)
def project_numeric(spark, sf_dir):
    return numeric_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns that a table lacks."""
    return df.sparkSession.createDataFrame([(c,) for c in sorted(set(required) - set(df.columns))], "missing string")


@R.query("set_intersect_missing", "SELECT * FROM (VALUES ('o_close'), ('o_ticker')) v(missing)", missing_columns)
def set_intersect_missing(spark, sf_dir):
    return missing_columns(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey", "o_orderdate", "o_close", "o_ticker"])


# --- outliers ---

VALUES = lambda d: "SELECT event_id AS id, value AS v FROM events"


@op("out_numeric_columns", lambda d: "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR(20)) END AS a, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '1.5' END AS b, '' AS c FROM part", columns=("a", "b", "c"))
def out_numeric_columns(d, rel, columns):
    """Columns of which four in five filled cells are numbers."""
    q = unfolded(d, rel, columns, {"numbers": "count(try_cast({c} AS DOUBLE))", "filled": ones("trim({c}) <> ''")})
    return f"SELECT col, filled > 0 AND numbers >= 8e-1 * filled AS is_numeric FROM ({q}) q"


def stats_sql(d, rel):
    a = f"SELECT count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi FROM {rel} t"
    return f"SELECT a.*, q0 AS q1, m.q1 AS med, q2 AS q3 FROM ({a}) a CROSS JOIN ({quantiles(d, rel, 'v', (0.25, 0.5, 0.75))}) m"


@op("out_column_stats", VALUES)
def out_column_stats(d, rel):
    return f"SELECT n, round(mean, 4) AS mean, round(std, 4) AS std, lo AS min, hi AS max, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr FROM ({stats_sql(d, rel)}) s"


def zscore_sql(d, rel, threshold=3.0):
    return f"SELECT id, v, 'z-score' AS method, (v - mean) / std AS measure, CASE WHEN abs((v - mean) / std) >= {threshold * 1.5:e} THEN 'extreme' ELSE 'moderate' END AS severity FROM {rel} t CROSS JOIN (SELECT * FROM ({stats_sql(d, rel)}) s WHERE n >= 3 AND std > 0) s WHERE abs((v - mean) / std) >= {threshold:e}"


def iqr_sql(d, rel, k=1.5):
    iqr = "(q3 - q1)"
    return f"SELECT id, v, 'iqr' AS method, v AS measure, CASE WHEN v < q1 - 3 * {iqr} OR v > q3 + 3 * {iqr} THEN 'extreme' ELSE 'moderate' END AS severity FROM {rel} t CROSS JOIN (SELECT * FROM ({stats_sql(d, rel)}) s WHERE n >= 4 AND q3 > q1) s WHERE v < q1 - {k:e} * {iqr} OR v > q3 + {k:e} * {iqr}"


def placed(df, window=5, **_):
    """Values in the order of their ids, each block with the rows that its first windows reach back to."""
    return halo(positions(df.select("id", "v"), ["id"]), window - 1)


def own(d, rel):
    """The rows themselves, without halos."""
    return f"(SELECT id, v FROM {rel} h WHERE _own)" if d.spark else rel


def moving_sql(d, rel, window=5, threshold=2.0):
    """Distance from the trailing mean in units of the deviation of positive distances."""
    order = "PARTITION BY _in ORDER BY _pos" if d.spark else "ORDER BY id"
    dev = f"SELECT {'_own, ' if d.spark else ''}id, v, abs(v - avg(v) OVER ({order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) AS dist FROM {rel} t"
    if d.spark:
        dev = f"SELECT id, v, dist FROM ({dev}) h WHERE _own"
    unit = f"SELECT coalesce(stddev_samp(CASE WHEN dist > 0 THEN dist END), avg(CASE WHEN dist > 0 THEN dist END)) AS unit, count(*) AS k FROM ({dev}) d1"
    return f"SELECT id, v, 'moving-avg' AS method, dist / unit AS measure, CASE WHEN dist / unit >= {2 * threshold:e} THEN 'extreme' ELSE 'moderate' END AS severity FROM ({dev}) d2 CROSS JOIN (SELECT * FROM ({unit}) u WHERE unit > 0 AND k >= {window + 2}) u WHERE dist / unit >= {threshold:e}"


@op("out_zscore", VALUES, threshold=3.0)
def out_zscore(d, rel, threshold):
    return f"SELECT id, v, round(measure, 4) AS z, severity FROM ({zscore_sql(d, rel, threshold)}) z"


@op("out_iqr", VALUES, k=1.5)
def out_iqr(d, rel, k):
    return f"SELECT id, v, severity FROM ({iqr_sql(d, rel, k)}) i"


@op("out_moving_avg", VALUES, placed, window=5, threshold=2.0)
def out_moving_avg(d, rel, window, threshold):
    return f"SELECT id, v, round(measure, 4) AS ratio, severity FROM ({moving_sql(d, rel, window, threshold)}) m"


def classify_sql(d, rel):
    every = " UNION ALL ".join(f"SELECT id, v, method, severity FROM ({q}) {n}" for n, q in (("a", zscore_sql(d, own(d, rel))), ("b", iqr_sql(d, own(d, rel))), ("c", moving_sql(d, rel))))
    return f"SELECT id, max(v) AS v, count(*) AS methods, CASE WHEN count(*) >= 2 OR max(CASE WHEN severity = 'extreme' THEN 1 ELSE 0 END) = 1 THEN 'needs_attention' ELSE 'explainable' END AS class FROM ({every}) e GROUP BY id"


@op("out_classify", VALUES, placed)
def out_classify(d, rel):
    return classify_sql(d, rel)


@op("out_summary", VALUES, placed)
def out_summary(d, rel):
    return f"SELECT class, count(*) AS n, {C('sum(methods)')} AS detections FROM ({classify_sql(d, rel)}) c GROUP BY class"
