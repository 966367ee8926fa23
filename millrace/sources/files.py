"""File sources and sinks, and the catalog."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fixtures as fx
from ..plans.dialect import DUCK, SPARK, TABLES, Registry, on_tables
from ..session import cut, scratch

R = Registry()


def scan(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """A table by its extension: tsv, json, parquet or orc; anything else is CSV with a header."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        if schema is None:
            raise ValueError("a sheet is read with a schema")
        return scan_sheet(spark, path, schema)
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return reader.json(path, multiLine=True, encoding=encoding)
    return reader.csv(path, header=True, sep="\t" if kind in ("tsv", "tab") else ",", quote='"', escape='"', multiLine=True, encoding=encoding)


def scan_strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every cell a string; an empty file or one without a header is an error."""
    df = scan(spark, path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    return df


def numeric_cells(df: DataFrame) -> DataFrame:
    """Columns whose filled cells are all numbers become doubles."""
    row = df.agg(*[F.every((F.col(c).isNull()) | (F.trim(c) == "") | F.expr(f"try_cast(`{c}` AS DOUBLE)").isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if row[c] else F.col(c) for c in df.columns])


def walk(spark: SparkSession, root: str, most: int = 1 << 20, skip=(".git", "node_modules", "__pycache__", "dist", "build"), binary=("png", "jpg", "gif", "zip", "gz", "jar", "so", "pdf")) -> DataFrame:
    """Files below ``root`` but empty, oversize and binary ones and those in skipped folders below it; with their paths from there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString().rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring("path", len(where) + 2, 1 << 20)
    ok = (F.col("length") > 0) & (F.col("length") <= most) & ~F.lower(F.substring_index("path", ".", -1)).isin(*binary)
    for s in skip:
        ok = ok & ~F.concat(F.lit("/"), below).contains(f"/{s}/")
    return df.where(ok).select("path", below.alias("relative_path"), "length", "content")


def write(df: DataFrame, path: str, kind: str) -> bool:
    """Export as csv, json or parquet; other formats give False."""
    if kind not in ("csv", "json", "parquet"):
        return False
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, quote='"', escape='"') if kind == "csv" else getattr(writer, kind)(path)
    return True


def report(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON report, indented by two, in UTF-8."""
    text = json.dumps(content, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"


def _through(kind: str, suffix: str, sep: str = ","):
    def run(spark, sf_dir):
        df = spark.read.parquet(f"{sf_dir}/nation.parquet")
        path = f"{scratch(spark, 'scan')}.{suffix}"
        if kind == "json":
            df.write.option("ignoreNullFields", "false").json(path)
            return spark.read.schema(NATION).json(path)
        df.write.csv(path, header=True, sep=sep)
        return scan(spark, path, NATION)

    return run


_SAME = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
R.query("scan_csv", _SAME)(_through("csv", "csv"))
R.query("scan_tsv", _SAME)(_through("csv", "tsv", "\t"))
R.query("scan_json", _SAME)(_through("json", "json"))


@R.query("scan_csv_bom", "SELECT * FROM (VALUES ('1', 'a'), ('2', 'b')) v(id, name)")
def scan_csv_bom(spark, sf_dir):
    path = f"{scratch(spark, 'bom')}.csv"
    spark.createDataFrame([("﻿id,name",), ("1,a",), ("2,b",)], "value string").coalesce(1).write.text(path)
    return scan_strict_csv(spark, path)


@R.query("scan_csv_quoted_autotype", "SELECT CAST(p_partkey AS DOUBLE) AS id, concat('say \"', p_name, '\", ok') AS name, p_retailprice AS price FROM part")
def scan_csv_quoted_autotype(spark, sf_dir):
    df = on_tables(spark, sf_dir, "SELECT p_partkey AS id, concat('say \"', p_name, '\", ok') AS name, p_retailprice AS price FROM part")
    path = f"{scratch(spark, 'quoted')}.csv"
    write(df, path, "csv")
    return numeric_cells(scan(spark, path))


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.text(path)


@R.query("scan_log_text", "SELECT concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' INFO ', event_type) AS value FROM events")
def scan_log_text(spark, sf_dir):
    path = scratch(spark, "log")
    on_tables(spark, sf_dir, "SELECT concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' INFO ', event_type) AS value FROM events").write.text(path)
    return scan_log(spark, path)


@R.query("scan_files_walk", "SELECT * FROM (VALUES ('src', 6), ('docs', 6)) v(folder, length)")
def scan_files_walk(spark, sf_dir):
    path = f"{scratch(spark, 'tree')}/build/work"
    for sub in ("src", "node_modules/x", "docs"):
        spark.range(3).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.text(f"{path}/{sub}")
    return walk(spark, path).select(F.substring_index("relative_path", "/", 1).alias("folder"), F.col("length").cast("int").alias("length"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with their row counts."""
    out = None
    for t in TABLES:
        row = spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


R.query("catalog_list_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))(catalog_tables)


#: Declared keys, as files have none: table to its primary key and foreign keys (column to table).
KEYS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "region": (("r_regionkey",), {}), "nation": (("n_nationkey",), {"n_regionkey": "region"}), "customer": (("c_custkey",), {"c_nationkey": "nation"}), "supplier": (("s_suppkey",), {"s_nationkey": "nation"}),
    "part": (("p_partkey",), {}), "orders": (("o_orderkey",), {"o_custkey": "customer"}), "lineitem": (("l_orderkey", "l_linenumber"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": (("event_id",), {}), "documents": (("doc_id",), {}), "embeddings": (("vec_id",), {}), "pages": (("page_id",), {}), "benchmark": (("item_id",), {}), "labels": (("doc_id",), {"doc_id": "documents"}), "conversations": (("conv_id", "turn"), {}),
}


def describe(tables: dict[str, DataFrame], keys: dict = KEYS, defaults: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A row for each column of each table: place, type, nullability, default, declared keys and the table's row count.

    Tables in files have no indexes and no defaults but those that are handed in.
    """
    rows, counts = [], None
    for t, df in tables.items():
        pk, fks = keys.get(t, ((), {}))
        for i, f in enumerate(df.schema.fields):
            rows.append((t, i, f.name, f.dataType.simpleString(), f.nullable, (defaults or {}).get(t, {}).get(f.name), f.name in pk, fks.get(f.name)))
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        counts = one if counts is None else counts.union(one)
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(rows, "table_name string, place int, column_name string, data_type string, nullable boolean, default_value string, primary_key boolean, references_table string")
    return columns.join(F.broadcast(counts), "table_name")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


_PK = ", ".join(f"('{t}', '{c}')" for t, (pk, _) in KEYS.items() for c in pk)
_FK = ", ".join(f"('{t}', '{c}', '{r}')" for t, (_, fks) in KEYS.items() for c, r in fks.items())
_COLUMNS = f"SELECT table_name, CAST(ordinal_position - 1 AS INT) AS place, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})"
_TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@R.query(
    "catalog_describe",
    f"""SELECT c.table_name, c.place, c.column_name, p.k IS NOT NULL AS primary_key, f.r AS references_table, n.row_count FROM ({_COLUMNS}) c LEFT JOIN (VALUES {_PK}) p(t, k) ON c.table_name = p.t AND c.column_name = p.k
    LEFT JOIN (VALUES {_FK}) f(t, k, r) ON c.table_name = f.t AND c.column_name = f.k JOIN ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS row_count FROM {t}" for t in TABLES)}) n ON c.table_name = n.t""",
    describe,
)
def catalog_describe(spark, sf_dir):
    return describe(_tables(spark, sf_dir)).select("table_name", "place", "column_name", "primary_key", "references_table", "row_count")


def with_primary_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns (table_name, column_name) and whether they are of their table's primary key; keys has the same two columns."""
    return columns.join(keys.select("table_name", "column_name").distinct().withColumn("is_pk", F.lit(True)), ["table_name", "column_name"], "left").fillna(False, ["is_pk"])


@R.query("join_catalog_pk", f"SELECT c.table_name, c.place, c.column_name, p.k IS NOT NULL AS is_pk FROM ({_COLUMNS}) c LEFT JOIN (VALUES {_PK}) p(t, k) ON c.table_name = p.t AND c.column_name = p.k", with_primary_keys)
def join_catalog_pk(spark, sf_dir):
    rows = [(t, i, c) for t, df in _tables(spark, sf_dir).items() for i, c in enumerate(df.columns)]
    keys = [(t, c) for t, (pk, _) in KEYS.items() for c in pk]
    return with_primary_keys(spark.createDataFrame(rows, "table_name string, place int, column_name string"), spark.createDataFrame(keys, "table_name string, column_name string"))


def schema_extract(tables: dict[str, DataFrame], samples: int = 3) -> DataFrame:
    """Compact schema text and the first rows, by the first columns, of each table."""
    rows = []
    for t, df in tables.items():
        first = df.orderBy(*[f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "string")][:3]).limit(samples)
        rows.append((t, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), [json.dumps(r.asDict(), default=str) for r in first.collect()]))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, columns string, samples array<string>")


_LISTED = f"SELECT table_name, string_agg(column_name || ' ' || {_TYPES}, ', ' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) GROUP BY table_name"


@R.query("catalog_schema_extract", f"SELECT c.table_name, c.columns, least(3, n.n) AS n_samples FROM ({_LISTED}) c JOIN ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)}) n ON c.table_name = n.t", schema_extract)
def catalog_schema_extract(spark, sf_dir):
    return schema_extract(_tables(spark, sf_dir)).select("table_name", "columns", F.size("samples").cast("long").alias("n_samples"))


def er_diagram(keys: dict = KEYS) -> str:
    """Mermaid text of the declared foreign keys."""
    return "erDiagram\n" + "\n".join(f"  {r.upper()} ||--o{{ {t.upper()} : {c}" for t, (_, fks) in keys.items() for c, r in fks.items())


@R.query("catalog_er_diagram", f"SELECT 'erDiagram' || chr(10) || string_agg('  ' || upper(r) || ' ||--o{{ ' || upper(t) || ' : ' || k, chr(10) ORDER BY i) AS diagram FROM (SELECT row_number() OVER () AS i, * FROM (VALUES {_FK}) f(t, k, r)) g")
def catalog_er_diagram(spark, sf_dir):
    return spark.createDataFrame([(er_diagram(),)], "diagram string")


def sample(df: DataFrame, keys: tuple[str, ...], n: int = 100, seed: int = 42) -> DataFrame:
    """The same n rows each time: the least by a digest of key and seed."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))).orderBy("_h", *keys).limit(n).drop("_h")


@R.query("sample_rows", "SELECT * FROM lineitem ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), '42')), l_orderkey, l_linenumber, l_partkey LIMIT 100", sample)
def sample_rows(spark, sf_dir):
    return sample(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber", "l_partkey"))


def _sink(kind):
    def run(spark, sf_dir):
        path = f"{scratch(spark, 'sink')}.{kind}"
        if not write(spark.read.parquet(f"{sf_dir}/region.parquet"), path, kind):
            raise ValueError(kind)
        return scan(spark, path, "r_regionkey INT, r_name STRING") if kind == "csv" else spark.read.schema("r_regionkey INT, r_name STRING").json(path)

    return run


R.query("sink_csv", "SELECT r_regionkey, r_name FROM region")(_sink("csv"))
R.query("sink_json", "SELECT r_regionkey, r_name FROM region")(_sink("json"))


_REPORT = {"score": 97.5, "issues": [{"column": "c_acctbal"}]}


@R.query("sink_report_json", f"SELECT '{json.dumps(_REPORT, indent=2)}' || chr(10) AS value")
def sink_report_json(spark, sf_dir):
    path = scratch(spark, "report")
    report(spark, path, _REPORT)
    return spark.read.text(path, wholetext=True)


# fixed values: columns of a trades file
TRADE_COLUMNS = """entry_date exit_date side size entry_price exit_price pnl pnl_pct entry_notional exit_notional entry_fee exit_fee fees gross_pnl pnl_pct_basis borrow_fee margin_required
return_on_margin_pct holding_bars symbol symbol_name display_symbol lot_id trade_group_id""".split()


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def digests(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, file, sha256) of the files that were written below ``path``."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").load(f"{path}/{name}").where("length > 0")
        one = files.select(F.lit(name).alias("name"), F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.union(one)
    return out


def export_backtest(equity: DataFrame, trades: DataFrame, meta: dict, path: str) -> dict:
    """equity.csv (date, value), trades.csv (fixed columns, empty where the trades lack them) and summary.json; returns the summary."""
    have = set(trades.columns)
    _csv(equity.select("date", F.col("value").cast("double").alias("value")).orderBy("date"), f"{path}/equity.csv")
    _csv(trades.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in TRADE_COLUMNS]), f"{path}/trades.csv")
    ends = equity.agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.count("*").alias("bars")).first()
    got = trades.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("pnl") > 0).cast("long")), F.lit(0)).alias("wins")).first()
    total = None if not ends["first"] else round((ends["last"] / ends["first"] - 1) * 100, 4)
    summary = {"bars": ends["bars"], "total_return_pct": total, "trades": got["n"], "win_rate_pct": round(got["wins"] * 100 / got["n"], 4) if got["n"] else None}
    report(trades.sparkSession, f"{path}/summary.json", {"meta": meta, "summary": summary})
    return summary


def _read_back(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    out = None
    for t in tables:
        one = spark.read.csv(f"{path}/{t}", header=True).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def _backtest(d) -> tuple[str, str]:
    from ..operators.finance import fifo_sql, lots

    trades = f"SELECT CAST(symbol AS STRING) AS symbol, 'long' AS side, CAST(lot AS STRING) AS lot_id, size, entry_price, exit_price, round((exit_price - entry_price) * size, 2) AS pnl FROM ({fifo_sql(d, '(' + lots(d) + ')')}) f"
    return fx.daily(d), trades


@R.query("sink_backtest", f"SELECT 'equity.csv' AS name, count(*) AS rows FROM ({_backtest(DUCK)[0]}) e UNION ALL SELECT 'trades.csv', count(*) FROM ({_backtest(DUCK)[1]}) t", export_backtest)
def sink_backtest(spark, sf_dir):
    path = scratch(spark, "backtest")
    equity, trades = on_tables(spark, sf_dir, _backtest(SPARK)[0]), on_tables(spark, sf_dir, lambda d: _backtest(d)[1])
    export_backtest(equity, trades, {"strategy": "fifo"}, path)
    return _read_back(spark, path, ["equity.csv", "trades.csv"])


def export_event_study(prices: DataFrame, names: dict[str, tuple[str, str]], pre: str, path: str, meta: dict | None = None) -> DataFrame:
    """prices.csv, portfolio.csv, summary.json and a manifest with digests; returns the manifest's rows.

    ``prices`` has date, ticker, close and shares; ``names`` gives a ticker's name
    and tier.  Weights are of capitals on ``pre``, where both indexes are 100;
    missing closes are filled forward.
    """
    spark = prices.sparkSession
    told = spark.createDataFrame([(k, *v) for k, v in names.items()], "ticker string, name string, tier string")
    caps = prices.select("date", "ticker", "close", (F.col("close") * F.col("shares")).alias("market_cap"))
    _csv(caps.join(F.broadcast(told), "ticker", "left").select("date", "ticker", "name", "close", "market_cap", "tier").orderBy("date", "ticker"), f"{path}/prices.csv")
    # growth of each ticker against the day before, over all dates
    every = caps.select("date").distinct().crossJoin(F.broadcast(caps.select("ticker").distinct())).join(caps, ["date", "ticker"], "left")
    by = Window.partitionBy("ticker").orderBy("date")
    filled = every.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in ("close", "market_cap")})
    filled = filled.withColumn("r", F.col("close") / F.lag("close").over(by) - 1)
    weights = caps.where(F.col("date") == pre).select("ticker", F.col("market_cap").alias("base"))
    daily = filled.join(F.broadcast(weights), "ticker").groupBy("date").agg((F.sum(F.col("base") * F.coalesce("r", F.lit(0.0))) / F.sum("base")).alias("weighted"), F.avg(F.coalesce("r", F.lit(0.0))).alias("equal"), F.sum("market_cap").alias("total_market_cap"))
    order = Window.orderBy("date")  # one row a date
    grown = daily.select("date", "total_market_cap", *[F.exp(F.sum(F.log1p(c)).over(order)).alias(c) for c in ("weighted", "equal")])
    anchor = grown.where(F.col("date") == pre).select(F.col("weighted").alias("w0"), F.col("equal").alias("e0"))
    portfolio = grown.crossJoin(F.broadcast(anchor)).select("date", (F.col("weighted") / F.col("w0") * 100).alias("mcap_weighted_nav"), (F.col("equal") / F.col("e0") * 100).alias("equal_weighted_nav"), "total_market_cap")
    portfolio = cut(portfolio)
    _csv(portfolio.orderBy("date"), f"{path}/portfolio.csv")
    w = weights.agg(F.sum("base").alias("cap"), (F.sum(F.col("base") * F.col("base")) / F.pow(F.sum("base"), 2)).alias("hhi"), F.max_by("ticker", "base").alias("top"), (F.max("base") / F.sum("base") * 100).alias("share")).first()
    p = portfolio.where(F.col("date") >= pre).agg(F.max("total_market_cap").alias("peak"), F.max_by("total_market_cap", "date").alias("last"), F.max_by("mcap_weighted_nav", "date").alias("nav"), F.max_by("equal_weighted_nav", "date").alias("equal")).first()
    summary = {"pre_event_mcap": w["cap"], "peak_mcap": p["peak"], "latest_mcap": p["last"], "mcap_change_to_peak_pct": (p["peak"] / w["cap"] - 1) * 100, "mcap_change_to_latest_pct": (p["last"] / w["cap"] - 1) * 100}
    summary |= {"etf_return_total_pct": p["nav"] - 100, "equal_weighted_return_total_pct": p["equal"] - 100, "hhi": w["hhi"], "top_weight_ticker": w["top"], "top_weight_pct": w["share"], "single_stock_weight_gt_30pct": w["share"] > 30}
    report(spark, f"{path}/summary.json", {"meta": {"pre_event_date": pre, **(meta or {})}, "summary": {k: round(v, 6) if isinstance(v, float) else v for k, v in summary.items()}})
    made = cut(digests(spark, path, ["prices.csv", "portfolio.csv", "summary.json"]))
    _csv(made, f"{path}/manifest.csv")
    return made


# fixed values: columns of an event study's files
STUDY_COLUMNS = {"prices.csv": "date ticker name close market_cap tier".split(), "portfolio.csv": "date mcap_weighted_nav equal_weighted_nav total_market_cap".split()}


def validate_event_study(spark: SparkSession, path: str) -> DataFrame:
    """(rule, n) of the files that an export wrote below ``path``, held against its manifest and each other.

    Files that were changed, are missing or are not listed; columns other than the
    exporter's; values that are no finite number above zero; indexes that are not
    100 on the day of the weights; dates that are there twice; and totals that are
    not the sum of the prices' capitals.
    """
    manifest = spark.read.csv(f"{path}/manifest.csv", header=True).select("name", "file", F.col("sha256").alias("listed"))
    both = digests(spark, path, [*STUDY_COLUMNS, "summary.json"]).join(manifest, ["name", "file"], "full")
    found = {"changed files": both.where("sha256 <> listed"), "missing files": both.where("sha256 IS NULL"), "files that are not listed": both.where("listed IS NULL")}
    there = {r["name"] for r in both.where("sha256 IS NOT NULL").select("name").distinct().collect()}
    prices, portfolio = (spark.read.csv(f"{path}/{n}", header=True) if n in there else spark.createDataFrame([], ", ".join(f"{c} string" for c in cols)) for n, cols in STUDY_COLUMNS.items())
    odd = [f"{n}: {c}" for n, df in zip(STUDY_COLUMNS, (prices, portfolio)) for c in set(df.columns) ^ set(STUDY_COLUMNS[n])]
    found["columns"] = spark.createDataFrame([(x,) for x in odd], "x string")
    told = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/summary.json").collect()))
    navs = STUDY_COLUMNS["portfolio.csv"][1:3]
    numbers = portfolio.select("date", *[F.col(c).try_cast("double").alias(c) for c in STUDY_COLUMNS["portfolio.csv"][1:]])
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0) | (F.col(c) == float("inf"))
    found["no number above zero"] = numbers.where(bad(navs[0]) | bad(navs[1]))
    found["not 100 at the start"] = numbers.where((F.col("date") == told["meta"]["pre_event_date"]) & ((F.abs(F.col(navs[0]) - 100) > 1e-6) | (F.abs(F.col(navs[1]) - 100) > 1e-6)))
    found["dates there twice"] = numbers.groupBy("date").count().where("count > 1")
    capital = prices.groupBy("date").agg(F.sum(F.col("market_cap").try_cast("double")).alias("cap"), F.count("market_cap").alias("k"))
    full = capital.agg(F.max("k").alias("k")).first()["k"]
    # a day on which a price is missing carries the one before, so that only full days can be summed
    found["totals"] = numbers.join(capital.where(F.col("k") == full), "date").where(F.abs(F.col("total_market_cap") / F.col("cap") - 1) > 1e-6)
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


@R.query("sink_event_study", f"SELECT 'prices.csv' AS name, count(*) AS rows FROM ({fx.prices(DUCK)}) p UNION ALL SELECT 'portfolio.csv', count(DISTINCT date) FROM ({fx.prices(DUCK)}) q", export_event_study)
def sink_event_study(spark, sf_dir):
    from ..operators.finance import PRE

    path = scratch(spark, "event")
    prices = cut(on_tables(spark, sf_dir, fx.prices(SPARK)))
    tickers = [r[0] for r in prices.select("ticker").distinct().collect()]
    export_event_study(prices, {t: (t.title(), "core") for t in tickers}, PRE, path)
    return _read_back(spark, path, ["prices.csv", "portfolio.csv"])


@R.query("ev_validate_files", f"SELECT rule, CASE rule WHEN 'files that are not listed' THEN 1 WHEN 'no number above zero' THEN n WHEN 'dates there twice' THEN n ELSE 0 END AS n FROM (VALUES ('changed files'), ('missing files'), ('files that are not listed'), ('columns'), ('no number above zero'), ('not 100 at the start'), ('dates there twice'), ('totals')) r(rule) CROSS JOIN (SELECT count(DISTINCT date) AS n FROM ({fx.prices(DUCK)}) p WHERE substr(date, 6, 2) = '03') k")
def ev_validate_files(spark, sf_dir):
    """An export to which someone added the dates of March once more, with a value of zero."""
    from ..operators.finance import PRE

    path = scratch(spark, "event")
    prices = cut(on_tables(spark, sf_dir, fx.prices(SPARK)))
    tickers = [r[0] for r in prices.select("ticker").distinct().collect()]
    export_event_study(prices, {t: (t.title(), "core") for t in tickers}, PRE, path)
    march = spark.read.csv(f"{path}/portfolio.csv", header=True).where("substr(date, 6, 2) = '03'").withColumn("mcap_weighted_nav", F.lit(0)).coalesce(1)
    march.write.mode("append").csv(f"{path}/portfolio.csv", header=True, quote='"', escape='"')
    return validate_event_study(spark, path)


# --- sheets, local databases and encrypted exports ---

_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
MOST_ROWS = 1_048_576  # of a sheet, by its format


def _sheet_rows(raw: bytes):
    """Rows of texts of the first sheet of a workbook."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{{{_SHEET}}}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(name) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_SHEET}}}row":
                    continue
                out: dict[int, str | None] = {}
                for c in row:
                    letters = "".join(x for x in c.get("r") or "" if x.isalpha())
                    at = len(out)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    text = "".join(t.text or "" for t in c.iter() if t.tag in (f"{{{_SHEET}}}v", f"{{{_SHEET}}}t"))
                    out[at] = shared[int(text)] if c.get("t") == "s" else text or None
                row.clear()
                yield [out.get(i) for i in range(max(out, default=-1) + 1)]


def scan_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first sheet of each workbook below ``path``; its first row names the columns, which are cast to those of ``schema``.

    A sheet holds a million rows at most, so a workbook is one task.
    """
    import pandas as pd

    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                it = _sheet_rows(bytes(raw))
                head = {c: i for i, c in enumerate(next(it, []))}
                lost = [c for c in names if c not in head]
                if lost:
                    raise ValueError(f"the sheet has no column {', '.join(lost)}")
                part = [[r[head[c]] if head[c] < len(r) else None for c in names] for r in it]
                yield pd.DataFrame(part, columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    text = files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in names))
    return text.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in T._parse_datatype_string(schema).fields])


def write_sheet(df: DataFrame, path: str) -> None:
    """One workbook below ``path``, of a sheet's rows at most; more is an error, as another format is needed then."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    if df.limit(MOST_ROWS).count() >= MOST_ROWS:
        raise ValueError("a sheet holds fewer rows than this table")
    names = df.columns

    def cell(v) -> str:
        if v is None or v is pd.NaT or v != v:
            return "<c/>"
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        return f"<c><v>{v!r}</v></c>" if number else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def book(batches):
        body = io.StringIO()
        body.write(f'<worksheet xmlns="{_SHEET}"><sheetData><row>' + "".join(map(cell, names)) + "</row>")
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                body.write("<row>" + "".join(map(cell, r)) + "</row>")
        body.write("</sheetData></worksheet>")
        base, out = "http://schemas.openxmlformats.org", io.BytesIO()
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEET}" xmlns:r="{base}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", body.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], ["content"])

    made = cut(df.coalesce(1).mapInArrow(book, "content binary"))
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/sheet.xlsx")
    stream = where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    stream.write(bytearray(made.first()["content"]))
    stream.close()


def _sheet_there_and_back(spark, sf_dir):
    path = scratch(spark, "sheet")
    write_sheet(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path)
    return scan_sheet(spark, path, NATION)


R.query("scan_excel", _SAME, scan_sheet)(_sheet_there_and_back)
R.query("sink_excel", _SAME, write_sheet)(_sheet_there_and_back)


def scan_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a database file that all executors can open, by ranges of rowids, through read-only connections."""
    import sqlite3

    import pandas as pd

    name = '"' + table.replace('"', '""') + '"'
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    uri = f"file:{path}?mode=ro"
    with sqlite3.connect(uri, uri=True) as c:
        low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
    columns = ", ".join('"' + c.replace('"', '""') + '"' for c in names)

    def read(batches):
        for pdf in batches:
            with sqlite3.connect(uri, uri=True) as c:
                for a, b in zip(pdf["low"], pdf["high"]):
                    got = c.execute(f"SELECT {columns} FROM {name} WHERE rowid BETWEEN ? AND ?", (int(a), int(b)))
                    while rows := got.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)
    ranges = [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
    return spark.createDataFrame(ranges, "low long, high long").repartition(len(ranges), "low").mapInPandas(read, schema)


@R.query("scan_sqlite", _SAME, scan_sqlite)
def scan_sqlite_query(spark, sf_dir):
    import sqlite3

    path = scratch(spark, "database").removeprefix("file:") + ".db"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()]
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        c.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
    return scan_sqlite(spark, path, "nation", NATION)


# fixed value: iterations of the key derivation
ITERATIONS = 210_000


def _derived(password: str, salt: bytes) -> bytes:
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)


def write_encrypted(df: DataFrame, path: str, password: str) -> None:
    """Rows as JSON under AES-256-GCM, each with its own start value; the salt and iterations lie beside them.

    The key is derived on the driver and stands in the plan: keep event logs and
    the UI from those who may not read the rows.
    """
    import secrets

    salt = secrets.token_bytes(16)
    key = F.lit(bytearray(_derived(password, salt)))
    sealed = df.select(F.hex(F.aes_encrypt(F.to_json(F.struct(*df.columns)).cast("binary"), key, F.lit("GCM"))).alias("value"))
    sealed.write.mode("overwrite").text(f"{path}/data")
    report(df.sparkSession, f"{path}/header", {"v": 1, "iter": ITERATIONS, "salt": salt.hex()})


def read_encrypted(spark: SparkSession, path: str, password: str, schema: str) -> DataFrame:
    header = json.loads(spark.read.text(f"{path}/header", wholetext=True).first()["value"])
    key = F.lit(bytearray(_derived(password, bytes.fromhex(header["salt"]))))
    text = F.aes_decrypt(F.unhex("value"), key, F.lit("GCM")).cast("string")
    return spark.read.text(f"{path}/data").select(F.from_json(text, schema).alias("x")).select("x.*")


@R.query("sink_encrypted_catalog", _SAME, write_encrypted)
def sink_encrypted_catalog(spark, sf_dir):
    path = scratch(spark, "sealed")
    write_encrypted(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"), path, "a password")
    return read_encrypted(spark, path, "a password", NATION)
