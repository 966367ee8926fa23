"""Tables behind a gateway, as a Spark data source in Python.

A request is made for each symbol and month, so that a scan is as parallel as it
has such partitions.  Filters on the symbol and the date reach the source: they
leave out partitions and narrow the span that is asked for.  The transport is a
function from a request to a response, named by an option, and so replaceable;
responses are read in the shapes such services give: rows of JSON, previews of
CSV, and tables of fields and items.
"""

from __future__ import annotations

import csv
import importlib
import io
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..plans.dialect import Registry, on_tables
from ..session import scratch

R = Registry()

# fixed values: columns of the services' daily tables
SHAPES = {"gateway": ("ticker", "date", "ticker string, date string, close double, volume double"), "tushare": ("ts_code", "trade_date", "ts_code string, trade_date string, close double, vol double")}


def rpc(tool: str, symbol: str, start: str, end: str) -> dict:
    return {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": {"ticker": symbol, "start_date": start, "end_date": end}}}


def table_request(api: str, symbol: str, start: str, end: str) -> dict:
    return {"api_name": api, "params": {"ts_code": symbol, "start_date": start.replace("-", ""), "end_date": end.replace("-", "")}, "fields": ""}


def http(options: dict) -> Callable[[dict], dict]:
    """Posts requests as JSON to ``url``, with a ``token`` if one is given."""

    def send(request: dict) -> dict:
        body = request | ({"token": options["token"]} if options.get("token") else {})
        call = urllib.request.Request(options["url"], json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"})
        with urllib.request.urlopen(call, timeout=float(options.get("timeout", 120))) as r:
            return json.load(r)

    return send


def recorded(options: dict) -> Callable[[dict], dict]:
    """Replays responses recorded below ``path`` as symbol=.../month=.../ files; a request without one has no rows."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(options["path"] if "://" in options["path"] else f"file://{options['path']}")

    def send(request: dict) -> dict:
        args = request["params"].get("arguments", request["params"])
        symbol, start = args.get("ticker") or args["ts_code"], args["start_date"].replace("-", "")
        found = [f for f in store.get_file_info(fs.FileSelector(f"{root}/symbol={symbol}/month={start[:4]}-{start[4:6]}", allow_not_found=True)) if f.base_name.startswith("part-")]
        for f in found:
            with store.open_input_stream(f.path) as s:
                return json.loads(s.read())
        return {"result": {}}

    return send


def payloads(response: dict) -> Iterator[list[dict]]:
    """Rows of a response, whatever its shape; an error of the service is raised."""
    if response.get("error") or response.get("code"):
        raise RuntimeError(f"the service answers with an error: {response.get('error') or response.get('msg')}")
    if isinstance(data := response.get("data"), dict):
        yield [dict(zip(data.get("fields", []), item)) for item in data.get("items", [])]
    result = response.get("result", {})
    found = [result] if isinstance(result, list) else []
    if isinstance(result, dict):
        found = [x for x in [result.get("data_preview"), *(c.get("text") for c in result.get("content", []))] if x]
    for x in found:
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except json.JSONDecodeError:
                yield list(csv.DictReader(io.StringIO(x)))
                continue
        yield x if isinstance(x, list) else x.get("rows", [x])


def months(start: date, end: date) -> Iterator[tuple[date, date]]:
    """The parts of a span that lie in one month."""
    while start <= end:
        ahead = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        yield start, min(end, ahead - timedelta(days=1))
        start = ahead


def _whole(x) -> int:
    return int(float(x))


@dataclass
class Span(InputPartition):
    symbol: str
    start: str
    end: str


class GatewayReader(DataSourceReader):
    def __init__(self, kind: str, schema: T.StructType, options: dict):
        self.kind, self.schema, self.options = kind, schema, options
        self.symbol, self.day, _ = SHAPES[kind]
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])

    def _date(self, text: str) -> date | None:
        try:
            return date.fromisoformat(text)
        except ValueError:
            return None

    def pushFilters(self, filters):  # noqa: N802
        """Bounds on the date narrow the span, and values of the symbol the requests; Spark applies all filters once more."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == (self.symbol,) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
            elif at == (self.day,) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and (day := self._date(f.value)):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, day)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.end = min(self.end, day)
            yield f

    def partitions(self):
        return [Span(s, a.isoformat(), b.isoformat()) for s in self.symbols for a, b in months(self.start, self.end)] or [Span("", "", "")]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.symbol:
            return
        module, _, name = self.options.get("transport", f"{__name__}:http").partition(":")
        send = getattr(importlib.import_module(module), name)(self.options)
        make = rpc if self.kind == "gateway" else table_request
        casts = [(f.name, float if isinstance(f.dataType, T.DoubleType) else _whole if isinstance(f.dataType, T.LongType | T.IntegerType) else str) for f in self.schema.fields]
        for rows in payloads(send(make(self.options.get("tool", "daily"), partition.symbol, partition.start, partition.end))):
            for row in rows:
                got = {str(k).strip(): v for k, v in row.items()}
                got.setdefault(self.symbol, partition.symbol)
                day = str(got.get(self.day, ""))
                got[self.day] = day = f"{day[:4]}-{day[4:6]}-{day[6:]}" if len(day) == 8 and day.isdigit() else day
                if partition.start <= day <= partition.end:
                    yield tuple(None if got.get(n) in (None, "") else cast(got[n]) for n, cast in casts)


class Gateway(DataSource):
    """``spark.read.format("gateway")`` with options symbols, start, end, tool, and url or transport."""

    kind = "gateway"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SHAPES[self.kind][2]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GatewayReader(self.kind, schema, dict(self.options))


class Tushare(Gateway):
    kind = "tushare"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Gateway, Tushare):
        spark.dataSource.register(source)


def scan(spark: SparkSession, kind: str, symbols: list[str], start: str, end: str, **options: str) -> DataFrame:
    """A service's daily table of some symbols over a span of days, both ends included."""
    register(spark)
    return spark.read.format(kind).options(symbols=",".join(symbols), start=start, end=end, **options).load()


def record(rows: DataFrame, kind: str, path: str) -> None:
    """Writes rows (symbol, day, close, volume) as the responses a service would give, one file a symbol and month: even months as rows of JSON, odd ones as a preview of CSV, or as fields and items."""
    symbol, day, _ = SHAPES[kind]
    month = rows.withColumn("month", F.substring("day", 1, 7))
    last = "vol" if kind == "tushare" else "volume"
    if kind == "tushare":
        item = F.array(F.to_json(F.array("symbol")).substr(F.lit(2), F.length("symbol") + 2), F.concat(F.lit('"'), F.regexp_replace("day", "-", ""), F.lit('"')), F.col("close").cast("string"), F.col("volume").cast("string"))
        body = F.concat(F.lit(f'{{"code":0,"data":{{"fields":["{symbol}","{day}","close","{last}"],"items":['), F.array_join(F.collect_list(F.concat(F.lit("["), F.array_join(item, ","), F.lit("]"))), ","), F.lit("]}}"))
        told = month.groupBy("symbol", "month").agg(body.alias("value"))
    else:
        line = F.concat_ws(",", "symbol", "day", "close", "volume")
        text = F.concat(F.lit(f"{symbol},{day},close,{last}\n"), F.array_join(F.collect_list(line), "\n"))
        listed = F.to_json(F.collect_list(F.struct(F.col("symbol").alias(symbol), F.col("day").alias(day), F.col("close"), F.col("volume").alias(last))))
        both = month.groupBy("symbol", "month").agg(text.alias("text"), listed.alias("listed"))
        preview = F.to_json(F.struct(F.struct(F.col("text").alias("data_preview")).alias("result")))
        content = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("listed").alias("text"))).alias("content")).alias("result")))
        told = both.select("symbol", "month", F.when(F.col("month").substr(7, 1).cast("int") % 2 == 1, preview).otherwise(content).alias("value"))
    told.repartition("symbol", "month").write.partitionBy("symbol", "month").text(path)


DAILY = "SELECT o_orderpriority AS symbol, date_format(o_orderdate, 'yyyy-MM-dd') AS day, max(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"
#: The oracle asks the orders themselves.
_ORDERS = "SELECT replace(o_orderpriority, ' ', '_') AS {s}, strftime(o_orderdate, '%Y-%m-%d') AS {d}, max(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS {v} FROM orders WHERE o_orderdate >= DATE '1995-02-15' AND o_orderdate <= DATE '2001-06-20' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2"


def _replayed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All orders recorded as a service's responses, and a span of some symbols scanned from them."""
    path, (symbol, day, _) = scratch(spark, kind), SHAPES[kind]
    rows = on_tables(spark, sf_dir, DAILY).withColumn("symbol", F.regexp_replace("symbol", " ", "_"))
    record(rows, kind, path)
    # one symbol for each priority of an order
    found = rows.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).collect()
    symbols = sorted(r["symbol"] for r in found)
    told = scan(spark, kind, symbols, min(r["lo"] for r in found), max(r["hi"] for r in found), transport=f"{__name__}:recorded", path=path)
    return told.where((F.col(day) >= "1995-02-15") & (F.col(day) <= "2001-06-20") & F.col(symbol).isin([s for s in symbols if s != "5-LOW"]))


@R.query("scan_gateway", _ORDERS.format(s="ticker", d="date", v="volume"))
def scan_gateway(spark, sf_dir):
    return _replayed(spark, sf_dir, "gateway")


@R.query("scan_tushare", _ORDERS.format(s="ts_code", d="trade_date", v="vol"))
def scan_tushare(spark, sf_dir):
    return _replayed(spark, sf_dir, "tushare")
