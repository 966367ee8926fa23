"""The gateway's shapes, partitions and filters, on recorded responses."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.sources import gateway as gw

ROWS = [(s, f"2024-{m:02d}-{d:02d}", float(m * 100 + d), float(d)) for s in ("AA", "BB", "C.X") for m in (1, 2, 3, 12) for d in (1, 15, 28)]


def test_payload_shapes():
    rows = [{"date": "2024-01-02", "close": "1.5"}]
    assert list(gw.payloads({"result": {"data_preview": "date,close\n2024-01-02,1.5"}})) == [rows]
    assert list(gw.payloads({"result": {"content": [{"type": "text", "text": '[{"date": "2024-01-02", "close": "1.5"}]'}, {"text": ""}]}})) == [rows]
    assert list(gw.payloads({"result": {"content": [{"text": "date,close\n2024-01-02,1.5\n"}]}})) == [rows]
    assert list(gw.payloads({"code": 0, "data": {"fields": ["date", "close"], "items": [["2024-01-02", "1.5"]]}})) == [rows]
    assert list(gw.payloads({"result": rows})) == [rows] and list(gw.payloads({})) == []
    for bad in ({"error": {"code": -1}}, {"code": 40203, "msg": "too often"}):
        with pytest.raises(RuntimeError):
            list(gw.payloads(bad))


def test_months_of_a_span():
    d = datetime.date
    assert list(gw.months(d(2023, 12, 30), d(2024, 2, 1))) == [(d(2023, 12, 30), d(2023, 12, 31)), (d(2024, 1, 1), d(2024, 1, 31)), (d(2024, 2, 1), d(2024, 2, 1))]
    assert list(gw.months(d(2024, 1, 2), d(2024, 1, 1))) == []


@pytest.mark.parametrize("kind", ["gateway", "tushare"])
def test_scan_is_parallel_and_filters_reach_it(spark, tmp_path, kind):
    path = str(tmp_path / "rec")
    gw.record(spark.createDataFrame(ROWS, "symbol string, day string, close double, volume double"), kind, path)
    symbol, day, _ = gw.SHAPES[kind]
    df = gw.scan(spark, kind, ["AA", "BB", "C.X"], "2024-01-01", "2024-12-31", transport="millrace.sources.gateway:recorded", path=path)
    assert sorted(map(tuple, df.collect())) == sorted(ROWS)
    assert df.rdd.getNumPartitions() == 36
    some = df.where((F.col(symbol) == "BB") & (F.col(day) > "2024-02-10") & (F.col(day) <= "2024-03-15"))
    assert sorted(map(tuple, some.collect())) == [r for r in ROWS if r[0] == "BB" and "2024-02-10" < r[1] <= "2024-03-15"]
    assert some.rdd.getNumPartitions() == 2
    assert df.where(F.col(symbol).isin("AA", "ZZ") & (F.col(day) == "2024-12-28")).count() == 1
    assert df.where(F.col(symbol) == "nobody").count() == 0
    other = spark.read.format(kind).schema(f"{day} string, close long").options(symbols="AA", start="2024-01-01", end="2024-01-20", transport="millrace.sources.gateway:recorded", path=path)
    assert sorted(map(tuple, other.load().collect())) == [("2024-01-01", 101), ("2024-01-15", 115)]
