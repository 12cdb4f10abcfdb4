"""The alert files that ``scan_alerts`` reads."""

from __future__ import annotations

import datetime

from perfsieve.plans import proxies as P
from perfsieve.plans import summary_queries
from perfsieve.sources import files


def test_alert_files_are_packed(spark, tmp_path, monkeypatch):
    day = datetime.datetime(2024, 1, 2)
    lines = [(i // 2, i, i + 3, i % 7 + 1, 40.0 + i, 10.5, 0.05, 0.01, "R", "F", day) for i in range(40)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(i, i * 3, day, "1-URGENT") for i in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    read, paths = files.read_alerts, []
    monkeypatch.setattr(files, "read_alerts", lambda s, path: paths.append(path) or read(s, path))
    found = summary_queries.scan_alerts(spark, str(tmp_path))
    assert found.count() == 40
    names = [r["path"] for r in files.file_listing(spark, paths[0], "part-*").select("path").collect()]
    assert names and all(n.endswith(".csv.gz") for n in names)
    wanted = {r["seq"] for r in P.alerts(spark, str(tmp_path), ["seq"]).collect()}
    assert {r["seq"] for r in found.collect()} == wanted
