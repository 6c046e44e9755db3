"""The scan query against its SQL on flows whose made-up client ports are ports on which QUIC is looked for."""

import datetime as dt

import duckdb

import __spark_entry__


def test_client_ports_do_not_count(spark, tmp_path):
    users = [0, 1, 6890, 7443, 7853, 10443, -147, -557]
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i), u, kind, 50.0) for i, (u, kind) in enumerate((u, k) for u in users for k in ("signup", "click", "view", "error", "other"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["q_scan_filter_project"]).fetchall()
    got = __spark_entry__.queries()["q_scan_filter_project"](spark, str(tmp_path)).collect()
    assert len(want) == 10 and sorted(map(tuple, got)) == sorted(want)
