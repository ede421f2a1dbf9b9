"""Feature sets against SQL where starts differ and their calendar doesn't."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as e


def test_starts_in_one_month_are_combinations_of_their_own(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    start = dt.datetime(1995, 1, 3)
    keys = [7, 204007, 408007, 408007 + 204000]  # one place, one type and one district
    orders = [one.withColumns({"o_orderkey": F.lit(k).cast("long"), "o_orderdate": F.lit(start + dt.timedelta(days=7 * min(i, 2))).cast("timestamp_ntz")}) for i, k in enumerate(keys)]
    item = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1)
    items = [item.withColumns({"l_orderkey": F.lit(k).cast("long"), "l_shipdate": F.lit(start + dt.timedelta(days=7 * min(i, 2) + 5)).cast("timestamp_ntz")}) for i, k in enumerate(keys)]
    d = str(tmp_path)
    con = duckdb.connect()
    for name, parts in (("orders", orders), ("lineitem", items), ("customer", None), ("nation", None), ("part", None)):
        rows = spark.read.parquet(f"{sf}/{name}.parquet") if parts is None else parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        rows.write.parquet(f"{d}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet/*.parquet')")
    columns = ["name", "n", "rows", "complete", "combinations"]
    got = sorted(tuple(r) for r in e.queries()["k2_feature_sets"](spark, d).select(*columns).collect())
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({e.oracle_sql()['k2_feature_sets']})").fetchall())
    assert [r[-1] for r in got] == [1, 3]
