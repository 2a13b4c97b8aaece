"""Queries against their SQL on small tables with what only larger ones have: repeated names, long numbers, ties that rounding makes."""

from datetime import datetime

import duckdb
import pyarrow as pa

from provena.plans import QUERIES


def differing(spark, folder, name, **tables):
    """Rows of the query and of its SQL that the other lacks."""
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for t, rows in tables.items():
        con.register("given", rows)
        con.sql(f"copy given to '{folder}/{t}.parquet'")
        con.unregister("given")
        con.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    query(spark, str(folder)).write.parquet(f"{folder}/out")
    con.execute(f"create table want as {sql}")
    columns = ", ".join(f'"{r[0]}"' for r in con.execute("describe want").fetchall())
    con.execute(f"create table got as select {columns} from '{folder}/out/*.parquet'")
    assert con.execute("select count(*) from want").fetchall()[0][0]
    return [con.execute(f"from {a} except all from {b}").fetchall() for a, b in (("got", "want"), ("want", "got"))]


def test_entity_ladder_with_repeated_names_and_long_numbers(spark, tmp_path):
    keys = [*range(0, 1001, 50), *range(50_000, 50_301, 50), 1_000_000]
    names = [f"Customer#{k % 15_000:09d}" for k in keys] + [f"Customer#{0:09d}"] * 10
    keys += [15_000 * i for i in range(1, 11)]  # more hits a term than a caller of one term is shown
    customer = pa.table({"c_custkey": keys, "c_name": names})
    supplier = pa.table({"s_suppkey": list(range(1100)), "s_name": [f"Supplier#{k:09d}" for k in range(1100)]})
    assert differing(spark, tmp_path, "entity_ladder", customer=customer, supplier=supplier) == [[], []]


def test_reconciled_accounts_with_equal_gaps_at_the_cut(spark, tmp_path):
    noise = lambda price, gap: abs(price - (price + gap))
    gap = 44_900.0 + 1996
    prices = sorted((noise(p / 100, gap), p / 100) for p in range(10_000_001, 10_000_200))
    assert prices[0][0] < prices[-1][0]
    # nine worse ones, then two of the same gap, of which the smaller key counts
    rows = [(45_000 + 5 * i, 2001, 50.25) for i in range(9)] + [(44_895, 2001, prices[0][1]), (44_900, 1996, prices[-1][1]), (50_000, 1998, None), (3, 1998, 20.5)]
    orders = pa.table({"o_custkey": [k for k, _, _ in rows], "o_totalprice": [p for _, _, p in rows], "o_orderdate": [datetime(y, 5, 5) for _, y, _ in rows]})
    assert differing(spark, tmp_path, "reconciled_accounts", orders=orders) == [[], []]


def test_strictly_increasing_without_ids_and_before_1970(spark, tmp_path):
    rows = [(None, datetime(2024, 1, 1, 9), 1), (5, datetime(2024, 1, 1, 4), 1), (4, datetime(2024, 1, 1, 4), 1), (1, datetime(1969, 12, 31, 22, 30), 2), (2, datetime(1969, 12, 30, 1, 1, 1, 1), 2), (3, None, 2), (4, datetime(1970, 1, 1, 5), 2)]
    events = pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": [r[1] for r in rows], "user_id": [r[2] for r in rows]})
    assert differing(spark, tmp_path, "strictly_increasing", events=events) == [[], []]
