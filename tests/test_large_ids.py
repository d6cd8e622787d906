"""Queries against their SQL on ids that only large tables have."""

import duckdb

from provmill.plans.queries import ORACLE_SQL, QUERIES


def test_years_of_five_digits(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select unnest([0, 99999, 2930719, 2930720, 5999999])::bigint as event_id) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = {tuple(r) for r in QUERIES["fn_18_utc_text"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(ORACLE_SQL["fn_18_utc_text"]).fetchall())
    assert any(ts.startswith("+1") for _, ts in got)
