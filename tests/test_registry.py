"""Every query runs on the smallest tables, and the SQL of each has its query."""

import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(value):
    if value is None:
        return "-"
    if isinstance(value, float):
        return repr(round(value, 8) + 0.0)
    return str(value)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    sql = __spark_entry__.oracle_sql().get(name)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    if sql is None:
        # what these hold is checked against brute force and against each other elsewhere; no case comes twice
        assert rows
        assert not name.endswith("_found") or len(set(rows)) == len(rows)
        return
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[k]) for k in order) for r in out.fetchall()) == rows


def test_all_matches_hold_the_query_set(spark):
    q = __spark_entry__.queries()
    some = {tuple(r) for r in q["library_matches"](spark, SMALL).collect()}
    all_ = {tuple(r) for r in q["library_all_matches"](spark, SMALL).collect()}
    assert some == {r for r in all_ if r[0] % 50 == 0}
    assert len(all_) > 10 * len(some)


def test_values_of_split_fields(spark):
    """Positions count from 1 without gaps, and the fields with several values are those of all fields."""
    q = __spark_entry__.queries()
    found, all_ = ({(r.src, r.row_id, r.pos): r.value for r in q[n](spark, SMALL).collect()} for n in ("p4_found", "p4_values"))
    assert found.items() <= all_.items()
    several = {k[:2] for k in all_ if k[2] == 2}
    assert {k[:2] for k in found} == several
    for src, row, pos in all_:
        assert pos == 1 or (src, row, pos - 1) in all_
        assert all_[src, row, pos] == all_[src, row, pos].strip() != ""
