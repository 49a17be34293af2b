"""Every registered query against its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import cartulary.plans.catalogue_flows
import cartulary.plans.catalogue_graphs
import cartulary.plans.catalogue_io
import cartulary.plans.catalogue_more  # noqa: F401
from cartulary.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(found.fetchall(), columns)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_seeded_split(spark):
    one = QUERIES["q_seeded_split"](spark, SF).collect()
    assert one == QUERIES["q_seeded_split"](spark, SF).collect()
    assert {r.train for r in one} == {True, False}


def test_entry_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_accepted_records_by_flag(spark, tmp_path):
    """Line items that differ by their flag only are two records, as in SQL."""
    con = duckdb.connect()
    con.execute("create table lineitem as select * from (values (1::bigint, 1, 5::bigint, 9::bigint, 2.5::double, 'A'), (1, 1, 5, 9, 2.5, 'R'), (1, 1, 5, 9, 2.5, 'R'), (2, 1, 6, 9, 3.5, 'N'), (2, 1, 6, 8, 4.5, 'N')) v(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    found = con.execute(ORACLE["q_accept_records"])
    df = QUERIES["q_accept_records"](spark, str(tmp_path)).select([c[0] for c in found.description])
    want = found.fetchall()
    assert len(want) == 4
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
