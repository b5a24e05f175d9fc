"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerline.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    ours = queries()[name](spark, SF)
    if name not in oracle_sql():
        assert ours.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    theirs = con.execute(oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)
