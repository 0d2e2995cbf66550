"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from veilframe.plans import catalogue, plugged, whole

SF = "/root/testdata/sf0.001"
QUERIES = {**catalogue.QUERIES, **whole.QUERIES, **plugged.QUERIES}
ORACLE_SQL = {**catalogue.ORACLE_SQL, **whole.ORACLE_SQL, **plugged.ORACLE_SQL}


def plain(x):
    return round(float(x), 6) if isinstance(x, float | decimal.Decimal) else x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert got == sorted(str([plain(x) for x in r]) for r in want)
