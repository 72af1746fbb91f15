"""The queries against their SQL."""

import duckdb
import pytest

from rowsense.plans import evaluation_queries, note_queries, queries, safety_queries  # noqa: F401
from rowsense.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple(str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = rows(got.select(*columns).collect())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("part", "customer", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "supplier", "nation", "region"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert mine == rows(con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    else:
        assert mine
