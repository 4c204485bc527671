import math

import duckdb
import pytest

from tidewater.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def canonical(rows):
    def value(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert canonical(map(tuple, df.select(columns).collect())) == canonical(found.fetchall())
