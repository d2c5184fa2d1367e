from pathlib import Path

import duckdb
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = QUERIES[name](spark, sf_dir)
    want = c.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[x] for x in order) for r in df.collect()), key=key) == sorted(want.select(*order).fetchall(), key=key)
