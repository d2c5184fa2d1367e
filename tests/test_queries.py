"""Every registered query of the engine against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from quarry.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    got = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(normal(v) for v in r) for r in expected.select(*[f'"{c}"' for c in order]).fetchall())
    assert got == want
    assert got


def test_recall_grows_with_probes(spark, sf_dir):
    found = {r["nprobe"]: r["recall"] for r in QUERIES["q_recall"](spark, sf_dir).collect()}
    assert found[1] <= found[4] <= found[10] == 1.0
