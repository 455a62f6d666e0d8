"""Every registered query outside llm against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from terravane import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in registry.ORACLES:
        assert len(cols) > 0
        return
    got = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == cols
    quoted = ",".join(f'"{c}"' for c in cols)
    assert rows == sorted(tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({registry.ORACLES[name]})").fetchall())
