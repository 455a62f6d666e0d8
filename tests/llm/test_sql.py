"""Every operator that SQL expresses against its SQL, on the given tables and on a small one with links."""

import duckdb
import pytest

from terravane.llm import registry

from . import fixtures

DATA = "/root/testdata/sf0.01"


def compare(spark, name, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'' if sf_dir == DATA else '/*.parquet'}')")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = ",".join(sorted(df.columns))
    got = sorted(map(tuple, df.selectExpr(*cols.split(",")).collect()))
    assert got == sorted(c.sql(f"select {cols} from ({registry.ORACLES[name]})").fetchall())
    return got


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_given_tables(spark, name):
    assert compare(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_small_tables(spark, name, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, [1.0, 0.01 * i, *[0.0] * 6], i % 4 or None) for i in range(60)] + [(60, None, 1), (61, [0.0] * 8, 2), (62, [float("nan"), *[1.0] * 7], 3), (63, [None, *[1.0] * 7], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(compare(spark, name, str(tmp_path))) > 40
