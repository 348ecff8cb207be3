"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from driftlens import catalog, tables  # noqa: F401  (tables adds queries)

SF = "/root/testdata/sf0.001"


def shown(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    assert shown(catalog.QUERIES[name](spark, SF).toPandas()) == shown(duck.sql(catalog.ORACLE_SQL[name]).df())
