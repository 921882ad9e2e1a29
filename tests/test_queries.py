"""Every query with SQL gives DuckDB's rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronolake.queries import ORACLES, QUERIES

HOME = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{HOME}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    return str(int(v)) if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(([cell(v) for v in r] for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, HOME)
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_divergence_of_a_deleted_row(spark, con, tmp_path):
    """A null image in one half and one without fields in the other: event 97 of the log is a delete in both halves."""
    events = con.sql("select * from events order by event_id limit 200").df()
    events.loc[96, ["event_type", "ts"]] = "error", pd.Timestamp("2024-01-16 08:00:00")
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as own:
        own.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        want = own.sql(ORACLES["merge_divergence"]).df()
    got = QUERIES["merge_divergence"](spark, str(tmp_path)).toPandas()
    assert want[want.diverges].event_id.tolist().count(97) == 1 and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, HOME).count() >= 0
