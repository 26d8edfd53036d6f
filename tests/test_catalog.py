"""Registered queries against their SQL, and the driver contract."""

import os
import pathlib

import pandas as pd
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, differences

DATA = pathlib.Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
SAMPLE = [
    "returns", "macd", "cross_asset", "sentiment_windows", "lexicon_sentiment", "daily_rank_ic", "newey_west",
    "embargoed_folds", "quality_gate", "drift_report", "trade_costs", "period_returns", "cash_weights", "order_fills",
    "signal_log_chain", "lead_screen", "stream_tick_bars",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("PANELARK_ALL_QUERIES") else SAMPLE


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.FLAGSHIP in contract.queries()


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = contract.queries()[name](spark, str(DATA))
    have = pd.DataFrame(df.collect(), columns=df.columns)
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.sql(contract.oracle_sql()[name])
    want = pd.DataFrame(result.fetchall(), columns=result.columns)
    assert differences(have, want) == ""
