"""Every query with an oracle equals its SQL on the smallest tables on which it has rows; EVENTIDE_SF picks another folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = os.environ.get("EVENTIDE_SF", "/root/testdata/sf0.001")
#: Queries over events with a CAR, of which the smallest tables have none.
NEEDS_CAR = {
    "event_study_by_outcome", "modeling_frame", "short_edge_frame", "walk_forward", "short_walk_forward", "tail_risk", "tail_risk_metrics", "expected_car",
    "ablation", "short_ablation", "ranking_report", "holdout_models",
}
LARGER = "/root/testdata/sf0.01" if SF.endswith("sf0.001") else SF


@pytest.fixture(scope="module")
def connections():
    out = {}
    for sf in {SF, LARGER}:
        out[sf] = duckdb.connect()
        for name in TABLES:
            out[sf].execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, connections, name):
    sf = LARGER if name in NEEDS_CAR else SF
    message, rows, _ = compare(spark, connections[sf], sf, entry.queries()[name], entry.oracle_sql()[name])
    assert message == "ok" and rows > 0, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_rows(spark):
    assert entry.entry(spark).count() == 2
