"""The registered queries against their check SQL on the smallest data."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry
from faceoff.plans import catalog
from faceoff.sources.derived import TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["load_series", "monthly_upsets", "form_lag3", "win_streaks", "elo_replay", "build_features", "drift_by_month",
          "team_match_panel", "nearest_control_greedy", "did_estimate", "player_aggregates", "edge_scan", "resolve_names"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canon(rows, columns):
    def cell(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted([tuple(cell(r[c]) for c in columns) for r in rows], key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    got = [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]
    result = duck.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert canon(got, columns) == canon(want, columns)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 190


def test_contest_queries_without_the_training_data_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("faceoff.llm.")] + ["faceoff.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
