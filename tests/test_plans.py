"""Plan shapes: no nested loops, no single-task windows over rows, the expected shuffles."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faceoff.operators import clean, evaluate, features, history, names, players, teams
from faceoff.operators.history import Timeline
from faceoff.operators.longform import side_long


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def matches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "matches")
    rows = [(i, datetime(2024, 1, 1 + i % 28), "T", f"t{i % 7}", f"t{(i + 1) % 7}", f"t{i % 7}", 2, 1, 3, 3, "tier1", 0.5, 1500.0, 1500.0, 1.0) for i in range(200)]
    spark.createDataFrame(rows, "match_id long, datetime timestamp, tournament string, team1 string, team2 string, winner string, t1_series_score long, "
                                "t2_series_score long, games_played long, bestOf long, tier string, p_t1 double, elo_t1_pre double, elo_t2_pre double, "
                                "result double").write.parquet(path)
    return spark.read.parquet(path)


def test_history_needs_one_exchange(matches):
    long = side_long(matches)
    for df in (history.form_lag3(long), history.rolling_form(long), history.rest_days(long), history.h2h_before(matches),
               features.form_and_rest(long)):
        text = plan(df)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1, text
        assert "SinglePartition" not in text and "NestedLoop" not in text


def test_streaks_and_panel_reuse_the_team_partitioning(matches):
    text = plan(history.win_streaks(side_long(matches)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1, text


def test_scans_are_pruned_and_filters_pushed(spark, matches):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(clean.window_filter(matches, start="2024-01-05", tiers=["tier1"]).select("match_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(datetime" in pushed and "EqualTo(tier,tier1)" in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "winner" not in schema and "games_played" not in schema


def test_keep_first_is_combined_before_the_shuffle(matches):
    text = plan(clean.keep_first(matches, ["match_id"], ["datetime"]))
    assert "Window" not in text and text.count("Aggregate") >= 2


def test_no_nested_loops(spark, matches):
    people = spark.createDataFrame([("A (B), UA",)], "player string")
    asks = spark.createDataFrame([("a",)], "request string")
    frames = [
        teams.winner_month_share(matches), teams.only_active(matches, 3), teams.pair_record(side_long(matches)),
        names.resolve_names(asks, people),
        evaluate.ece(matches.withColumn("p", F.col("p_t1")).withColumn("y", F.col("result")), ["tier"]),
        players.asof_tenure(
            side_long(matches).select("match_id", "datetime", "side", "team", F.lit("x").alias("player")),
            side_long(matches).select("team", F.lit("x").alias("player"), F.col("datetime").alias("date"))),
    ]
    for df in frames:
        text = plan(df)
        loops = [line for line in text.splitlines() if "NestedLoopJoin" in line or "CartesianProduct" in line]
        # the only allowed ones join a one-row frame (collected request lengths)
        assert all("BuildRight" in line and "Cross" in line for line in loops), loops
    assert not any("CartesianProduct" in plan(f) for f in frames)


def test_split_path_orders_only_day_summaries_per_team(matches):
    text = plan(history.rolling_form(side_long(matches), line=Timeline(("team",), hot_rows=10)))
    windows = [line for line in text.splitlines() if re.search(r"Window \[", line)]
    by_team_only = [line for line in windows if re.search(r"\], \[team#\d+\], \[_chunk", line)]
    assert by_team_only and len(by_team_only) < len(windows)
    assert not any(re.search(r"\], \[team#\d+\], \[datetime", line) for line in windows)


def test_wide_rows_are_projections_of_narrow_stored_tables(spark):
    from faceoff.plans.registry import Contests
    from faceoff.sources import derived

    folder = "/root/testdata/sf0.001"
    c = Contests(spark, folder)
    for name in ("map_rows", "series_rows"):
        got, want = getattr(c, name)(), derived.derive(spark, folder, name)
        assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        plan = got.select("match_id", "team1_player1_kills")._jdf.queryExecution().executedPlan().toString()
        assert "kills" not in plan.split("ReadSchema")[-1]
    assert len(c.maps().columns) < 30
    met = derived.lines_met(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert met.count("Exchange hashpartitioning(") + met.count("Exchange rangepartitioning(") == 1


def test_names_are_resolved_without_the_rows_per_player_and_map(spark, monkeypatch):
    from faceoff.plans import queries_players
    from faceoff.plans.catalog import QUERIES

    def stop(*_):
        raise AssertionError("player rows were built")

    monkeypatch.setattr(queries_players.longform, "player_long", stop)
    monkeypatch.setattr(queries_players.Contests, "_written", {})
    assert QUERIES["resolve_names"](spark, "/root/testdata/sf0.001").count() > 1000


def test_player_rows_of_the_block_source_are_grouped_where_they_are_made(spark):
    from faceoff.plans import queries_players
    from faceoff.plans.registry import Contests

    people, _ = queries_players.block_source(Contests(spark, "/root/testdata/sf0.001"))
    plan = people._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.index("Exchange hashpartitioning(") > plan.rindex("Generate")
