"""Headline timings: one JSON line on stdout.

The contest tables are derived from all rows of $BENCH_SF_DIR and stored as parquet first (timed
as ``derive_tables``); every query then runs from those tables into a no-op sink, the best of two
runs. Teams are customers, so the number of histories grows with the data.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from faceoff.operators import causal, clean, evaluate, features, history, rating, teams  # noqa: E402
from faceoff.operators.longform import side_long  # noqa: E402
from faceoff.plans.registry import Contests  # noqa: E402
from faceoff.session import build_session, write_and_reread  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
NUMERIC = ["elo_diff", "form5_diff", "rest_days_diff", "h2h_t1_win_share", "roster_stability_diff", "standin_diff", "bo1_elo"]


def copies(long: DataFrame, rows: int, have: int) -> DataFrame:
    """At least ``rows`` history rows: whole copies with their own teams."""
    n = -(-rows // have)
    return long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "team", F.concat_ws("#", "team", F.col("copy").cast("string"))).drop("copy")


def main() -> None:
    spark = build_session(CORES, app="faceoff-bench")
    c = Contests(spark, FOLDER, by_customer=True)
    seconds: dict[str, float] = {}

    start = time.time()
    c.map_rows(), c.series_rows()
    seconds["derive_tables"] = round(time.time() - start, 3)
    raw, matches, long = c.raw(), c.matches(), c.long()
    maps = rating.map_results(c.map_rows()).select(
        "match_id", "game_id", "datetime", "map_name", "team1", "team2", "result")
    replay = c.replay()
    lineups = features.first_lineups(c.series_rows())
    store = c.stored("features", lambda: features.build_features(replay, lineups))
    have = long.count()
    small, large = (write_and_reread(copies(long, n, have), "bench-long") for n in (100_000, 500_000))
    published = write_and_reread(long.orderBy("datetime", "match_id", "team").limit(22_104), "bench-long")      # the published size
    panel_rows = Contests(spark, FOLDER)
    nation_matches = panel_rows.stored("with_lineups", lambda: clean.assert_one_to_one(panel_rows.matches(), clean.lineup_of_match(
        panel_rows.raw(), [f"team{n}_player{i}_id" for n in (1, 2) for i in range(1, 6)]), "match_id", "left"))
    panel = panel_rows.stored("panel", lambda: causal.team_match_panel(nation_matches))
    windows = panel_rows.stored("windows", lambda: causal.event_windows(panel))
    controls = causal.eligible_controls(panel)
    paired = panel_rows.stored("paired", lambda: windows.unionByName(causal._window_rows(
        controls.select("team", "pos", F.concat_ws("#", "team", F.col("match_id").cast("string")).alias("event_id")), panel, 5, 5,
        ["event_id"]).withColumns({"treated": F.lit(0), "post": (F.col("relative_match") >= 0).cast("int"), "event_team": F.col("team")})))

    runs = {
        "load_series": lambda: clean.load_series(raw),
        "monthly_upsets": lambda: teams.monthly_upsets(matches),
        "form_lag3": lambda: history.form_lag3(long),
        "win_streaks": lambda: history.win_streaks(long),
        "rolling_form": lambda: history.rolling_form(long),
        "rolling_form_22k": lambda: history.rolling_form(published),
        "rolling_form_100k": lambda: history.rolling_form(small),
        "rolling_form_500k": lambda: history.rolling_form(large),
        "rest_days": lambda: history.rest_days(long),
        "h2h_before": lambda: history.h2h_before(matches),
        "roster_features": lambda: history.roster_features(lineups),
        "elo_replay": lambda: rating.elo_replay(rating.one_pool(matches), ["pool"]),
        "elo_by_map": lambda: rating.elo_replay(maps, ["map_name"], order=("datetime", "match_id", "game_id")),
        "build_features": lambda: features.build_features(replay, lineups),
        "drift_by_month": lambda: evaluate.drift_by_month(store, NUMERIC, "2000-01-01"),
        "team_match_panel": lambda: causal.team_match_panel(nation_matches),
        "nearest_control_greedy": lambda: causal.nearest_control_greedy(windows.where("relative_match = 0"), controls),
        "bootstrap_did": lambda: causal.bootstrap_did(paired, cluster="team", n_boot=2000),
    }
    for name, build in runs.items():
        best = None
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": FOLDER.rstrip("/").split("/")[-1].removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
