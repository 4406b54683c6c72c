import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faceoff.operators import causal, history
from faceoff.operators.history import TEAM, Timeline
from faceoff.operators.longform import side_long
from faceoff.operators.ordering import dense_index, exact_quantiles, global_position

T0 = datetime(2025, 2, 1)


def schedule(spark):
    games = [("A", "X"), ("B", "X"), ("C", "C"), ("A", "X"), ("B", "X")]
    rows = [(i, T0 + timedelta(days=i), "X", opp, won) for i, (opp, won) in enumerate(games)]
    return spark.createDataFrame(rows, "match_id int, datetime timestamp, team1 string, team2 string, winner string")


def test_schedule_form_rest_h2h(spark):
    long = side_long(schedule(spark)).where("team = 'X'")
    form = {r["match_id"]: r["form"] for r in history.rolling_form(long).collect()}
    assert form[0] is None and form[4] == pytest.approx(0.75) and form[2] == pytest.approx(1.0)
    two = {r["match_id"]: r["form"] for r in history.rolling_form(long, 2).collect()}
    assert two[4] == pytest.approx(0.5)
    assert [r["rest_whole_days"] for r in history.rest_days(long).orderBy("match_id").collect()] == [None, 1, 1, 1, 1]
    h2h = {r["match_id"]: r for r in history.h2h_before(schedule(spark)).collect()}
    assert (h2h[3]["a_wins_before"], h2h[3]["b_wins_before"], h2h[3]["h2h_t1_win_share"]) == (0, 1, 1.0)
    assert h2h[0]["h2h_t1_win_share"] == 0.5


def test_equal_instants_do_not_see_each_other(spark):
    rows = [("X", T0, 1, 1), ("X", T0 + timedelta(days=1), 2, 0), ("X", T0 + timedelta(days=1), 3, 0)]
    long = spark.createDataFrame(rows, "team string, datetime timestamp, match_id int, win int")
    strict = {r["match_id"]: r["form"] for r in history.rolling_form_strict(long).collect()}
    plain = {r["match_id"]: r["form"] for r in history.rolling_form(long).collect()}
    assert strict == {1: 0.5, 2: 1.0, 3: 1.0} and plain[3] == 0.5


@pytest.fixture(scope="module")
def skewed(spark):
    """One team holds a third of the rows; some days are crowded, others empty."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        team = "HOT" if i % 3 == 0 else f"T{rng.randrange(12)}"
        day = rng.choice([0, 0, 0, 1, 2, 5, 9, 10, 11, 40])
        rows.append((team, T0 + timedelta(days=day, seconds=rng.randrange(86400)), i, rng.randrange(2)))
    return spark.createDataFrame(rows, "team string, datetime timestamp, match_id int, win int").cache()


SPLIT = Timeline(("team",), hot_rows=100)
FORCED = Timeline(("team",), split=True)


@pytest.mark.parametrize("line", [SPLIT, FORCED])
def test_split_windows_equal_plain_windows(skewed, line):
    def make(f):
        return {"a": F.avg("win").over(f.rows(-5, -1)), "b": F.sum("win").over(f.rows(-7, 4)),
                "c": F.lag("win", 3).over(f.ordered), "d": F.count("win").over(f.rows(1, 6))}

    plain = Timeline(("team",), split=False)
    same = [history.over_frame(skewed, x, 7, 6, make).select("match_id", "a", "b", "c", "d") for x in (plain, line)]
    assert same[0].exceptAll(same[1]).isEmpty() and same[1].count() == 900
    totals = {"s": ("sum", F.col("win")), "n": ("sum", F.lit(1)), "m": ("max", F.col("match_id"))}
    runs = [history.prior_totals(skewed, x, totals).select("match_id", "s", "n", "m") for x in (plain, line)]
    assert runs[0].exceptAll(runs[1]).isEmpty()
    streaks = [history.win_streaks(skewed, 2, x) for x in (plain, line)]
    assert streaks[0].exceptAll(streaks[1]).isEmpty() and not streaks[0].isEmpty()


def test_lineups_remember_or_forget(spark):
    five, swapped = [1, 2, 3, 4, 5], [1, 2, 3, 4, 6]
    rows = [(i, T0 + timedelta(days=i), 1, "A", x) for i, x in enumerate([five, five, None, five, swapped])]
    lu = spark.createDataFrame(rows, "match_id int, datetime timestamp, side int, team string, lineup array<int>")
    out = {r["match_id"]: (r["stability"], r["standin"]) for r in history.roster_features(lu).collect()}
    assert out == {0: (None, None), 1: (1.0, 0.0), 2: (None, None), 3: (1.0, 0.0), 4: (0.8, 0.0)}

    cols = ", ".join(f"team{n}_player{i}_id string" for n in (1, 2) for i in range(1, 6))
    data = []
    for i, x in enumerate([five, five, five, swapped, None, swapped]):
        ids = [str(v) for v in x] if x else [None] * 5
        data.append((i, T0 + timedelta(days=i), "A", "B", "A", "tier1", 2, 2, 0, *ids, *"abcde"))
    panel = causal.team_match_panel(spark.createDataFrame(
        data, "match_id int, datetime timestamp, team1 string, team2 string, winner string, tier string, games_played int, "
              f"t1_series_score int, t2_series_score int, {cols}"))
    a = panel.where("team = 'A'").orderBy("match_id").collect()
    assert [r["pre_stable_matches"] for r in a] == [0, 0, 1, 2, 0, 0]
    assert [r["roster_changed"] for r in a] == [False, False, False, True, False, False]
    assert a[3]["change_count"] == 1 and a[0]["change_count"] is None and a[5]["change_count"] is None


def test_lineups_are_read_once(spark):
    """The same features as with the unknown ones left out first, in one scan; a row without a team stays one."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    rows = [(i, T0 + timedelta(days=i // 3), 1 + i % 2, None if i % 11 == 0 else "AB"[i % 2], None if i % 4 == 0 else [i // 6, 1, 2, 3, i % 5 + 10]) for i in range(80)]
    lu = spark.createDataFrame(rows, "match_id int, datetime timestamp, side int, team string, lineup array<int>")
    counted = lu.withColumn("side", F.udf(count, "int").asNondeterministic()("side"))
    got = sorted(history.roster_features(counted).collect(), key=str)
    assert seen.value == 80 and len(got) == 80
    last, want = {}, []
    for i, _, side, team, lineup in rows:
        shared = len(set(lineup) & set(last[team])) if lineup and team in last else None
        want.append((i, side, team, None if shared is None else shared / 5, None if shared is None else float(shared <= 3)))
        if lineup:
            last[team] = lineup
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(got[0].__class__(*r)))


def test_order_statistics(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.zeros(300), [1e9]])
    df = spark.createDataFrame([("k", float(v)) for v in values], "g string, v double")
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)
    ids = dense_index(df.withColumn("id", F.monotonically_increasing_id()), "id", "i").agg(
        F.countDistinct("i").alias("n"), F.max("i").alias("m")).first()
    assert (ids["n"], ids["m"]) == (801, 800)
    ts = spark.range(50).select(F.timestamp_seconds(F.col("id") % 7 * 86400).alias("t"), "id")
    pos = [r["id"] for r in global_position(ts, "t", ["id"]).orderBy("position").collect()]
    assert pos == sorted(range(50), key=lambda i: (i % 7, i))


def test_team_key_is_default():
    assert TEAM.keys == ("team",)
