import pytest
from pyspark.sql import functions as F

from faceoff.operators import clean, longform

SERIES = "match_id long, seq int, is_total boolean, datetime timestamp, tournament string, tier string, team1 string, team2 string, " \
         "score1_match double, score2_match double, games_played double, bestOf double, score1_game double, score2_game double, team1_win int"


def raw(spark):
    def s(i, seq, t2, a, b, g):
        return (i, seq, True, None, "T", "tier1", "X", t2, a, b, g, 3.0, None, None, None)

    def m(i, r1, r2, flag):
        return (i, 1, False, None, "T", "tier1", "X", "Y", None, None, None, 3.0, r1, r2, flag)

    rows = [
        s(1, 1, "Y", 2.0, 1.0, 3.0), s(1, 2, "Y", 0.0, 2.0, 2.0),          # duplicate: the first stays
        s(2, 1, "Y", None, None, None), m(2, 13.0, 5.0, 0),                # repaired by rounds, one map
        s(3, 1, "Y", None, None, 2.0), m(3, 13.0, 5.0, 1), m(3, 5.0, 13.0, 0),   # 1-1: undeterminable
        s(4, 1, None, 2.0, 0.0, 2.0),                                      # a side is missing
        s(5, 1, "Y", 2.0, 0.0, 3.0),                                       # contradicts games_played
        s(6, 1, "Y", 1.0, 1.0, 3.0), m(6, 0.0, 0.0, 1), m(6, 9.0, 9.0, 1), m(6, None, None, 0),   # flags decide 2-1
    ]
    return spark.createDataFrame(rows, SERIES)


def test_load_series(spark):
    out = {r["match_id"]: r for r in clean.load_series(raw(spark)).collect()}
    assert set(out) == {1, 2, 6}
    assert (out[1]["winner"], out[1]["t1_series_score"], out[1]["t2_series_score"]) == ("X", 2, 1)
    assert (out[2]["winner"], out[2]["t1_series_score"], out[2]["games_played"]) == ("X", 1, 1)
    assert (out[6]["winner"], out[6]["t1_series_score"], out[6]["t2_series_score"], out[6]["score1_match"]) == ("X", 2, 1, 1)
    assert clean.load_series(raw(spark)).columns == [*clean.CONTRACT_COLUMNS, "tier"]


def test_forfeits_and_winsorize(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (2, None, 0, 1), (3, 2, 0, 2), (4, 0, 0, 0)],
                               "id int, t1_series_score int, t2_series_score int, games_played int")
    assert [r["is_forfeit"] for r in clean.flag_forfeits(df).orderBy("id").collect()] == [True, True, False, False]
    w = clean.winsorize(spark.createDataFrame([(30.0,), (None,), (-1.0,)], "x double"), ["x"])
    assert [r["x"] for r in w.collect()] == [25.0, None, 0.0]


def test_trusted_maps_and_names(spark):
    df = spark.createDataFrame([(False, 13.0, 5.0, 1), (False, 13.0, 5.0, 0), (False, 9.0, 9.0, 0)],
                               "is_total boolean, score1_game double, score2_game double, team1_win int")
    assert clean.trusted_maps(df).count() == 2
    names = spark.createDataFrame([("navi ", "B", "navi ")], "team1 string, team2 string, winner string")
    assert clean.alias_names(names, {"NAVI": "Natus"}).first().asDict() == {"team1": "Natus", "team2": "B", "winner": "Natus"}


def test_one_to_one_join_fails_on_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "c")], "k int, w string")
    with pytest.raises(Exception, match="duplicate key"):
        clean.assert_one_to_one(left, right, "k").collect()


def test_first_known_value_per_column(spark):
    df = spark.createDataFrame(
        [(1, True, 5, None, 1, "s"), (1, False, 5, 10, 1, None), (1, False, 5, 11, 1, "m")],
        "match_id int, is_total boolean, datetime int, game_id int, seq int, x string")
    assert clean.lineup_of_match(df, ["x"]).first()["x"] == "m"


def test_player_long_sides_and_kast(spark):
    cols, values = [], []
    for n in (1, 2):
        for i in range(1, 6):
            cols += [f"team{n}_player{i}", *[f"team{n}_player{i}_{s}" for s in longform.STATS]]
            values += [f"P{n}{i} (R), UA" if (n, i) != (2, 5) else " ", 20.0, 10.0, None, 80.0, 77.44 if n == 1 else 0.7]
    df = spark.createDataFrame(
        [(1, 2, None, "E", "M", "tier1", "cs2", "A", "B", 13.0, 11.0, 1, *values)],
        "match_id int, game_id int, datetime timestamp, tournament string, map_name string, tier string, game string, team1 string, "
        "team2 string, score1_game double, score2_game double, team1_win int, "
        + ", ".join(f"{n} {'string' if '_' not in n[8:] else 'double'}" for n in cols))
    out = longform.player_long(df)
    assert out.count() == 9
    assert {(r["team"], r["won"]) for r in out.select("team", "won").distinct().collect()} == {("A", True), ("B", False)}
    assert out.where("slot = 1 AND team = 'A'").first()["kast"] == pytest.approx(0.7744)
    assert out.where("slot = 1 AND team = 'B'").first()["kast"] == pytest.approx(0.7)
    assert out.select(F.min("rounds")).first()[0] == 24.0
