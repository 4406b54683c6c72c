import re

import pytest

from faceoff.operators import names
from faceoff.sources import adapters, files, games, text

STAT = ("kills", "deaths", "assists", "adr", "kast")


def test_block_source_chooses_the_block_by_name(spark):
    cols = "match_id int, seq int, team string, player_name string, country string, date string, event_name string, best_of int, map_1 string, map_2 string, map_3 string, " \
        + ", ".join(f"m{i}_{s} double" for i in (1, 2, 3) for s in STAT)
    rows = []
    for t in ("A", "B"):
        for i in range(6 if t == "A" else 5):
            stats = [float(10 * b + i + (0 if s else 30)) for b in (1, 2, 3) for s in range(5)]
            rows.append((1, len(rows), t, f"p{t}{i}", "Ukraine", "2019-01-01", "E", 3, "Nuke", "Mirage", "Inferno", *stats))
    for i in range(4):
        rows.append((2, 50 + i, "A", f"q{i}", None, "2019-01-01", "E", 1, "Nuke", None, None, *[0.0] * 15))
    res = spark.createDataFrame([(1, "Inferno", "A", "B", 16, 10, 1), (2, "Nuke", "A", "B", 16, 3, 1), (1, "Dust2", "A", "B", 1, 2, 2)],
                                "match_id int, map_name string, team_1 string, team_2 string, result_1 int, result_2 int, map_winner int")
    out = adapters.adapt_block_stats(spark.createDataFrame(rows, cols), res).collect()
    assert len(out) == 1
    r = out[0]
    assert r["map_name"] == "Inferno" and r["team1_player1_kills"] == 60.0 and r["team1_player5"] == "pA4, UA" and r["rounds"] == 26


def test_transfer_templates(spark):
    body = "{{Transfer Row|date=2024-01-02|name=a|flag=ua|name2=b|role2=coach|team1=X|team2=Y|role1=rifler}} {{Transfer Row|name=c}}" \
           "{{Transfer Row|date=2024-02-02\n|name=d|date=2024-02-03}}"
    out = text.extract_transfers(spark.createDataFrame([("p", body)], "page string, text string")).orderBy("date", "player").collect()
    assert [(r["date"], r["player"], r["role"], r["to_team"]) for r in out] == [
        ("2024-01-02", "a", "rifler", "Y"), ("2024-01-02", "b", "coach", "Y"), ("2024-02-03", "d", "", "")]


def test_infobox(spark):
    page = "{{Infobox\n|name = Олег <ref>x</ref> \n|country=Ukraine\n}}"
    r = text.extract_infobox(spark.createDataFrame([(page, "de")], "text string, country string")).first()
    assert (r["page_name"], r["page_code"], r["country_mismatch"]) == ("Олег", "UA", True)


def test_files(spark, tmp_path):
    (tmp_path / "odds.csv").write_text("Date,Home,Away,Home_Odds,Away_Odds\n2024-01-01, A ,B,1.8,2.1\n,C,D,,2\n", encoding="utf-8")
    out = files.scan_odds(spark, str(tmp_path / "odds.csv")).collect()
    assert [(r["team1"], r["odds1"]) for r in out] == [("A", 1.8)]
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="two team"):
        files.scan_odds(spark, str(tmp_path / "bad.csv"))
    for name, body in {"a": '{"A": 1500.5}', "b": '{"ratings": {"A": 1500.5}}', "c": '[{"name": "A", "elo": 1500.5}, {"team": "B"}]',
                       "d": '{"ratings": [{"team": "A", "rating": 1500.5}]}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
        assert [tuple(r) for r in files.scan_ratings(spark, str(tmp_path / f"{name}.json")).collect()] == [("A", 1500.5)]
    (tmp_path / "sheet.csv").write_text("﻿dataset_string,native_name,corrected_latin\n\"Ace (Ann), UA\",Анна,\n", encoding="utf-8")
    sheet = files.scan_name_sheet(spark, str(tmp_path / "sheet.csv"))
    assert [tuple(r) for r in files.name_aliases(sheet).collect()] == [("Ace (Ann), UA", "Анна")]


def test_game_scan_keeps_input_order(spark, tmp_path):
    from faceoff.operators.clean import keep_first
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("team1", T.StringType())])
    (tmp_path / "g.csv").write_text("match_id,team1\n1,first\n1,second\n2,only\n")
    out = keep_first(games.scan_games(spark, str(tmp_path / "g.csv"), schema), ["match_id"], ["seq"])
    assert {r["team1"] for r in out.collect()} == {"first", "only"}
    multi = games.scan_multi_source(spark, {"cs2": _game_file(tmp_path), "csgo": str(tmp_path / "absent.csv")})
    assert [(r["game"], r["rounds"]) for r in multi.select("game", "rounds").collect()] == [("cs2", 24.0)]


def _game_file(folder):
    names = games.game_schema().fieldNames()
    values = {"match_id": "1", "game_id": "7", "is_total": "false", "map_name": "Nuke", "score1_game": "13", "score2_game": "11"}
    path = folder / "games.csv"
    path.write_text(",".join(names) + "\n" + ",".join(values.get(n, "") for n in names) + "\n")
    return str(path)


def test_resolve_names(spark):
    players = ["Ace (Ann Lee), UA", "ace (Anna Lee), UA", "Bo (Bob), DK", "Bo (Rob), SE", "Cy (Cyd), FR"]
    known = spark.createDataFrame([(p,) for p in players], "player string")
    asks = ["Bo (Bob), DK", " cy (CYD), fr ", "ACE", "bo", "cyd", "lee", "nobody", "Сідні Кид", "кид", "сідні"]
    aliases = spark.createDataFrame([("Cy (Cyd), FR", "Сідні «Cy» Йосипович Кид")], "canonical string, alias string")
    out = {r["request"]: (r["status"], r["resolved"], r["tier"]) for r in names.resolve_names(
        spark.createDataFrame([(a,) for a in asks], "request string"), known, aliases).collect()}
    assert out["Bo (Bob), DK"] == ("ok", "Bo (Bob), DK", 1) and out["cy (CYD), fr"] == ("ok", "Cy (Cyd), FR", 2)
    assert out["ACE"] == ("ok", "Ace (Ann Lee), UA", 3) and out["bo"][0] == "ambiguous"
    assert out["cyd"] == ("ok", "Cy (Cyd), FR", 4) and out["lee"] == ("ok", "Ace (Ann Lee), UA", 4)
    assert out["nobody"] == ("missing", None, None)
    assert out["Сідні Кид"] == ("ok", "Cy (Cyd), FR", 6) and out["кид"][0] == "ok"


def test_games_are_read_by_header_name(spark, tmp_path):
    schema = games.game_schema()
    extra = [f"other_{i}" for i in range(98 - len(schema))]
    names_ = [*reversed(schema.names), *extra]
    cells = {"match_id": "12", "game_id": "7.0", "is_total": "False", "datetime": "2024-05-01 10:00:00", "team1": " A,b ", "team1_win": "1.0",
             "score1_game": "13", "bestOf": "x", "team1_id": "7.5"}
    place = tmp_path / "one.csv"
    place.write_text(",".join(names_) + "\n" + ",".join(f'"{cells.get(n, "")}"' for n in names_) + "\n")
    second = tmp_path / "two.csv"
    second.write_text("team1,match_id,surprise\nZ,13,1\n")
    rows = games.scan_games(spark, [str(place), str(second)]).orderBy("match_id").collect()
    r = rows[0]
    assert [f.name for f in games.scan_games(spark, str(place)).schema] == [*schema.names, "seq"]
    assert (r["match_id"], r["game_id"], r["is_total"], r["team1"], r["team1_win"], r["score1_game"], r["bestOf"], r["team1_id"]) == (
        12, 7, False, " A,b ", 1, 13.0, None, None)
    assert str(r["datetime"]) == "2024-05-01 10:00:00" and (rows[1]["match_id"], rows[1]["team1"], rows[1]["datetime"]) == (13, "Z", None)


def test_repeated_look_up_ids_do_not_multiply_rows(spark):
    people = spark.createDataFrame([(i, f"n{i}", f"p{i}", "Ukraine", 0) for i in range(10)] + [(3, "new", "p3", "Ukraine", 1)],
                                   "ID long, NickName string, Name string, Country string, seq int")
    ids = spark.createDataFrame([(1, "a/old-2020-01-01", 0), (1, "a/new-2020-01-01", 1)], "ID long, Tittle string, seq int")
    overview = spark.createDataFrame([(1, "Nuke", 100, 200, 16, 3, 1, 0), (1, "Nuke", 100, 200, 1, 16, 0, 1)],
                                     "MatchID long, MapName string, Team1 long, Team2 long, Team1_Final_Score int, Team2_Final_Score int, Team1_Win int, seq int")
    infos = spark.createDataFrame([(1, "Nuke", 100 if i < 5 else 200, i, 20 - i, 10, 80.0, 0.7) for i in range(10)],
                                  "MatchID long, MapName string, TeamID long, PlayerID long, Total_Kills int, Total_Deaths int, Total_ADR double, Total_KAST double")
    out = adapters.adapt_long_stats(overview, infos, people, ids).collect()
    assert len(out) == 1
    assert (out[0]["score1_game"], out[0]["games_played"], out[0]["tournament"]) == (16, 1, "new-2020-01-01") and "new" in out[0]["team1_player4"]


def test_loose_names_equal_plain_matching(spark):
    import random

    from faceoff.operators.names import _loose

    rng = random.Random(6)
    parts = ["a", "ab", "bo", "cab", "do"]
    sheet = sorted({(f"N{rng.randrange(12)}", " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for _ in range(60)})
    asks = sorted({" ".join(rng.choice([*parts, "b", "zz"]) for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    keyed = spark.createDataFrame([(f"r{i}", a) for i, a in enumerate(asks)], "request string, _key string")
    got = {r["request"]: (r["resolved"], r["_ids"], r["n_matches"]) for r in _loose(keyed, spark.createDataFrame(sheet, "canonical string, _alias string")).collect()}
    want = {}
    for i, a in enumerate(asks):
        hit = {n for n, alias in sheet if a in alias or set(a.split(" ")) <= set(alias.split(" "))}
        if hit:
            want[f"r{i}"] = (min(hit), len(hit), len(hit))
    assert got == want


def on_file(df, place):
    """The frame as a table: scans of one table are recognised as equal, those of rows handed over are not."""
    df.write.parquet(str(place))
    return df.sparkSession.read.parquet(str(place))


def shuffled_by(df):
    """Keys of the shuffles a finished run made."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sorted(re.sub(r"#\d+L?", "", keys) for keys in re.findall(r" Exchange hashpartitioning\((.*?), \d+\)", text))


def test_block_rows_are_shuffled_once_by_match(spark, tmp_path):
    cols = "match_id int, seq int, team string, player_name string, country string, date string, event_name string, best_of int, map_1 string, map_2 string, map_3 string, " \
        + ", ".join(f"m{i}_{s} double" for i in (1, 2, 3) for s in STAT)
    rows = [(m, i, "AB"[i % 2], f"p{i}", None, "2019-01-01", "E", 3, "Nuke", None, " Mirage ", *[float(i)] * 15) for m in range(3) for i in range(12)]
    res = spark.createDataFrame([(m, n, "A", "B", 16, 10, 1 + m % 2) for m in range(3) for n in ("Mirage", "Nuke")],
                                "match_id int, map_name string, team_1 string, team_2 string, result_1 int, result_2 int, map_winner int")
    out = adapters.adapt_block_stats(on_file(spark.createDataFrame(rows, cols), tmp_path / "players"), on_file(res, tmp_path / "results"))
    keys = shuffled_by(out)         # players once, games for the sides and again for the scores
    assert set(keys) == {"match_id"} and len(keys) <= 3
    assert [(r["games_played"], r["score1_match"], r["score2_match"], r["team2_player5_kills"]) for r in out.orderBy("match_id").collect()] == [
        (2, 2 * (1 - m % 2), 2 * (m % 2), 9.0) for m in range(3) for _ in range(2)]


def test_long_rows_are_shuffled_once_by_match(spark, tmp_path):
    people = spark.createDataFrame([(i, f"n{i}", f"p{i}", "Ukraine") for i in range(12)], "ID long, NickName string, Name string, Country string")
    ids = spark.createDataFrame([(1, "a/x-2020-01-01")], "ID long, Tittle string")
    overview = spark.createDataFrame([(m, n, 100, 200, 16, 3, 1) for m in (1, 2) for n in ("Nuke", "Mirage")],
                                     "MatchID long, MapName string, Team1 long, Team2 long, Team1_Final_Score int, Team2_Final_Score int, Team1_Win int")
    # nine rows are too few for a map; a third team's rows count for the ten but fill no slot
    infos = spark.createDataFrame([(m, n, (100, 200, 300)[i % 3 if m == 2 else i % 2], i, 20 - i, 10, 80.0, 0.7)
                                   for m, n, k in ((1, "Nuke", 12), (1, "Mirage", 9), (2, "Nuke", 12)) for i in range(k)],
                                  "MatchID long, MapName string, TeamID long, PlayerID long, Total_Kills int, Total_Deaths int, Total_ADR double, Total_KAST double")
    out = adapters.adapt_long_stats(*[on_file(df, tmp_path / str(i)) for i, df in enumerate((overview, infos, people, ids))])
    keys = shuffled_by(out)         # slugs by their id, maps by name and match, player rows once
    assert set(keys) == {"ID", "MatchID", "MatchID, MapName"} and keys.count("MatchID") <= 3 and len(keys) <= 6
    assert [(r["game_id"], r["games_played"], r["score1_match"], r["team1_player5_id"], r["team2_player4_id"]) for r in out.orderBy("match_id").collect()] == [
        ("1-Nuke", 1, 1, 8, 7), ("2-Nuke", 1, 1, None, 10)]


def test_block_source_rows_equal_rows_grouped_by_player(spark):
    """Lineups are grouped as a whole and take their rows after that; the same rows as grouped player by player."""
    from pyspark.sql import functions as F

    from faceoff.plans.queries_players import block_source
    from faceoff.plans.registry import Contests

    c = Contests(spark, "/root/testdata/sf0.001")
    got = block_source(c)[0].select("match_id", "seq", "team", "pid", "map_1", "map_2", "map_3", "m1_kills", "m2_kast", "m3_adr")
    maps = c.map_rows().withColumn("k", F.col("game_id") - F.col("match_id") * 100 - 1)
    rows = maps.select((F.col("match_id") * 10 + F.floor(F.col("k") / 3)).alias("match_id"), (F.col("k") % 3 + 1).alias("b"),
                       F.concat_ws(" ", "map_name", (F.col("k") + 1).cast("string")).alias("mn"), F.inline(F.array(*[
                           F.struct(F.lit(n * 10 + i).alias("seq"), F.col(f"team{n}").alias("team"), F.col(f"team{n}_player{i}_id").alias("pid"),
                                    *[F.col(f"team{n}_player{i}_{s}").alias(s) for s in STAT]) for n in (1, 2) for i in range(1, 6)]))).where("pid IS NOT NULL")
    at = lambda i, v: F.max(F.when(F.col("b") == i, F.col(v)))
    want = rows.groupBy("match_id", "seq", "team", "pid").agg(at(1, "mn"), at(2, "mn"), at(3, "mn"), at(1, "kills"), at(2, "kast"), at(3, "adr"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
