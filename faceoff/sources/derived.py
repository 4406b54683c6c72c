"""Contest tables derived from the star-schema tables.

``orders`` 2m and 2m+1 meet as match m; the n-th lines of both orders form map n. One SQL text
serves Spark and the DuckDB check, so both engines read the same contests. Every row of
``orders`` and ``lineitem`` takes part; the ``%`` tests only plant nulls, duplicates and gaps.
``lines_met`` states the pairing of lines without the two joins of ``MAPS``: one shuffle on the match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = range(1, 6)

HALF = """
SELECT CAST(FLOOR(o.o_orderkey / 2) AS BIGINT) AS match_id,
       CAST(o.o_orderkey % 2 AS INT) AS side, o.o_orderkey, o.o_orderdate,
       o.o_orderstatus, o.o_orderpriority, {team} AS team, n.n_name,
       CAST({team_no} AS BIGINT) AS nk
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

PAIRING = """
SELECT a.match_id,
       a.o_orderdate + INTERVAL '1' SECOND * (a.match_id % 86400) AS datetime,
       CAST(FLOOR((12 * EXTRACT(YEAR FROM a.o_orderdate)
                   + EXTRACT(MONTH FROM a.o_orderdate)) / 6) AS BIGINT) AS era,
       CASE a.o_orderstatus WHEN 'F' THEN 'tier1' WHEN 'O' THEN 'tier2' ELSE 'tier3' END AS tier,
       a.o_orderpriority AS tournament, 1 + 2 * (a.o_orderkey % 3) AS bestOf,
       CASE WHEN EXTRACT(YEAR FROM a.o_orderdate) < 1998 THEN 'csgo' ELSE 'cs2' END AS game,
       a.o_orderkey AS key1, b.o_orderkey AS key2, a.team AS team1, b.team AS team2,
       a.nk AS nk1, b.nk AS nk2, a.n_name AS n1, b.n_name AS n2
FROM half a JOIN half b ON a.match_id = b.match_id
WHERE a.side = 0 AND b.side = 1 AND a.team <> b.team
"""

LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
FROM lineitem
"""

MAPS = """
SELECT p.*, x.k, p.match_id * 100 + x.k AS game_id, t.p_type AS map_name,
       x.l_quantity AS score1_game, y.l_quantity AS score2_game,
       CASE WHEN x.l_extendedprice > y.l_extendedprice THEN 1 ELSE 0 END AS team1_win,
       x.l_partkey AS part1, x.l_suppkey AS supp1, y.l_partkey AS part2, y.l_suppkey AS supp2
FROM pairing p JOIN lines x ON x.l_orderkey = p.key1
JOIN lines y ON y.l_orderkey = p.key2 AND y.k = x.k
JOIN part t ON t.p_partkey = x.l_partkey
"""

SUMMARY = """
SELECT match_id, COUNT(*) AS games_played,
       SUM(CASE WHEN score1_game > score2_game THEN 1 ELSE 0 END) AS won1,
       SUM(CASE WHEN score2_game > score1_game THEN 1 ELSE 0 END) AS won2
FROM maps GROUP BY match_id
"""


def _player_id(side: int, slot: int) -> str:
    base = f"nk{side} * 100 + (era + {slot}) % 8"
    if slot == 5:
        base = f"CASE WHEN match_id % 11 = 0 THEN nk{side} * 100 + 90 ELSE {base} END"
    if slot == 4:
        base = f"CASE WHEN match_id % 22 = 0 THEN nk{side} * 100 + 91 ELSE {base} END"
    if slot == 1 and side == 1:
        base = f"CASE WHEN match_id % 17 = 0 THEN NULL ELSE {base} END"
    return base


def _lineup_columns() -> str:
    columns = []
    for side in (1, 2):
        code = f"UPPER(SUBSTR(n{side}, 1, 2))"
        for slot in SLOTS:
            pid = _player_id(side, slot)
            text = f"CAST({pid} AS VARCHAR(20))"
            columns.append(f"{pid} AS team{side}_player{slot}_id")
            columns.append(
                f"CASE WHEN game = 'csgo' THEN 'P' || {text} || ', ' || {code} ELSE "
                f"'P' || {text} || ' (Name ' || {text} || '), ' || {code} END AS team{side}_player{slot}"
            )
    return ", ".join(columns)


def _stat_columns(known: bool) -> str:
    columns = []
    for side in (1, 2):
        part, supp = f"part{side}", f"supp{side}"
        for slot in SLOTS:
            values = {
                "kills": f"10 + ({part} + {slot}) % 20",
                "deaths": f"8 + ({supp} + {2 * slot}) % 15",
                "assists": "NULL" if slot == 5 else f"({part} + {slot}) % 7",
                "adr": f"50 + ({part} * {slot}) % 50",
                "kast": f"(50 + ({part} + {slot}) % 50) / "
                        "CASE WHEN match_id % 2 = 1 THEN 100.0e0 ELSE 1.0e0 END",
            }
            for stat, expr in values.items():
                value = expr if known else "NULL"
                columns.append(f"CAST({value} AS DOUBLE) AS team{side}_player{slot}_{stat}")
    return ", ".join(columns)


MAP_ROWS = f"""
SELECT match_id, game_id, 1 AS seq, FALSE AS is_total, datetime, tournament, tier, game,
       team1, team2, nk1 AS team1_id, nk2 AS team2_id, team1_win,
       CAST(NULL AS DOUBLE) AS score1_match, CAST(NULL AS DOUBLE) AS score2_match,
       score1_game, score2_game, CAST(NULL AS BIGINT) AS games_played, bestOf, map_name,
       {_lineup_columns()}, {_stat_columns(True)}
FROM maps
"""

SERIES_ROWS = f"""
SELECT p.match_id, CAST(NULL AS BIGINT) AS game_id, d.seq, TRUE AS is_total, datetime, tournament,
       tier, game, team1, CASE WHEN p.match_id % 101 = 0 THEN NULL ELSE team2 END AS team2,
       nk1 AS team1_id, nk2 AS team2_id, CAST(NULL AS INT) AS team1_win,
       CASE WHEN p.match_id % 13 = 0 THEN NULL ELSE CAST(s.won1 AS DOUBLE) END AS score1_match,
       CASE WHEN p.match_id % 13 = 0 THEN NULL ELSE CAST(s.won2 AS DOUBLE) END AS score2_match,
       CAST(NULL AS DOUBLE) AS score1_game, CAST(NULL AS DOUBLE) AS score2_game,
       s.games_played, bestOf, CAST(NULL AS VARCHAR(20)) AS map_name,
       {_lineup_columns().replace("match_id", "p.match_id")}, {_stat_columns(False)}
FROM pairing p JOIN summary s ON s.match_id = p.match_id
JOIN (SELECT 1 AS seq UNION ALL SELECT 2 AS seq) d ON d.seq = 1 OR p.match_id % 97 = 0
"""

RAW = "SELECT * FROM series_rows UNION ALL SELECT * FROM map_rows"

ODDS = """
SELECT match_id, CAST(datetime AS DATE) AS date, team1, team2,
       CASE WHEN match_id % 50 = 0 THEN 0.9e0 ELSE 1.05e0 + (match_id % 40) / 10.0e0 END AS odds1,
       1.05e0 + ((match_id * 7) % 40) / 10.0e0 AS odds2
FROM pairing
"""

TRANSFERS = """
SELECT CAST(TIMESTAMP '1995-01-01 00:00:00'
            + INTERVAL '1' DAY * (53 * j.v + 17 * n.n_nationkey + 400 * k.v) AS TIMESTAMP) AS date,
       CAST(n.n_nationkey AS BIGINT) * 100 + j.v AS player, n.n_name AS to_team
FROM nation n
JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS j(v) ON TRUE
JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS k(v) ON TRUE
"""

CHAIN = {
    "half": HALF.format(team="n.n_name", team_no="n.n_nationkey"),
    "pairing": PAIRING,
    "lines": LINES,
    "maps": MAPS,
    "summary": SUMMARY,
    "map_rows": MAP_ROWS,
    "series_rows": SERIES_ROWS,
    "raw": RAW,
    "odds": ODDS,
    "transfers": TRANSFERS,
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines_met(spark: SparkSession, folder: str) -> DataFrame:
    """(match_id, k) with the values of the n-th lines of both orders, where both exist.

    Both orders of a match go to one place by match_id: numbering and meeting need no further shuffle.
    """
    c = F.col
    rows = table(spark, folder, "lineitem").where("l_orderkey IS NOT NULL").select(
        F.floor(c("l_orderkey") / 2).cast("long").alias("match_id"), (c("l_orderkey") % 2).cast("int").alias("side"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").repartition("match_id")
    in_order = Window.partitionBy("match_id", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    values = {"part": "l_partkey", "supp": "l_suppkey", "price": "l_extendedprice", "quantity": "l_quantity"}
    return rows.withColumn("k", F.row_number().over(in_order)).groupBy("match_id", "k").agg(
        F.max(c("side") == 0).alias("_x"), F.max(c("side") == 1).alias("_y"),
        *[F.max(F.when(c("side") == n, c(v))).alias(f"{name}{n + 1}") for name, v in values.items() for n in (0, 1)],
    ).where("_x AND _y").drop("_x", "_y")


def maps(spark: SparkSession, folder: str, pairing: DataFrame) -> DataFrame:
    """What ``MAPS`` says, with everything wide joined last."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("part1"), F.col("p_type").alias("map_name"))
    return lines_met(spark, folder).join(parts, "part1").join(pairing, "match_id").select(
        *pairing.columns, "k", (F.col("match_id") * 100 + F.col("k")).alias("game_id"), "map_name",
        F.col("quantity1").alias("score1_game"), F.col("quantity2").alias("score2_game"),
        F.when(F.col("price1") > F.col("price2"), 1).otherwise(0).alias("team1_win"), "part1", "supp1", "part2", "supp2")


def series(pairing: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairing with the ``SUMMARY`` of its maps."""
    summary = maps.sparkSession.sql(SUMMARY.replace("FROM maps", "FROM {maps}"), maps=maps)
    return pairing.join(summary, "match_id")


def map_rows(maps: DataFrame, *more: str) -> DataFrame:
    """``MAP_ROWS`` over stored maps, ``more`` columns in front: a projection, so a reader of few columns reads few."""
    text = MAP_ROWS.replace("VARCHAR(20)", "STRING").replace("FROM maps", "FROM {maps}")
    text = text.replace("SELECT ", "SELECT " + "".join(f"{n}, " for n in more), 1)
    return maps.sparkSession.sql(text, maps=maps)


def series_rows(series: DataFrame) -> DataFrame:
    """``SERIES_ROWS`` over stored series: a projection and the planted duplicates."""
    text = SERIES_ROWS.replace("VARCHAR(20)", "STRING").replace("s.", "p.").replace(
        "FROM pairing p JOIN summary s ON p.match_id = p.match_id", "FROM {series} p")
    return series.sparkSession.sql(text, series=series)


def derive(spark: SparkSession, folder: str, name: str, by_customer: bool = False) -> DataFrame:
    """One of the derived tables. ``by_customer`` makes customers the teams, so they grow with data."""
    chain = dict(CHAIN)
    if by_customer:
        chain["half"] = HALF.format(team="c.c_name", team_no="c.c_custkey")
    if name == "transfers":
        wanted = ["transfers"]
    else:
        wanted = list(chain)[: list(chain).index(name)]
        wanted = [w for w in wanted if w != "transfers"]
    text = chain[name].replace("VARCHAR(20)", "STRING")
    prefix = ", ".join(f"{w} AS ({chain[w]})" for w in wanted if w != name)
    text = (f"WITH {prefix} {text}" if prefix else text).replace("VARCHAR(20)", "STRING")
    text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    for base in ("orders", "customer", "nation", "lineitem", "part"):
        for lead in ("FROM ", "JOIN "):
            text = text.replace(f"{lead}{base} ", f"{lead}{{{base}}} ").replace(
                f"{lead}{base}\n", f"{lead}{{{base}}}\n")
    used = [b for b in ("orders", "customer", "nation", "lineitem", "part") if f"{{{b}}}" in text]
    return spark.sql(text, **{b: table(spark, folder, b) for b in used})
