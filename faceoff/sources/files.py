"""Small tabular files around the contests: ratings, odds, alias sheets, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faceoff.functions.scalar import key_of

# ---- fixed values: header hints -------------------------------------------------------------
TEAM_HINTS = ("team1", "team2", "home", "away", "team_a", "team_b")
ODDS_HINTS = ("odds1", "odds2", "odds_a", "odds_b", "home_odds", "away_odds")
# ---------------------------------------------------------------------------------------------
_LIST = "array<struct<team:string,name:string,elo:double,rating:double>>"


def parse_ratings(docs: DataFrame, text: str = "value") -> DataFrame:
    """Rating documents in any of three shapes -> (team, rating).

    ``{team: elo}``, ``{"ratings": {...}}`` (or a list below it), or a list of records with
    team/name and elo/rating. A list record without a name or a rating is left out.
    """
    body = F.coalesce(F.get_json_object(text, "$.ratings"), F.col(text))
    flat = F.from_json(body, "map<string,double>")
    records = F.from_json(body, _LIST)
    listed = F.transform(records, lambda r: F.struct(
        F.coalesce(r["team"], r["name"]).alias("team"), F.coalesce(r["elo"], r["rating"]).alias("rating")))
    entries = F.transform(F.map_entries(flat), lambda e: F.struct(e["key"].alias("team"), e["value"].alias("rating")))
    is_list = F.startswith(F.ltrim(body), F.lit("["))
    keep = [n for n in docs.columns if n != text]
    return docs.select(*keep, F.inline(F.when(is_list, listed).otherwise(entries))).where(
        "team IS NOT NULL AND rating IS NOT NULL")


def scan_ratings(spark: SparkSession, path: str) -> DataFrame:
    return parse_ratings(spark.read.text(path, wholetext=True)).select("team", "rating")


def scan_odds(spark: SparkSession, path: str) -> DataFrame:
    """date, team1, team2, odds1, odds2 from a CSV whose columns are found by name hints.

    Only the header decides; rows without two numeric prices are dropped by a ``try_cast``.
    """
    raw = spark.read.option("header", True).csv(path)      # all text: the header names the columns
    lowered = {name.lower(): name for name in raw.columns}
    teams = [n for k, n in lowered.items() if any(h in k for h in TEAM_HINTS)]
    odds = [n for k, n in lowered.items() if any(h in k for h in ODDS_HINTS)]
    if len(teams) < 2 or len(odds) < 2:
        raise ValueError(f"need two team and two odds columns, found {teams} and {odds}")
    date = next((n for k, n in lowered.items() if "date" in k), None)

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    return raw.select(
        F.trim(F.coalesce(col(date), F.lit(""))).alias("date") if date else F.lit("").alias("date"),
        F.trim(col(teams[0])).alias("team1"), F.trim(col(teams[1])).alias("team2"),
        F.trim(col(odds[0])).try_cast("double").alias("odds1"), F.trim(col(odds[1])).try_cast("double").alias("odds2"),
    ).where("odds1 IS NOT NULL AND odds2 IS NOT NULL")


def scan_name_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The alias sheet with a possible byte order mark in its header, blanks trimmed to null."""
    raw = spark.read.option("header", True).csv(path)
    clean = raw.toDF(*[n.replace("\ufeff", "").strip() for n in raw.columns])
    return clean.select(*[F.nullif(F.trim(F.col(n)), F.lit("")).alias(n) for n in clean.columns])


def name_aliases(sheet: DataFrame) -> DataFrame:
    """(canonical, alias): one row per filled native or corrected name."""
    return sheet.select(
        F.col("dataset_string").alias("canonical"), F.explode(F.array("native_name", "corrected_latin")).alias("alias"),
    ).dropna().distinct()


def corrected_labels(sheet: DataFrame) -> DataFrame:
    """(player_key, corrected)."""
    return sheet.dropna(subset=["dataset_string", "corrected_latin"]).select(
        key_of(F.col("dataset_string")).alias("player_key"), F.col("corrected_latin").alias("corrected"))


# ---- sinks ----------------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_store(df: DataFrame, path: str, by: tuple[str, ...] = ("tier",)) -> None:
    """The feature store: parquet partitioned for pruning by tier (and any further columns)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
