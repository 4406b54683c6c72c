"""Game files: explicit schemas, splitting, unions over files and tiers, registered views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faceoff.operators.longform import STATS


def game_schema() -> T.StructType:
    """The wide game file: contest columns, then ten player slots with their statistics."""
    text, whole, real = T.StringType(), T.LongType(), T.DoubleType()
    fields = [
        ("match_id", whole), ("game_id", whole), ("is_total", T.BooleanType()),
        ("datetime", T.TimestampType()), ("tournament", text), ("team1", text), ("team2", text),
        ("team1_id", whole), ("team2_id", whole), ("team1_win", T.IntegerType()),
        ("score1_match", real), ("score2_match", real), ("score1_game", real),
        ("score2_game", real), ("games_played", real), ("bestOf", real), ("map_name", text),
    ]
    for side in (1, 2):
        for slot in range(1, 6):
            fields += [(f"team{side}_player{slot}_id", whole), (f"team{side}_player{slot}", text)]
            fields += [(f"team{side}_player{slot}_{s}", real) for s in STATS]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _as(name: str, kind: T.DataType) -> Column:
    """A text cell as ``kind``; what cannot be read is null. Whole numbers may be written as 7.0."""
    cell = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        number = cell.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(cell.try_cast(kind), whole).alias(name)
    return (F.col(f"`{name}`") if isinstance(kind, T.StringType) else cell.try_cast(kind)).alias(name)


def scan_games(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Read game CSVs by header name; ``seq`` records input order for keep-first.

    Columns may stand in any order; those outside the schema are not read, missing ones are null. The
    files of one path share a header; a list of paths may have one header each. ``seq`` is (file,
    position) as one comparable struct, so the first row stays the first row whatever the parallelism.
    """
    fields = (schema or game_schema()).fields

    def one(place: str) -> DataFrame:
        raw = spark.read.option("header", True).csv(place)
        have = set(raw.columns)
        return raw.select(*[_as(f.name, f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
                          F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("seq"))

    return reduce(DataFrame.unionByName, [one(p) for p in ([path] if isinstance(path, str) else path)])


def split_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series summary rows, map rows)."""
    return raw.where("is_total"), raw.where(~F.col("is_total"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Map rows of several sources in one frame, tagged with their game, with ``rounds``."""
    parts = [
        df.where(~F.col("is_total") & F.col("map_name").isNotNull()).withColumns({
            "game": F.lit(game), "rounds": F.col("score1_game") + F.col("score2_game")})
        for game, df in sources.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_multi_source(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """As ``union_sources`` over files; a source whose path does not exist is left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = {g: p for g, p in paths.items() if hadoop(p).getFileSystem(conf).exists(hadoop(p))}
    if not present:
        raise ValueError("none of the source files exists")
    return union_sources({g: scan_games(spark, p) for g, p in present.items()})


def label_tiers(tiers: dict[str, DataFrame]) -> DataFrame:
    """One frame per tier -> one frame with a ``tier`` column."""
    parts = [df.withColumn("tier", F.lit(name)) for name, df in tiers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def register_views(spark: SparkSession, frames: dict[str, DataFrame], timestamps=("datetime",),
                   drop=("index",)) -> None:
    """Register frames for SQL with the time columns typed (unparsable values become null)."""
    for name, df in frames.items():
        typed = df.drop(*[d for d in drop if d in df.columns])
        for column in timestamps:
            if column in typed.columns:
                typed = typed.withColumn(column, F.col(column).try_cast("timestamp_ntz"))
        typed.createOrReplaceTempView(name)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)
