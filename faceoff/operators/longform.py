"""Reshapes from one row per contest to one row per side or per player."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.operators.clean import kast_fraction

# The five statistics kept per player slot.
STATS = ("kills", "deaths", "assists", "adr", "kast")


def side_long(df: DataFrame, keep: tuple[str, ...] = ("match_id", "datetime")) -> DataFrame:
    """Two rows per contest with a 0/1 ``win``; one scan, an explode instead of a self-union."""
    def side(n: int, other: int):
        return F.struct(
            F.col(f"team{n}").alias("team"), F.col(f"team{other}").alias("opponent"),
            F.lit(n).alias("side"), (F.col("winner") == F.col(f"team{n}")).cast("int").alias("win"),
        )

    return df.select(*keep, F.inline(F.array(side(1, 2), side(2, 1))))


def player_long(maps: DataFrame) -> DataFrame:
    """Ten rows per map, one per occupied player slot, with the side's own result."""
    def slot(n: int, i: int):
        won = F.col("team1_win") == 1
        fields = [
            F.lit(f"team{n}").alias("side"), F.col(f"team{n}").alias("team"),
            F.col(f"team{3 - n}").alias("opponent"), F.lit(i).alias("slot"),
            (won if n == 1 else ~won).alias("won"),
            F.col(f"team{n}_player{i}").alias("player"),
        ]
        fields += [F.col(f"team{n}_player{i}_{s}").cast("double").alias(s) for s in STATS]
        return F.struct(*fields)

    slots = F.array(*[slot(n, i) for n in (1, 2) for i in range(1, 6)])
    rounds = (F.col("score1_game") + F.col("score2_game")).alias("rounds")
    long = maps.select(
        "match_id", "game_id", "datetime", F.col("tournament").alias("event"), "map_name", "tier",
        "game", rounds, F.inline(slots),
    )
    from faceoff.functions.scalar import key_of

    return long.where(F.trim("player") != "").withColumns({
        "kast": kast_fraction(F.col("kast")), "player_key": key_of(F.col("player")),
    })
