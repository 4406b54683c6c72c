"""Rating new contests from a stored snapshot instead of replaying history.

The batch answer to nightly data: ratings after the last batch are a small table; only the new
contests are replayed. A batch id makes the step idempotent, so a retried or repeated batch never
updates a rating twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faceoff.operators.rating import advance, elo_replay, final_ratings


def replay_after(replayed: DataFrame, new: DataFrame, pool: list[str], k: float = 32.0) -> DataFrame:
    """Rate ``new`` (all later than ``replayed``) from the final ratings of ``replayed``."""
    return elo_replay(new, pool, k=k, snapshot=final_ratings(replayed, pool))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def apply_batch(contests: DataFrame, batch_id: int, folder: str, pool: list[str], k: float = 32.0,
                order: tuple[str, ...] = ("datetime", "match_id")) -> None:
    """``foreachBatch`` body: rate one batch and store predictions and the new snapshot.

    Layout: ``folder/rated/batch=N`` and ``folder/ratings/batch=N``. The ratings of batch N-1 are
    the input, so running batch N again overwrites the same two partitions with the same rows.
    A contest older than the snapshot's ``as_of`` is a late correction: it fails the batch, because
    it would change every later rating silently.
    """
    spark = contests.sparkSession
    snapshot = _read_or_none(spark, f"{folder}/ratings/batch={batch_id - 1}") if batch_id > 0 else None
    if batch_id > 0 and snapshot is None:
        raise ValueError(f"no rating snapshot of batch {batch_id - 1}; replay from the start")
    if snapshot is not None:
        newest = snapshot.agg(F.max("as_of")).first()[0]
        late = contests.where(F.col(order[0]) < F.lit(newest)).limit(1).count()
        if late:
            raise ValueError("contests older than the snapshot: replay from before the correction")
    columns = [*pool, "team", "rating"]
    rated = elo_replay(contests, pool, k=k, order=order,
                       snapshot=None if snapshot is None else snapshot.select(*columns))
    rated.write.mode("overwrite").parquet(f"{folder}/rated/batch={batch_id}")
    stored = spark.read.parquet(f"{folder}/rated/batch={batch_id}")
    state = final_ratings(stored, pool, order) if snapshot is None else advance(
        snapshot.select(*columns), stored, pool, order)
    as_of = stored.agg(F.max(order[0]).alias("as_of"))
    if snapshot is not None:
        as_of = as_of.select(F.greatest("as_of", F.lit(newest)).alias("as_of"))
    state.crossJoin(as_of).write.mode("overwrite").parquet(f"{folder}/ratings/batch={batch_id}")


def rate_stream(stream: DataFrame, folder: str, checkpoint: str, pool: list[str], k: float = 32.0):
    """Run ``apply_batch`` on every micro-batch of a streaming contest source."""
    return (
        stream.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, folder, pool, k))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
