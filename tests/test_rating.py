from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faceoff.operators import rating
from faceoff.streaming.incremental import apply_batch

T0 = datetime(2024, 1, 1)


def contests(spark, n=60, pools=("p", "q")):
    rows = []
    for i in range(n):
        a, b = f"t{i % 5}", f"t{(i * 3 + 1) % 5}"
        if a == b:
            b = "t9"
        rows.append((i, T0 + timedelta(hours=7 * i), a, b, a if i % 3 else b, pools[i % len(pools)]))
    return spark.createDataFrame(rows, "match_id long, datetime timestamp, team1 string, team2 string, winner string, pool string")


def replay_by_hand(rows, k=32.0):
    ratings, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["datetime"], r["match_id"])):
        a, b = (r["pool"], r["team1"]), (r["pool"], r["team2"])
        ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        e, s = 1 / (1 + 10 ** ((rb - ra) / 400)), float(r["winner"] == r["team1"])
        ratings[a], ratings[b] = ra + k * (s - e), rb + k * ((1 - s) - (1 - e))
        out[r["match_id"]] = (ra, rb)
    return out


@pytest.mark.parametrize("slice_rows", [1000, 7])
def test_replay_matches_a_serial_loop(spark, slice_rows):
    df = contests(spark)
    want = replay_by_hand(df.collect())
    got = rating.elo_replay(df, ["pool"], slice_rows=slice_rows).collect()
    assert len(got) == 60
    for r in got:
        assert (r["elo_t1_pre"], r["elo_t2_pre"]) == pytest.approx(want[r["match_id"]])
        assert r["p_t1"] == pytest.approx(1 / (1 + 10 ** ((r["elo_t2_pre"] - r["elo_t1_pre"]) / 400)))


def test_pool_is_required(spark):
    with pytest.raises(ValueError, match="pool"):
        rating.elo_replay(contests(spark), [])


def test_batches_equal_full_replay_and_are_idempotent(spark, tmp_path):
    df = contests(spark, pools=("p",))
    folder = str(tmp_path)
    parts = [df.where("match_id < 20"), df.where("match_id BETWEEN 20 AND 39"), df.where("match_id >= 40")]
    for number, part in enumerate(parts):
        apply_batch(part, number, folder, ["pool"])
    apply_batch(parts[2], 2, folder, ["pool"])          # a retried batch
    rated = spark.read.parquet(*[f"{folder}/rated/batch={i}" for i in range(3)])
    full = rating.elo_replay(df, ["pool"])
    gap = rated.select("match_id", F.col("elo_t1_pre").alias("x")).join(full, "match_id").agg(
        F.max(F.abs(F.col("x") - F.col("elo_t1_pre"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 60
    with pytest.raises(ValueError, match="older"):
        apply_batch(parts[0], 3, folder, ["pool"])


def test_k_values_run_side_by_side(spark):
    df = rating.with_k_values(contests(spark, 30, ("p",)))
    out = rating.elo_replay(df, ["pool", "k"])
    for k in rating.K_VALUES:
        want = replay_by_hand(contests(spark, 30, ("p",)).collect(), k)
        for r in out.where(F.col("k") == k).collect():
            assert r["elo_t1_pre"] == pytest.approx(want[r["match_id"]][0])


def test_an_empty_batch_keeps_the_ratings(spark, tmp_path):
    df, folder = contests(spark, pools=("p",)), str(tmp_path)
    apply_batch(df, 0, folder, ["pool"])
    apply_batch(df.limit(0), 1, folder, ["pool"])
    first, second = ({(r["team"], r["rating"]) for r in spark.read.parquet(f"{folder}/ratings/batch={i}").collect()} for i in (0, 1))
    assert first == second and spark.read.parquet(f"{folder}/rated/batch=1").count() == 0
    assert rating.elo_replay(df.limit(0), ["pool"], slice_rows=5).count() == 0


@pytest.mark.parametrize("slice_rows", [None, 7])
def test_an_unknown_winner_counts_as_lost_by_side_one(spark, slice_rows):
    df = contests(spark).withColumn("winner", F.when(F.col("match_id") % 5 != 0, F.col("winner")))
    want = replay_by_hand(df.collect())
    for r in rating.elo_replay(df, ["pool"], slice_rows=slice_rows).collect():
        assert (r["elo_t1_pre"], r["elo_t2_pre"]) == pytest.approx(want[r["match_id"]])


def test_a_slice_reads_only_its_own_files(spark):
    from faceoff.session import write_and_reread

    rows = write_and_reread(spark.range(1000).withColumn("_slice", F.floor(F.col("id") / 100)), "test-slices", by="_slice")
    assert "PartitionFilters: [isnotnull(_slice" in rows.where("_slice = 3")._jdf.queryExecution().executedPlan().toString()
    assert rows.where("_slice = 3").count() == 100


def islands(spark, n=240, groups=8):
    """Contests of entities that only meet inside their group of three."""
    rows = []
    for i in range(n):
        g = (i * 5) % groups
        a, b = f"g{g}t{i % 3}", f"g{g}t{(i + 1) % 3}"
        rows.append((i, T0 + timedelta(hours=i), a, b, a if i % 4 else b, "p"))
    return spark.createDataFrame(rows, "match_id long, datetime timestamp, team1 string, team2 string, winner string, pool string")


def test_components_of_a_slice_replay_apart_and_give_the_serial_ratings(spark):
    df = islands(spark)
    order = ("datetime", "match_id")
    placed = rating.placed_in_slices(df, ["pool"], order, slice_rows=80, lot_rows=1)
    assert {r["_slice"]: r["n"] for r in placed.groupBy("_slice").agg(F.countDistinct("_lot").alias("n")).collect()} == {0: 8, 1: 8, 2: 8}
    side = placed.select("_slice", "_lot", F.explode(F.array("team1", "team2")).alias("team"))
    assert side.groupBy("_slice", "team").agg(F.countDistinct("_lot").alias("n")).where("n > 1").isEmpty()
    want = replay_by_hand(df.collect())
    for lot_rows in (1, 25):
        got = rating.elo_replay(df, ["pool"], slice_rows=80, lot_rows=lot_rows).collect()
        assert len(got) == 240
        for r in got:
            assert (r["elo_t1_pre"], r["elo_t2_pre"]) == pytest.approx(want[r["match_id"]])


def test_null_pools_and_entities_are_like_any_other(spark):
    df = contests(spark).withColumn("pool", F.when(F.col("pool") == "p", "p")).withColumn(
        "team2", F.when(F.col("team2") != "t9", F.col("team2")))
    want = replay_by_hand(df.collect())
    got = rating.elo_replay(df, ["pool"], slice_rows=15, lot_rows=1).collect()
    assert len(got) == 60
    for r in got:
        assert (r["elo_t1_pre"], r["elo_t2_pre"]) == pytest.approx(want[r["match_id"]])


def test_components_reach_the_end_of_a_long_chain():
    import numpy as np

    rng = np.random.default_rng(5)
    names = rng.permutation(4000)
    first, second = np.concatenate([names[:1999], names[2000:3999]]), np.concatenate([names[1:2000], names[2001:4000]])
    label = rating.components(first, second, 4000)
    assert set(label[names[:2000]]) == {names[:2000].min()} and set(label[names[2000:]]) == {names[2000:].min()}


def test_a_stream_of_files_is_rated_as_one_replay(spark, tmp_path):
    from faceoff.streaming.incremental import rate_stream

    df, source, folder = contests(spark, pools=("p",)), str(tmp_path / "in"), str(tmp_path / "out")
    for low in (0, 25, 40):
        high = {0: 25, 25: 40, 40: 60}[low]
        df.where(f"match_id >= {low} AND match_id < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        started = rate_stream(stream, folder, str(tmp_path / "progress"), ["pool"])
        started.awaitTermination(120)
        started.stop()
    rated = {r["match_id"]: (r["elo_t1_pre"], r["elo_t2_pre"]) for r in spark.read.parquet(f"{folder}/rated").collect()}
    want = replay_by_hand(df.collect())
    assert rated.keys() == want.keys()
    for k, v in want.items():
        assert rated[k] == pytest.approx(v)


def test_many_slices_settle_in_a_handful_of_passes(spark, monkeypatch):
    written = []
    keep = rating.write_and_reread

    def counted(df, label, *more, **by):
        written.append(label)
        return keep(df, label, *more, **by)

    monkeypatch.setattr(rating, "write_and_reread", counted)
    df = contests(spark, 6000, ("p",))
    want = replay_by_hand(df.collect())
    got = rating.elo_replay(df, ["pool"], slice_rows=300).collect()
    assert max(abs(r["elo_t1_pre"] - want[r["match_id"]][0]) for r in got) < 1e-9 and len(got) == 6000
    assert len(written) < 20                                     # twenty slices, forty tables when one waited for the other


@pytest.mark.parametrize("entities", [12, 200, 4000])
def test_rare_entities_settle_to_the_serial_ratings(spark, entities):
    import random

    draw = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = draw.sample(range(entities), 2)
        rows.append((i, T0 + timedelta(hours=i), f"t{a}", f"t{b}", f"t{a if draw.random() < 0.6 else b}", "p"))
    df = spark.createDataFrame(rows, contests(spark, 1).schema)
    want = replay_by_hand(df.collect())
    got = rating.elo_replay(df, ["pool"], slice_rows=100, snapshot=spark.createDataFrame([("p", "t1", 1500.0)], "pool string, team string, rating double")).collect()
    assert max(abs(r["elo_t1_pre"] - want[r["match_id"]][0]) for r in got) < 1e-8


def test_a_replay_without_a_snapshot_joins_none(spark, monkeypatch):
    plans, write = [], rating.write_and_reread

    def keep(rows, label):
        if label == "replay-first":
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, label)

    monkeypatch.setattr(rating, "write_and_reread", keep)
    known = spark.createDataFrame([("p", "t0", 1700.0)], "pool string, team string, rating double")
    for snapshot, start in ((None, 1500.0), (known, 1700.0)):
        first = rating.elo_replay(contests(spark), ["pool"], snapshot=snapshot).where("pool = 'p' AND team1 = 't0'").orderBy("datetime").first()
        assert first["elo_t1_pre"] == start
    assert ["Join" in p for p in plans] == [False, True]


def test_a_contest_without_a_k_fails(spark):
    with pytest.raises(Exception, match="no k"):
        rating.elo_replay(contests(spark).withColumn("k", F.when(F.col("match_id") != 7, 32.0)), ["pool"]).collect()
