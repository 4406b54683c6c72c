import math

import pytest
from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.functions.tails import chi2_upper_one, f_upper, t_quantile, t_two_sided


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_elo_numbers(spark):
    assert one(spark, X.elo_expected(F.lit(1500.0), F.lit(1600.0))) == pytest.approx(0.359935, abs=1e-6)
    a = one(spark, X.elo_expected(F.lit(1700.0), F.lit(1400.0)))
    b = one(spark, X.elo_expected(F.lit(1400.0), F.lit(1700.0)))
    assert a + b == pytest.approx(1.0)
    up = one(spark, X.elo_update(F.lit(1500.0), F.lit(1500.0), F.lit(1.0)))
    assert up == pytest.approx(1516.0)


def test_series_probabilities(spark):
    assert one(spark, X.bo3_probability(F.lit(0.55))) == pytest.approx(0.57475)
    assert one(spark, X.series_probability(F.lit(0.55), 3)) == pytest.approx(0.57475)
    assert one(spark, X.series_probability(F.lit(0.5), 5)) == pytest.approx(0.5)
    with pytest.raises(Exception, match="outside"):
        one(spark, X.bo3_probability(F.lit(1.2)))


def test_odds(spark):
    row = one(spark, X.devig(F.lit(1.8), F.lit(2.1)))
    assert row["p1"] + row["p2"] == pytest.approx(1.0) and row["margin"] == pytest.approx(1 / 1.8 + 1 / 2.1 - 1)
    assert one(spark, X.devig(F.lit(0.9), F.lit(2.1))) is None
    assert one(spark, X.expected_value(F.lit(0.5), F.lit(2.0))) == pytest.approx(0.0)


@pytest.mark.parametrize("slug,year,game,date", [
    ("major-fall-2023-x", 2023, "cs2", "2023-10-15"), ("cup-spring-2023", 2023, "csgo", "2023-04-15"),
    ("cup-2024", 2024, "cs2", "2024-07-01"), ("open-120245-cup", None, "csgo", "")])
def test_slugs(spark, slug, year, game, date):
    s = F.lit(slug)
    row = spark.range(1).select(X.slug_year(s).alias("y"), X.slug_game(s).alias("g"), X.slug_date(s).alias("d")).first()
    assert (row["y"], row["g"], row["d"]) == (year, game, date)


@pytest.mark.parametrize("label,key", [
    ("Nick (Real Name), UA", "nick|ua"), ("Nick, UA", "nick|ua"), ("Nick", "nick|"), ("A (B), c), FR", "a|fr")])
def test_key_of(spark, label, key):
    assert one(spark, X.key_of(F.lit(label))) == key


def test_name_key_and_labels(spark):
    assert one(spark, X.name_key(F.lit("Данил «donk»  Крышковец"))) == "данил крышковец"
    label = X.player_label(F.lit("ace"), F.lit("Ann 'ace' Lee"), F.lit("denmark"))
    assert one(spark, label) == "ace (Ann Lee), DK"
    assert one(spark, X.short_label(F.lit(" ace "), F.lit("Atlantis"))) == "ace"
    row = one(spark, X.parse_label(F.lit("Ace (Ann Lee), DK")))
    assert (row["nick"], row["cc"]) == ("ace", "dk")
    assert one(spark, X.parse_label(F.lit("Ace, DK"))) is None


def test_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert f_upper(3.0, 2, 100) == pytest.approx(0.0542885, abs=1e-5)
    assert chi2_upper_one(3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert t_quantile(0.975, 8) == pytest.approx(2.306004, abs=1e-5)
    assert math.isclose(t_two_sided(0.0, 5), 1.0)


def test_numbers_are_rendered_from_their_exact_value(spark):
    values = [0.25, 0.35, 2.5, 1234567.125, 0.125, -0.25, -0.001, 99999.995, 0.0, 0.0025, 0.0035]
    rows = spark.createDataFrame([(v,) for v in [*values, float("inf"), None]], "x double").select(
        "x", X.render_number(F.col("x"), 2).alias("n"), X.render_share(F.col("x")).alias("s"),
        X.fixed_point(F.col("x"), 2, "+").alias("signed")).collect()
    for r in rows:
        if r["x"] is None:
            assert (r["n"], r["s"], r["signed"]) == ("—", "—", None)
        else:
            assert (r["n"], r["s"], r["signed"]) == (f"{r['x']:.2f}", f"{r['x'] * 100.0:.1f}%", f"{r['x']:+.2f}")
