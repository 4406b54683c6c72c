"""Aggregates and reports per team, pair, month, event, map, opponent and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.scalar import fixed_point
from faceoff.operators.history import TEAM, Timeline, longest_runs, prior_totals
from faceoff.operators.longform import side_long


# ---- joins used by several reports ----------------------------------------------------------
def join_sides(contests: DataFrame, per_side: DataFrame, columns: list[str]) -> DataFrame:
    """Bring per-(match, side) features back as one row per match with _t1/_t2 columns.

    A conditional aggregate on match_id replaces two joins on (match_id, team): one shuffle, and
    it cannot fan out.
    """
    wide = per_side.groupBy("match_id").agg(*[
        F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{c}_t{n}") for c in columns for n in (1, 2)])
    return contests.join(wide, "match_id", "left")


def winner_month_share(matches: DataFrame) -> DataFrame:
    """Each match with the winner's share of wins in that month."""
    long = side_long(matches)
    month = F.trunc("datetime", "month")
    shares = long.groupBy("team", month.alias("month")).agg(F.avg("win").alias("win_share"))
    keyed = matches.select("match_id", "datetime", "winner", month.alias("month"))
    return keyed.join(shares.withColumnRenamed("team", "winner"), ["winner", "month"], "left")


def on_month_spine(bounds_from: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """Every month between the first and the last contest, with missing counts as zero."""
    months = bounds_from.agg(
        F.trunc(F.min("datetime"), "month").alias("a"), F.trunc(F.max("datetime"), "month").alias("z")
    ).select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(counts, "month", "left").select(
        "month", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def only_active(matches: DataFrame, at_least: int) -> DataFrame:
    """Contests whose two sides both played at least so many contests."""
    active = side_long(matches).groupBy("team").count().where(F.col("count") >= at_least).select("team")
    return matches.join(active.withColumnRenamed("team", "team1"), "team1", "left_semi").join(
        active.withColumnRenamed("team", "team2"), "team2", "left_semi")


def unmatched(series: DataFrame, maps: DataFrame) -> DataFrame:
    """Ids of contests that have no map row."""
    return series.select("match_id").distinct().join(maps.select("match_id"), "match_id", "left_anti")


# ---- basic records --------------------------------------------------------------------------
def record_columns(win: str = "won", prefix: str = "") -> list[Column]:
    flag = F.col(win).cast("int")
    return [
        F.coalesce(F.sum(flag), F.lit(0)).alias(f"{prefix}wins"),
        F.coalesce(F.sum(1 - flag), F.lit(0)).alias(f"{prefix}losses"),
        F.avg(flag).alias(f"{prefix}win_rate"),
    ]


def win_loss_record(df: DataFrame, by: list[str], win: str = "won") -> DataFrame:
    return df.groupBy(*by).agg(*record_columns(win)) if by else df.agg(*record_columns(win))


def team_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("team").agg(
        F.count("*").alias("n_series"), F.sum("win").alias("n_wins"), F.avg("win").alias("win_share"))


def monthly_upsets(matches: DataFrame, pre_month: bool = False) -> DataFrame:
    """Per month: contests, upsets (the winner's share below one half), rate; empty months kept.

    ``pre_month`` uses the winner's share over all earlier months instead of the same month
    (a winner without earlier contests counts as an upset, as a missing share does).
    """
    month = F.trunc("datetime", "month")
    if pre_month:
        cells = side_long(matches).groupBy("team", month.alias("month")).agg(
            F.sum("win").alias("w"), F.count("*").alias("n"))
        run = prior_totals(cells, Timeline(("team",), ("month",)), {
            "pw": ("sum", F.col("w")), "pn": ("sum", F.col("n"))})
        shares = run.select("team", "month", F.try_divide(F.col("pw"), F.col("pn")).alias("win_share"))
        rows = matches.select("winner", month.alias("month")).join(
            shares.withColumnRenamed("team", "winner"), ["winner", "month"], "left")
    else:
        rows = winner_month_share(matches)
    upset = (F.coalesce("win_share", F.lit(0.0)) < 0.5).cast("int")
    counts = rows.groupBy("month").agg(F.count("*").alias("n_series"), F.sum(upset).alias("n_upsets"))
    rate = F.coalesce(F.try_divide(F.col("n_upsets"), F.col("n_series")), F.lit(0.0))
    return on_month_spine(matches, counts, ["n_series", "n_upsets"]).withColumn("upset_rate", rate)


def pair_record(long: DataFrame, at_least: int = 4, oriented: bool = True) -> DataFrame:
    rows = long if oriented else long.where(F.col("team") < F.col("opponent"))
    return rows.groupBy(F.col("team").alias("team_a"), F.col("opponent").alias("team_b")).agg(
        F.sum("win").alias("a_wins"), F.sum(1 - F.col("win")).alias("b_wins"),
        F.count("*").alias("n")).where(F.col("n") >= at_least)


def top_share(matches: DataFrame, at_least: int = 20, top: int = 15) -> DataFrame:
    margin = F.abs(F.col("t1_series_score") - F.col("t2_series_score"))
    return side_long(matches.withColumn("margin", margin), ("match_id", "margin")).groupBy("team").agg(
        F.count("*").alias("n_series"), F.sum("win").alias("n_wins"), F.avg("win").alias("win_share"),
        F.avg("margin").alias("mean_margin"),
    ).where(F.col("n_series") >= at_least).orderBy(F.desc("win_share"), "team").limit(top)


def mean_by_tier(matches: DataFrame) -> DataFrame:
    margin = F.abs(F.col("t1_series_score") - F.col("t2_series_score"))
    return matches.groupBy("tier").agg(F.avg(margin).alias("mean_margin"), F.count("*").alias("n"))


def format_specialists(matches: DataFrame, at_least: int = 30, per_format: int = 10) -> DataFrame:
    long = side_long(matches, ("match_id", "games_played"))
    bo1, bo3 = F.col("games_played") == 1, F.col("games_played") >= 2
    return long.groupBy("team").agg(
        F.count("*").alias("n"), F.count_if(bo1).alias("n1"), F.count_if(bo3).alias("n3"),
        F.avg(F.when(bo1, F.col("win"))).alias("bo1_share"),
        F.avg(F.when(bo3, F.col("win"))).alias("bo3_share"),
    ).where((F.col("n") >= at_least) & (F.col("n1") >= per_format) & (F.col("n3") >= per_format)).select(
        "team", "bo1_share", "bo3_share", (F.col("bo1_share") - F.col("bo3_share")).alias("diff"))


def _swept() -> Column:
    zero = (F.col("t1_series_score") == 0) | (F.col("t2_series_score") == 0)
    return (zero & (F.col("games_played") >= 2)).cast("int")


def sweep_rate_over_time(matches: DataFrame) -> DataFrame:
    """Sweep share by month and by year in one pass."""
    return matches.select(
        _swept().alias("swept"), F.inline(F.array(
            F.struct(F.lit("month").alias("grain"), F.date_format("datetime", "yyyy-MM").alias("period")),
            F.struct(F.lit("year").alias("grain"), F.date_format("datetime", "yyyy").alias("period"))))
    ).groupBy("grain", "period").agg(F.avg("swept").alias("sweep_rate"), F.count("*").alias("n"))


def first_listed_bias(matches: DataFrame) -> DataFrame:
    """Win share of the side listed first, overall and per tier."""
    return matches.rollup("tier").agg(
        F.avg((F.col("winner") == F.col("team1")).cast("int")).alias("team1_win_share"),
        F.count("*").alias("n"),
    ).select(F.coalesce("tier", F.lit("ALL")).alias("tier"), "team1_win_share", "n")


def series_per_team(long: DataFrame) -> DataFrame:
    """Distribution of contests per team: count, mean, std (ddof 1), min, quartiles, max."""
    from faceoff.operators.ordering import exact_quantiles

    per_team = long.groupBy("team").agg(F.count("*").alias("n"))
    base = per_team.agg(F.count("*").alias("teams"), F.avg("n").alias("mean"),
                        F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))
    quart = exact_quantiles(per_team, [], "n", [0.25, 0.5, 0.75]).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.crossJoin(quart)      # two one-row frames


def top_tournaments(matches: DataFrame, top: int = 10) -> DataFrame:
    return matches.groupBy("tournament").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "tournament").limit(top)


def map_baseline(maps: DataFrame) -> DataFrame:
    return maps.groupBy("map_name").agg(F.avg("team1_win").alias("team1_win_rate"), F.count("*").alias("n"))


def digest(df: DataFrame, columns: list[str], ts: str = "datetime") -> DataFrame:
    """Rows, latest date and mean/std (ddof 0) per column, in one aggregate."""
    wide = df.agg(
        F.count("*").alias("rows"), F.to_date(F.max(ts)).alias("latest"),
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)])
    stats = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{i}").alias("mean"),
                               F.col(f"s_{i}").alias("std")) for i, c in enumerate(columns)])
    return wide.select("rows", "latest", F.inline(stats))


def digest_drift(before: DataFrame, after: DataFrame, sigma: float = 0.25) -> DataFrame:
    """Compare two digests: row loss, a latest date that did not move, shifted means."""
    a = before.select("column_name", *[F.col(c).alias(f"{c}_before") for c in ("rows", "latest", "mean", "std")])
    b = after.select("column_name", *[F.col(c).alias(f"{c}_after") for c in ("rows", "latest", "mean")])
    scale = F.when(F.coalesce("std_before", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std_before"))
    return a.join(b, "column_name", "full").withColumns({
        "rows_delta": F.col("rows_after") - F.col("rows_before"),
        "mean_shift": F.col("mean_after") - F.col("mean_before"),
        "shift_flag": F.abs(F.col("mean_after") - F.col("mean_before")) > sigma * scale,
        "rows_fell": F.col("rows_after") < F.col("rows_before"),
        "stale": F.col("latest_after") <= F.col("latest_before"),
    }).select("column_name", "rows_delta", "mean_shift", "shift_flag", "rows_fell", "stale")


def coverage_stats(rows: DataFrame, stats=("kills", "deaths", "assists", "adr", "kast")) -> DataFrame:
    """What a source covers: maps, events, dated share, window, complete lineups, null shares."""
    return rows.groupBy("game").agg(
        F.count("*").alias("maps"), F.countDistinct("match_id").alias("matches"),
        F.countDistinct("tournament").alias("events"),
        F.avg(F.col("datetime").isNotNull().cast("int")).alias("dated_share"),
        F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        F.count("team1_player5").alias("with_player5"),
        *[F.avg(F.col(f"team1_player5_{s}").isNull().cast("int")).alias(f"null_{s}") for s in stats],
        F.min("team1_player1_kast").alias("kast_min"), F.max("team1_player1_kast").alias("kast_max"))


# ---- one team's report ----------------------------------------------------------------------
def _text_record(w: str, l: str) -> Column:
    return F.concat_ws("-", F.col(w).cast("string"), F.col(l).cast("string"))


def event_table(vs: DataFrame, vm: DataFrame) -> DataFrame:
    """Per event: contest and map record, covered maps out of expected, dates."""
    series = vs.groupBy("event").agg(
        F.count("*").alias("series"), *record_columns(), F.sum("maps_played").alias("expected_maps"),
        F.to_date(F.min("datetime")).alias("first"), F.to_date(F.max("datetime")).alias("last"))
    maps = vm.groupBy("event").agg(F.count("*").alias("maps"), *record_columns(prefix="map_"))
    return series.join(maps, "event", "left").select(
        "event", "series", _text_record("wins", "losses").alias("series_record"),
        F.concat_ws("-", F.coalesce("map_wins", F.lit(0)), F.coalesce("map_losses", F.lit(0))).alias("map_record"),
        "map_win_rate",
        F.concat_ws("/", F.coalesce("maps", F.lit(0)), "expected_maps").alias("map_coverage"),
        "first", "last")


def month_table(vs: DataFrame, vm: DataFrame) -> DataFrame:
    month = F.date_format("datetime", "yyyy-MM").alias("month")
    series = vs.groupBy(month).agg(
        F.count("*").alias("series"), *record_columns(), F.avg("elo").alias("_elo"))
    maps = vm.groupBy(month).agg(F.count("*").alias("maps"), *record_columns(prefix="map_"))
    return series.join(maps, "month", "left").select(
        "month", "series", _text_record("wins", "losses").alias("record"),
        F.col("win_rate").alias("series_win_rate"), F.coalesce("maps", F.lit(0)).alias("maps"),
        "map_win_rate", F.round("_elo", 1).alias("avg_elo"))


def map_table(vm: DataFrame) -> DataFrame:
    return vm.groupBy(F.col("map_name").alias("map")).agg(
        F.count("*").alias("maps"), *record_columns(), F.round(F.avg("round_diff"), 2).alias("avg_round_diff"),
        F.count_if("overtime").alias("overtime"),
    ).select("map", "maps", _text_record("wins", "losses").alias("record"), "win_rate",
             "avg_round_diff", "overtime")


def opponent_table(vs: DataFrame, vm: DataFrame) -> DataFrame:
    series = vs.groupBy("opponent").agg(
        F.count("*").alias("series"), *record_columns(), F.avg("opp_elo").alias("_elo"))
    maps = vm.groupBy("opponent").agg(*record_columns(prefix="map_"))
    return series.join(maps, "opponent", "left").select(
        "opponent", "series", _text_record("wins", "losses").alias("record"), "win_rate",
        F.concat_ws("-", F.coalesce("map_wins", F.lit(0)), F.coalesce("map_losses", F.lit(0))).alias("map_record"),
        F.round("_elo", 1).alias("avg_opp_elo"))


def format_table(vs: DataFrame) -> DataFrame:
    label = F.when(F.col("bo").isin(1, 3, 5), F.concat(F.lit("Bo"), F.col("bo").cast("int").cast("string"))).otherwise("unknown")
    return vs.groupBy(label.alias("format")).agg(F.count("*").alias("series"), *record_columns()).select(
        "format", "series", _text_record("wins", "losses").alias("record"), "win_rate")


def closeness(vm: DataFrame, vs: DataFrame) -> DataFrame:
    """One row: close maps, overtimes, deciders, sweeps and one-map losses."""
    won = F.col("won").cast("int")
    maps = vm.agg(
        F.count_if("close").alias("close_maps"), F.avg(F.when(F.col("close"), won)).alias("close_map_win_rate"),
        F.count_if("overtime").alias("overtime_maps"),
        F.avg(F.when(F.col("overtime"), won)).alias("overtime_win_rate"))
    longer = F.col("bo") > 1
    series = vs.agg(
        F.count_if("went_the_distance").alias("decider_series"),
        F.avg(F.when(F.col("went_the_distance"), won)).alias("decider_win_rate"),
        F.count_if(F.col("won") & (F.col("score_against") == 0) & longer).alias("sweeps_for"),
        F.count_if(~F.col("won") & (F.col("score_for") == 0) & longer).alias("sweeps_against"),
        F.count_if(~F.col("won") & (F.col("loss_margin") == 1)).alias("one_map_losses"),
        F.count_if(F.col("bo") == 1).alias("bo1"))
    return maps.crossJoin(series)      # two one-row frames


def elo_section(vs: DataFrame) -> DataFrame:
    """One row: first/last/peak/low rating, hardest opponent, expected against actual wins."""
    seq = F.struct("datetime", "match_id")
    backwards = F.struct(-F.unix_micros(F.col("datetime").cast("timestamp")), -F.col("match_id"))
    peak = F.struct(F.col("elo"), backwards)
    hard = F.struct(F.col("opp_elo"), backwards)
    return vs.agg(
        F.round(F.min_by("elo", seq), 1).alias("elo_start"), F.round(F.max_by("elo", seq), 1).alias("elo_end"),
        F.round(F.max("elo"), 1).alias("elo_peak"), F.to_date(F.max_by("datetime", peak)).alias("elo_peak_date"),
        F.round(F.min("elo"), 1).alias("elo_low"), F.round(F.avg("opp_elo"), 1).alias("avg_opp_elo"),
        F.max_by("opponent", hard).alias("hardest_opponent"),
        F.round(F.max("opp_elo"), 1).alias("hardest_opponent_elo"),
        F.round(F.sum("p_win"), 1).alias("expected_series_wins"),
        F.sum(F.col("won").cast("int")).alias("actual_series_wins"),
        F.round(F.sum(F.col("won").cast("int")) - F.sum("p_win"), 1).alias("delta_vs_elo"))


def team_expected(long_ratings: DataFrame) -> DataFrame:
    """Expected and actual wins of every team from pre-match probabilities."""
    return long_ratings.groupBy("team").agg(
        F.sum("p").alias("expected_wins"), F.sum("win").alias("actual_wins"),
        (F.sum("win") - F.sum("p")).alias("delta"))


def rated_long(replayed: DataFrame) -> DataFrame:
    """Two rows per contest: team, opponent, ratings, win probability and result of that side."""
    def side(n: int) -> Column:
        p = F.col("p_t1") if n == 1 else 1.0 - F.col("p_t1")
        return F.struct(
            F.col(f"team{n}").alias("team"), F.col(f"team{3 - n}").alias("opponent"),
            F.col(f"elo_t{n}_pre").alias("elo"), F.col(f"elo_t{3 - n}_pre").alias("opp_elo"),
            p.alias("p"), (F.col("winner") == F.col(f"team{n}")).cast("int").alias("win"))
    return replayed.select("match_id", "datetime", F.inline(F.array(side(1), side(2))))


def best_worst(vs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` wins over the highest rated and the ``k`` losses to the lowest rated opponents."""
    wins = vs.where("won").orderBy(F.desc("opp_elo"), "datetime", "match_id").limit(k).withColumn("kind", F.lit("win"))
    losses = vs.where(~F.col("won")).orderBy("opp_elo", "datetime", "match_id").limit(k).withColumn("kind", F.lit("loss"))
    return wins.unionByName(losses)


def player_table(players: DataFrame) -> DataFrame:
    """Per player of one team: totals, means, first and last map. Needs ``player_long`` rows."""
    from faceoff.operators.clean import kast_fraction

    return players.groupBy("player").agg(
        F.count("*").alias("maps"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"),
        F.coalesce(F.sum("assists"), F.lit(0.0)).alias("assists"), F.avg("adr").alias("adr"),
        F.avg("kast").alias("_kast"), F.avg(F.col("won").cast("int")).alias("map_win_rate"),
        F.min("datetime").alias("first"), F.max("datetime").alias("last"),
    ).withColumns({
        "kast": kast_fraction(F.col("_kast")), "kd": F.try_divide(F.col("kills"), F.col("deaths")),
    }).drop("_kast")


def lineup_table(maps: DataFrame, team: str) -> DataFrame:
    """Distinct fives of one team with contests, maps and dates."""
    home = F.col("team1") == team
    slots = F.array(*[F.when(home, F.col(f"team1_player{i}")).otherwise(F.col(f"team2_player{i}"))
                      for i in range(1, 6)])
    label = F.array_join(F.array_sort(F.filter(slots, lambda x: x.isNotNull())), " / ")
    return maps.where((F.col("team1") == team) | (F.col("team2") == team)).groupBy(
        label.alias("lineup")).agg(
        F.countDistinct("match_id").alias("series"), F.countDistinct("game_id").alias("maps"),
        F.min("datetime").alias("first"), F.max("datetime").alias("last"))


def _percent(value: Column, digits: int) -> Column:
    return F.concat(_decimals(value * 100.0, digits), F.lit("%"))


def _decimals(value: Column, digits: int, sign: str = "") -> Column:
    return F.coalesce(fixed_point(value, digits, sign), F.lit("null"))


def summary_long(team: str, window: str, vs: DataFrame, vm: DataFrame, players: DataFrame,
                 fives: DataFrame) -> DataFrame:
    """Every quotable figure in one (section, metric, value, extra) table.

    Sections are small aggregates turned to text; only their typed results meet in the union.
    Section and metric names and the wording of value and extra are fixed values, the output contract.
    """
    def rows(df: DataFrame, section: str, *metrics: tuple[Column | str, Column, Column | None]) -> DataFrame:
        entries = [F.struct(
            F.lit(section).alias("section"),
            (F.lit(m) if isinstance(m, str) else m).alias("metric"),
            v.cast("string").alias("value"),
            (F.lit("") if e is None else F.coalesce(e, F.lit(""))).alias("extra")) for m, v, e in metrics]
        return df.select(F.inline(F.array(*entries)))

    c = F.col
    head = vs.agg(
        F.to_date(F.min("datetime")).alias("first"), F.to_date(F.max("datetime")).alias("last"),
        F.countDistinct("event").alias("events"), F.countDistinct("opponent").alias("opponents"),
        F.sum("maps_played").alias("expected"), *record_columns())
    map_head = vm.agg(F.count("*").alias("n_maps"), *record_columns(prefix="map_"))
    missing = unmatched(vs, vm).agg(F.count("*").alias("no_rows"))
    runs = longest_runs(vs.select(F.lit(team).alias("team"), "datetime", "match_id", c("won").cast("int").alias("win")),
                        TEAM).drop("team")
    one = head.crossJoin(map_head).crossJoin(missing).crossJoin(runs)      # one-row frames
    parts = [rows(
        one, "headline",
        ("team", F.lit(team), None), ("window_requested", F.lit(window), None),
        ("first_series", c("first"), None), ("last_series", c("last"), None),
        ("events", c("events"), None), ("opponents", c("opponents"), None),
        ("series", _text_record("wins", "losses"), F.concat(F.lit("win rate "), _percent(c("win_rate"), 1))),
        ("maps", _text_record("map_wins", "map_losses"), F.concat(F.lit("win rate "), _percent(c("map_win_rate"), 1))),
        ("maps_expected_from_series", c("expected"), None),
        ("maps_with_rows", c("n_maps"), F.concat(F.lit("coverage "), _percent(F.try_divide(c("n_maps"), c("expected")), 1))),
        ("series_without_map_rows", c("no_rows"), F.lit("series-level facts still counted; map-level facts cannot")),
        ("longest_win_streak", c("longest_win_run"), None), ("longest_loss_streak", c("longest_loss_run"), None),
        ("series_win_rate", _decimals(c("win_rate"), 4), None),
        ("map_win_rate", _decimals(c("map_win_rate"), 4), None))]
    parts.append(rows(format_table(vs), "format", (c("format"), c("record"), _percent(c("win_rate"), 1))))
    won = lambda rate: F.concat(_percent(c(rate), 1), F.lit(" won"))
    parts.append(rows(
        closeness(vm, vs), "closeness",
        ("close_maps_abs_diff_le_2", c("close_maps"), won("close_map_win_rate")),
        ("overtime_maps", c("overtime_maps"), won("overtime_win_rate")),
        ("series_going_the_distance", c("decider_series"), won("decider_win_rate")),
        ("sweeps_for", c("sweeps_for"), None), ("sweeps_against", c("sweeps_against"), None),
        ("series_lost_by_one_map", c("one_map_losses"), None)))
    f1 = lambda name: _decimals(c(name), 1)
    parts.append(rows(
        elo_section(vs), "elo",
        ("elo_window_start", f1("elo_start"), None), ("elo_window_end", f1("elo_end"), None),
        ("elo_peak", f1("elo_peak"), c("elo_peak_date").cast("string")), ("elo_window_low", f1("elo_low"), None),
        ("avg_opponent_elo", f1("avg_opp_elo"), None), ("hardest_opponent", c("hardest_opponent"), f1("hardest_opponent_elo")),
        ("expected_series_wins_by_elo", f1("expected_series_wins"), None),
        ("actual_series_wins", c("actual_series_wins"), None), ("delta_vs_elo_expectation", f1("delta_vs_elo"), None)))
    parts.append(rows(event_table(vs, vm), "event", (c("event"), c("series_record"), F.concat(
        F.lit("maps "), c("map_record"),
        F.coalesce(F.concat(F.lit(" ("), _percent(c("map_win_rate"), 0), F.lit(")")), F.lit("")),
        F.lit(", map rows "), c("map_coverage"), F.lit(" | "), c("first"), F.lit(".."), c("last")))))
    parts.append(rows(month_table(vs, vm), "month", (c("month"), c("record"), F.concat(
        F.lit("maps "), c("maps"), F.lit(", map wr "), F.coalesce(_percent(c("map_win_rate"), 0), F.lit("n/a")),
        F.lit(", avg elo "), f1("avg_elo")))))
    parts.append(rows(map_table(vm), "map", (c("map"), c("record"), F.concat(
        _percent(c("win_rate"), 0), F.lit(" over "), c("maps"), F.lit(", avg round diff "),
        _decimals(c("avg_round_diff"), 2, "+"), F.lit(", OT "), c("overtime")))))
    parts.append(rows(opponent_table(vs, vm), "opponent", (c("opponent"), c("record"), F.concat(
        _percent(c("win_rate"), 0), F.lit(", maps "), c("map_record"), F.lit(", avg opp elo "), f1("avg_opp_elo")))))
    day = lambda name: F.to_date(c(name)).cast("string")
    parts.append(rows(players, "player", (c("player"), F.concat(c("maps"), F.lit(" maps")), F.concat(
        F.lit("K/D "), _decimals(c("kd"), 2), F.lit(", ADR "), f1("adr"), F.lit(", KAST "),
        _percent(c("kast"), 1), F.lit(", map wr "), _percent(c("map_win_rate"), 0), F.lit(", "),
        day("first"), F.lit(".."), day("last")))))
    parts.append(rows(fives, "lineup", (c("lineup"), F.concat(c("series"), F.lit(" series")), F.concat(
        c("maps"), F.lit(" maps, "), day("first"), F.lit(".."), day("last")))))
    return reduce(DataFrame.unionByName, parts)
