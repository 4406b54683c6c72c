"""The pre-match feature store and the matrix that models see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.operators.evaluate import with_split
from faceoff.operators.history import (TEAM, Frames, Timeline, h2h_before, over_frame, roster_features,
                                       rolling_form_strict, sided_lineups)
from faceoff.operators.longform import side_long
from faceoff.operators.teams import join_sides

# ---- fixed values: the feature contract -----------------------------------------------------
DEFAULT_FEATURES = ("elo_diff", "form5_diff", "rest_days_diff", "is_bo1", "tier")
ALLOWED_FEATURES = frozenset({
    "elo_diff", "form5_diff", "rest_days_diff", "is_bo1", "h2h_t1_win_share",
    "roster_stability_diff", "standin_diff", "bo1_elo",
})
FORBIDDEN_FEATURES = frozenset({
    "games_played", "margin", "swept", "result", "winner", "t1_series_score", "t2_series_score",
    "total_maps", "bo5_sweep",
})
ROSTER_FEATURES = ("roster_stability_diff", "standin_diff")
NEUTRAL = {"form5": 0.5, "rest_days": 7.0, "stability": 0.5, "standin": 0.0}
# ---------------------------------------------------------------------------------------------


class LeakageError(ValueError):
    """A requested feature describes the outcome or is not known to be pre-match."""


def form_and_rest(long: DataFrame, line: Timeline = TEAM, n: int = 5) -> DataFrame:
    """``form5`` and fractional ``rest_days`` from one shared window."""
    ts = line.order[0]

    def make(f: Frames) -> dict[str, Column]:
        gap = (F.unix_micros(F.col(ts).cast("timestamp"))
               - F.unix_micros(F.lag(ts).over(f.ordered).cast("timestamp")))
        return {"form5": F.avg("win").over(f.rows(-n, -1)), "rest_days": gap / 86_400_000_000.0}
    return over_frame(long, line, n, 0, make)


def build_features(replayed: DataFrame, lineups: DataFrame | None = None, team_line: Timeline = TEAM,
                   pair_line: Timeline = Timeline(("pair_a", "pair_b"))) -> DataFrame:
    """One row per contest, pre-match columns plus ``result``.

    ``replayed`` carries the ratings (one row per contest); ``lineups`` are ``sided_lineups`` rows.
    Team history needs one exchange on team, head-to-head one on the pair; everything then meets
    on match_id, where each side is already one row per contest and cannot fan out.
    """
    neutral = {k: F.lit(v) for k, v in NEUTRAL.items()}
    sides = form_and_rest(side_long(replayed), team_line)
    h2h = h2h_before(replayed.select("match_id", "datetime", "team1", "team2", "winner"), pair_line).select(
        "match_id", "h2h_t1_win_share")
    base = replayed.select("match_id", "datetime", "tier", "games_played", "elo_t1_pre", "elo_t2_pre", "result")
    wide = join_sides(base, sides, ["form5", "rest_days"]).join(h2h, "match_id", "left")
    if lineups is not None:
        wide = join_sides(wide, roster_features(lineups, team_line), ["stability", "standin"])
    else:
        wide = wide.withColumns({f"{c}_t{n}": F.lit(None).cast("double") for c in ("stability", "standin") for n in (1, 2)})

    def diff(name: str) -> Column:
        return F.coalesce(f"{name}_t1", neutral[name]) - F.coalesce(f"{name}_t2", neutral[name])

    elo_diff = F.col("elo_t1_pre") - F.col("elo_t2_pre")
    is_bo1 = F.col("games_played") == 1
    return wide.select(
        "match_id", "datetime", "tier", is_bo1.alias("is_bo1"), elo_diff.alias("elo_diff"),
        diff("form5").alias("form5_diff"), diff("rest_days").alias("rest_days_diff"), "h2h_t1_win_share",
        diff("stability").alias("roster_stability_diff"), diff("standin").alias("standin_diff"), "result",
        (is_bo1.cast("double") * elo_diff).alias("bo1_elo"))


def first_lineups(series_rows: DataFrame) -> DataFrame:
    """Side lineups of the first summary row of every contest."""
    from faceoff.operators.clean import keep_first

    ids = [f"team{n}_player{i}_id" for n in (1, 2) for i in range(1, 6)]
    slim = series_rows.select("match_id", "seq", "datetime", "team1", "team2", *ids)
    return sided_lineups(keep_first(slim, ["match_id"], ["seq"])).where(F.col("team").isNotNull())


def verify_features(store: DataFrame, matches: DataFrame, sample: int | None = None) -> DataFrame:
    """Recompute form and head-to-head by the strict-time rule and count disagreements.

    ``sample`` checks that many contests picked by a hash of the id; by default all are checked.
    """
    rows = store.select("match_id", "form5_diff", "h2h_t1_win_share")
    if sample is not None:
        rows = rows.orderBy(F.md5(F.col("match_id").cast("string"))).limit(sample)
    form = rolling_form_strict(side_long(matches))
    again = join_sides(matches.select("match_id"), form, ["form"]).select(
        "match_id", (F.col("form_t1") - F.col("form_t2")).alias("_form"))
    keyed = matches.select("match_id", "datetime", F.least("team1", "team2").alias("a"),
                           F.greatest("team1", "team2").alias("b"), "team1", "winner")
    cells = keyed.groupBy("a", "b", "datetime").agg(
        F.count("*").alias("n"), F.sum((F.col("winner") == F.col("a")).cast("int")).alias("w"))
    from faceoff.operators.history import prior_totals

    run = prior_totals(cells, Timeline(("a", "b"), ("datetime",)), {
        "pn": ("sum", F.col("n")), "pw": ("sum", F.col("w"))}).drop("n", "w")
    share = F.coalesce(F.try_divide(F.col("pw"), F.col("pn")), F.lit(0.5))
    strict = keyed.join(run, ["a", "b", "datetime"]).select(
        "match_id", F.when(F.col("team1") == F.col("a"), share).otherwise(1.0 - share).alias("_h2h"))
    joined = rows.join(again, "match_id", "left").join(strict, "match_id", "left")
    return joined.agg(
        F.count("*").alias("checked"),
        F.count_if(F.coalesce(F.abs(F.col("form5_diff") - F.col("_form")) > 1e-9, F.lit(True))).alias("form_mismatches"),
        F.count_if(F.coalesce(F.abs(F.col("h2h_t1_win_share") - F.col("_h2h")) > 1e-9, F.lit(True))).alias("h2h_mismatches"))


def feature_summary(store: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std (ddof 1), min, max per feature in one aggregate."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = store.agg(*[fn(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, fn in fns.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}_{i}").alias(k) for k in fns])
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def leakage_guard(names: list[str], extra: list[str] = ()) -> None:
    """Refuse everything that is not on the allowlist; post-outcome names always."""
    for name in extra:
        if name in FORBIDDEN_FEATURES:
            raise LeakageError(f"forbidden post-outcome feature {name!r}")
        if name not in ALLOWED_FEATURES:
            raise LeakageError(f"extra feature {name!r} is not allowlisted as pre-match")
    for name in names:
        if name == "tier" or name.startswith("tier_") or name in extra:
            continue
        if name in FORBIDDEN_FEATURES or name not in ALLOWED_FEATURES:
            raise LeakageError(f"feature {name!r} is not on the pre-match allowlist")


def leakage_report(rows: DataFrame, key: str = "match_id") -> DataFrame:
    """What the guard says of every column of a table: feature, verdict (pre_match, post_outcome, not_listed), values known."""
    names = [n for n in rows.columns if n != key]
    counts = rows.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)])

    def verdict(name: str) -> str:
        try:
            leakage_guard([], [name])
        except LeakageError:
            return "post_outcome" if name in FORBIDDEN_FEATURES else "not_listed"
        return "pre_match"

    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(verdict(n)).alias("verdict"), F.col(f"n{i}").alias("n_values")) for i, n in enumerate(names)])))


def feature_columns(store: DataFrame, extra: list[str] = (), tiers: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The store with one-hot tier columns, and the ordered list of model inputs.

    Tiers are a label with a handful of values; they are read from the data unless given.
    """
    leakage_guard(list(DEFAULT_FEATURES), list(extra))
    if tiers is None:
        found = store.select("tier").where("tier IS NOT NULL").distinct().limit(1001).collect()
        if len(found) > 1000:
            raise ValueError("tier has more than 1000 values; it is not a category")
        tiers = sorted(r["tier"] for r in found)
    names: list[str] = []
    for name in [*DEFAULT_FEATURES, *extra]:
        names += [f"tier_{t}" for t in tiers] if name == "tier" else [name]
    missing = [n for n in names if not n.startswith("tier_") and n not in store.columns]
    if missing:
        raise KeyError(f"requested features not in the store: {missing}")
    one_hot = {f"tier_{t}": F.coalesce((F.col("tier") == t), F.lit(False)).cast("double") for t in tiers}
    plain = {n: F.col(n).cast("double") for n in names if not n.startswith("tier_")}
    return store.withColumns({**one_hot, **plain}), names


def feature_matrix(store: DataFrame, extra: list[str] = (), cutoff: str = "1997-06-01",
                   tiers: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """match_id, datetime, tier, features (vector), label, split; a null or NaN input fails the job."""
    from pyspark.ml.feature import VectorAssembler

    wide, names = feature_columns(store, extra, tiers)
    rows = with_split(wide, cutoff)
    assembled = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(rows)
    return assembled.select("match_id", "datetime", "tier", "features", F.col("result").alias("label"), "split"), names
