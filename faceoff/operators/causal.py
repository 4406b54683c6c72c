"""Roster-change study: team panel, event windows, matched controls, difference-in-differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.operators.history import TEAM, Frames, Timeline, over_frame, prior_totals, with_position
from faceoff.operators.ordering import dense_index
from faceoff.session import require_columns, write_and_reread


def _lineup(n: int) -> Column:
    """Sorted five distinct, known, non-blank ids as text; null otherwise."""
    ids = F.array(*[F.trim(F.col(f"team{n}_player{i}_id").cast("string")) for i in range(1, 6)])
    ok = ~F.exists(ids, lambda x: x.isNull() | (x == "")) & (F.size(F.array_distinct(ids)) == 5)
    return F.when(ok, F.array_sort(ids))


def team_match_panel(matches: DataFrame, line: Timeline = TEAM) -> DataFrame:
    """Two rows per contest with roster history. An unknown lineup forgets the earlier one.

    ``pre_stable_matches`` is the distance to the last row that broke a run of equal lineups, so
    the state is a running maximum, not a loop. ``pos`` and ``n_matches`` index the history.
    """
    require_columns(matches, "match_id", "datetime", "team1", "team2", "winner")

    def side(n: int) -> Column:
        own, other = (F.col(f"t{s}_series_score") for s in (n, 3 - n))
        return F.struct(
            F.col(f"team{n}").alias("team"), F.col(f"team{3 - n}").alias("opponent"), F.lit(f"team{n}").alias("side"),
            (F.col("winner") == F.col(f"team{n}")).cast("double").alias("win"),
            (own - other).cast("double").alias("round_diff"), _lineup(n).alias("roster"))

    long = matches.select("match_id", "datetime", "winner", "tier", (F.col("games_played") == 1).alias("is_bo1"),
                          F.inline(F.array(side(1), side(2))))

    def previous(f: Frames) -> dict[str, Column]:
        return {"previous_roster": F.lag("roster").over(f.ordered)}

    known = F.col("roster").isNotNull() & F.col("previous_roster").isNotNull()
    same = known & (F.col("roster") == F.col("previous_roster"))
    rows = over_frame(long, line, 1, 0, previous).withColumns({
        "roster_known": F.col("roster").isNotNull(),
        "roster_changed": F.coalesce(known & ~same, F.lit(False)),
        "change_count": F.when(known, F.size(F.array_except("roster", "previous_roster"))),
    })
    placed = with_position(rows, line)
    broke = F.when(~F.coalesce(same, F.lit(False)), F.col("pos"))
    stable = prior_totals(placed, line, {"_broke": ("max", broke)})
    return stable.withColumn(
        "pre_stable_matches", F.coalesce(F.col("pos") - 1 - F.col("_broke"), F.lit(0)).cast("long")).drop("_broke")


def _check_windows(pre: int, post: int) -> None:
    if pre < 1 or post < 1:
        raise ValueError("pre and post windows must be positive")


def _window_rows(points: DataFrame, panel: DataFrame, pre: int, post: int, keep: list[str]) -> DataFrame:
    """Panel rows at relative positions -pre..post of each point; an equi-join on (team, pos)."""
    wanted = points.select(
        *keep, F.col("team").alias("_team"), F.col("pos").alias("_anchor"),
        F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("relative_match"))
    return wanted.join(panel, (wanted["_team"] == panel["team"]) & (
        wanted["_anchor"] + wanted["relative_match"] == panel["pos"])).drop("_team", "_anchor")


def event_points(panel: DataFrame, pre: int = 5, post: int = 5, min_pre_stable: int = 3,
                 max_post_changes: int = 0, line: Timeline = TEAM) -> DataFrame:
    """Change points with a full window inside the history and few enough later changes."""
    _check_windows(pre, post)

    def make(f: Frames) -> dict[str, Column]:
        changed = F.col("roster_changed").cast("int")
        return {"_before": F.count("*").over(f.rows(-pre, -1)), "_after": F.count("*").over(f.rows(1, post)),
                "_later": F.coalesce(F.sum(changed).over(f.rows(1, post)), F.lit(0))}

    found = over_frame(panel, line, pre, post, make).where(
        F.col("roster_changed") & (F.col("pre_stable_matches") >= min_pre_stable)
        & (F.col("_before") == pre) & (F.col("_after") == post) & (F.col("_later") <= max_post_changes))
    return found.drop("_before", "_after", "_later").withColumn(
        "event_id", F.concat_ws("#", F.lit("event"), "team", F.col("match_id").cast("string")))


def event_windows(panel: DataFrame, pre: int = 5, post: int = 5, min_pre_stable: int = 3,
                  max_post_changes: int = 0, line: Timeline = TEAM) -> DataFrame:
    """Treated windows on a relative timeline; event identity is the team and contest of the change."""
    points = event_points(panel, pre, post, min_pre_stable, max_post_changes, line)
    rows = _window_rows(points, panel, pre, post, ["event_id"])
    return rows.withColumns({
        "treated": F.lit(1), "post": (F.col("relative_match") >= 0).cast("int"), "event_team": F.col("team")})


def eligible_controls(panel: DataFrame, pre: int = 5, post: int = 5, line: Timeline = TEAM) -> DataFrame:
    """Rows with a known lineup and a complete window that contains no roster change."""
    _check_windows(pre, post)

    def make(f: Frames) -> dict[str, Column]:
        w = f.rows(-pre, post)
        return {"_n": F.count("*").over(w), "_changed": F.max(F.col("roster_changed").cast("int")).over(w)}

    return over_frame(panel, line, pre, post, make).where(
        (F.col("_n") == pre + post + 1) & (F.col("_changed") == 0) & F.col("roster_known")).drop("_n", "_changed")


# ---- matched controls -----------------------------------------------------------------------
# Controls are grouped into cells of equal covariates (per tier) and numbered by time inside a
# cell. An event knows its insertion point in every cell it has met, so "the d nearest controls on
# either side" is a lookup of positions: an equi-join, never a pairing of all events with all controls.
# Cells lie in a grid: per tier and covariate, quantile edges over its distinct values, so that a grid
# square holds about ``SQUARE`` cells. An event meets the cells of the squares around its own, of those
# only the ones with a control in its own or a neighbouring time bucket of ``max_days``, and of those only
# the ones nearer than everything outside these squares: they are its rings of equal covariate distance, complete as far as
# they go. Who finds nothing there widens its squares outward. A best candidate is final only when it
# is nearer in days than everything not looked up yet; otherwise the lookup is deepened.
_DAY = 86_400_000_000
#: Cells of a grid square, and edges of one covariate in one tier at most.
SQUARE, EDGES = 64, 1000


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


class _Rings:
    """The cells around every event, met ring by ring outward."""

    def __init__(self, events: DataFrame, controls: DataFrame, covariates: list[str], same_tier: bool, max_days: int) -> None:
        self.covariates, self.n = covariates, len(covariates)
        key = F.struct(*[F.col(c).cast("double").alias(c) for c in covariates])
        known = F.lit(True)
        for c in covariates:
            known = known & F.col(c).isNotNull()
        # equal covariate values with different tiers are different cells; a null tier only matters
        # when the event's own tier is unknown
        cell = F.concat_ws("|", F.coalesce("tier", F.lit("")), F.to_json(key))
        pool = controls.where(known).select(
            F.col("team").alias("c_team"), F.col("match_id").alias("c_match"), F.col("datetime").alias("c_ts"),
            F.coalesce("tier", F.lit("")).alias("_tier"), F.col("pos").alias("c_pos"), key.alias("c_key"), cell.alias("cell"))
        pool = with_position(pool, Timeline(("cell",), ("c_ts", "c_team", "c_match")), "cpos")
        self.pool = write_and_reread(pool, "match-controls")
        cells = self.pool.groupBy("cell", "_tier", "c_key").agg(F.count("*").alias("n_cell"))
        grid = write_and_reread(self._grid(cells), "match-grid")
        bucket = lambda name: F.floor(_micros(name) / (_DAY * (max_days + 1)))
        dated = self.pool.select("cell", bucket("c_ts").alias("_bucket")).distinct()
        self.cells = write_and_reread(cells.join(dated, "cell").join(grid, "_tier").select(
            "cell", "_tier", "c_key", "n_cell", "_bucket", *[self._bin("c_key", i).alias(f"_g{i}") for i in range(self.n)]), "match-cells")
        # an event without a tier may use every tier: it visits each one, so the join stays an equi-join
        own = F.array("tier") if same_tier else F.lit(None).cast("array<string>")
        every = grid.agg(F.collect_set("_tier").alias("_tiers"))
        asked = events.where(known).crossJoin(every).select(
            "event_id", "team", "match_id", "datetime", key.alias("e_key"),
            F.explode(F.when(F.col("tier").isNotNull() & F.lit(same_tier), own).otherwise(F.col("_tiers"))).alias("_tier"))
        self.asked = write_and_reread(asked.withColumn("_bucket", bucket("datetime")).join(grid, "_tier"), "match-asked")

    def _grid(self, cells: DataFrame) -> DataFrame:
        """Quantile edges per tier and covariate."""
        probs = [i / EDGES for i in range(1, EDGES)]
        found = cells.groupBy("_tier").agg(F.count("*").alias("_n"), *[
            F.percentile_approx(F.col("c_key")[c], probs, 10_000).alias(f"_q{i}") for i, c in enumerate(self.covariates)])
        bins = F.least(F.lit(EDGES), F.ceil(F.pow(F.col("_n") / SQUARE, F.lit(1.0 / self.n)))).cast("int")
        steps = F.when(bins > 1, F.sequence(F.lit(1), bins - 1)).otherwise(F.array().cast("array<int>"))

        def edges(quantiles: str) -> Column:
            return F.array_distinct(F.transform(steps, lambda k: F.get(quantiles, (F.floor(k * EDGES / bins) - 1).cast("int"))))

        return found.select("_tier", *[edges(f"_q{i}").alias(f"_e{i}") for i in range(self.n)])

    def _bin(self, key: str, i: int) -> Column:
        return F.size(F.filter(f"_e{i}", lambda x: x <= F.col(key)[self.covariates[i]]))

    def meet(self, waiting: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
        """Rings of (event_id, known, last) events out to ``radius`` squares, and (event_id, known, last) from then on.

        ``known`` is the distance below which all cells have been met, ``last`` the number of rings so far.
        """
        asked = self.asked.join(waiting, "event_id")
        reach = None
        for i, c in enumerate(self.covariates):
            v, at, edges = F.col("e_key")[c], self._bin("e_key", i), F.col(f"_e{i}")
            below = F.when(at - radius > 0, v - F.get(edges, at - radius - 1)).otherwise(float("inf"))
            above = F.when(at + radius < F.size(edges), F.get(edges, at + radius) - v).otherwise(float("inf"))
            side = F.least(below, above)
            reach = side if reach is None else F.least(reach, side)
            asked = asked.withColumn(f"_g{i}", F.explode(F.sequence(F.greatest(F.lit(0), at - radius), F.least(F.size(edges), at + radius))))
        asked = asked.withColumn("_reach", reach / F.sqrt(F.lit(float(self.n))))
        limits = asked.groupBy("event_id", "known", "last").agg(F.min("_reach").alias("_limit"))
        squares = [F.pow(F.col("e_key")[c] - F.col("c_key")[c], F.lit(2)) for c in self.covariates]
        total = squares[0]
        for q in squares[1:]:
            total = total + q
        near = asked.withColumn("_bucket", F.explode(F.array(*[F.col("_bucket") + k for k in (-1, 0, 1)]))).join(
            self.cells, ["_tier", "_bucket", *[f"_g{i}" for i in range(self.n)]]).select(
            "event_id", "datetime", "cell", "n_cell", F.sqrt(total / self.n).alias("distance")).dropDuplicates(["event_id", "cell"])
        near = near.join(limits, "event_id").where((F.col("distance") >= F.col("known")) & (F.col("distance") < F.col("_limit")))
        from pyspark.sql import Window

        ringed = near.withColumn("ring_no", F.col("last") + F.dense_rank().over(Window.partitionBy("event_id").orderBy("distance")))
        ringed = write_and_reread(ringed.select("event_id", "datetime", "cell", "n_cell", "distance", "ring_no"), "match-near")
        # insertion point: how many controls of the cell lie before the event
        marks = ringed.select("cell", F.col("datetime").alias("ts"), F.lit(1).alias("kind"), "event_id", F.lit(0).alias("one"))
        steps = self.pool.join(ringed.select("cell").distinct(), "cell", "left_semi").select(
            "cell", F.col("c_ts").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("event_id"), F.lit(1).alias("one"))
        placed = prior_totals(steps.unionByName(marks), Timeline(("cell",), ("ts", "kind", "event_id")),
                              {"at": ("sum", F.col("one"))}).where("kind = 1").select("cell", "event_id", "at")
        rings = write_and_reread(ringed.join(placed, ["cell", "event_id"]).select("event_id", "ring_no", "cell", "distance", "at", "n_cell"), "match-rings")
        ends = ringed.groupBy("event_id").agg(F.max("ring_no").alias("_end"))
        after = limits.join(ends, "event_id", "left").select("event_id", F.col("_limit").alias("known"), F.coalesce("_end", "last").cast("int").alias("last"))
        return rings, write_and_reread(after, "match-reach")


def _propose(active: DataFrame, pool: DataFrame, rings: DataFrame, taken: DataFrame | None, max_days: int) -> DataFrame:
    """One lookup for every active event: its best free candidate and whether that is final.

    An event looks at ``span`` rings at once. The first ring with a candidate, or with controls
    not looked up yet, decides: its candidate is final when nothing unseen can be as near in days.
    Otherwise the event looks deeper into that ring, or past all of its empty rings.
    """
    reach = active.join(rings, "event_id").where(
        (F.col("ring_no") >= F.col("ring")) & (F.col("ring_no") < F.col("ring") + F.col("span")))
    first = F.greatest(F.lit(1), F.col("at") - F.col("depth") + 1)
    last = F.least(F.col("n_cell"), F.col("at") + F.col("depth"))
    hit = reach.where(first <= last).withColumn("cpos", F.explode(F.sequence(first, last))).join(pool, ["cell", "cpos"])
    hit = hit.withColumn("days", F.floor(F.abs(_micros("c_ts") - _micros("datetime")) / _DAY))
    within = F.col("days") <= max_days
    more_before = (F.col("cpos") == F.col("at") - F.col("depth") + 1) & (F.col("cpos") > 1)
    more_after = (F.col("cpos") == F.col("at") + F.col("depth")) & (F.col("cpos") < F.col("n_cell"))
    usable = within & (F.col("c_team") != F.col("team"))
    if taken is not None:
        held = taken.select("c_team", "c_match", F.col("rank").alias("_held"))
        hit = hit.join(held, ["c_team", "c_match"], "left")
        usable = usable & (F.col("_held").isNull() | (F.col("_held") > F.col("rank")))
    per_ring = hit.groupBy("event_id", "ring_no").agg(
        F.min(F.when(usable, F.struct("distance", "days", "c_team", "c_match", "c_ts", "c_pos"))).alias("best"),
        F.min(F.when((more_before | more_after) & within, F.col("days"))).alias("horizon"))
    decided = per_ring.where("best IS NOT NULL OR horizon IS NOT NULL").groupBy("event_id").agg(
        F.min_by(F.struct("ring_no", "best", "horizon"), "ring_no").alias("_d"))
    ends = rings.groupBy("event_id").agg(F.max("ring_no").alias("last_ring"))
    out = active.join(decided, "event_id", "left").join(ends, "event_id", "left")
    seen = F.col("_d").isNotNull()
    final = seen & F.col("_d.best").isNotNull() & (
        F.col("_d.horizon").isNull() | (F.col("_d.best.days") < F.col("_d.horizon")))
    return out.select(
        *active.columns, "last_ring", F.col("_d.best").alias("best"), F.coalesce(final, F.lit(False)).alias("final"),
        F.when(seen, F.col("_d.ring_no")).otherwise(F.col("ring") + F.col("span")).alias("next_ring"),
        F.when(seen & ~F.coalesce(final, F.lit(False)), F.col("depth") * 4).otherwise(F.col("depth")).alias("next_depth"),
        F.when(seen, F.col("span")).otherwise(F.col("span") * 2).alias("next_span"))


def _start(events: DataFrame) -> DataFrame:
    """Active events with their priority: team, then time."""
    return events.select(
        "event_id", "team", "match_id", "datetime", F.col("pos").alias("e_pos"),
        F.struct("team", "datetime", "match_id").alias("rank"), F.lit(1).alias("ring"),
        F.lit(4).alias("span"), F.lit(16).alias("depth"))


def _pair_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.col("team").alias("treated_team"), F.col("c_team").alias("control_team"),
        F.col("match_id").alias("treated_match_id"), F.col("c_match").alias("control_match_id"),
        F.col("datetime").alias("treated_datetime"), F.col("c_ts").alias("control_datetime"),
        F.col("c_pos").alias("control_pos"), "distance", "days")


def nearest_control(events: DataFrame, controls: DataFrame, covariates: list[str] = ("pre_stable_matches",),
                    max_days: int = 90, same_tier: bool = True) -> DataFrame:
    """Best control of every event, controls reusable. Order: distance, days, team, match."""
    return _match(events, controls, list(covariates), max_days, same_tier, replace=True)


def nearest_control_greedy(events: DataFrame, controls: DataFrame, covariates: list[str] = ("pre_stable_matches",),
                           max_days: int = 90, same_tier: bool = True) -> DataFrame:
    """Each event, in priority order, takes its best control that no earlier event took.

    Computed as deferred acceptance: every unmatched event proposes to its best control not held
    by an earlier event, every control keeps its earliest proposer. All controls share one
    priority, so this ends in the serial result. Each round is a handful of joins whose results
    are written to the shared folder.
    """
    return _match(events, controls, list(covariates), max_days, same_tier, replace=False)


def _match(events, controls, covariates, max_days, same_tier, replace) -> DataFrame:
    near = _Rings(events, controls, covariates, same_tier, max_days)
    active = write_and_reread(_start(events), "match-active")
    radius = 1
    rings, reach = near.meet(active.select("event_id", F.lit(0.0).alias("known"), F.lit(0).alias("last")), radius)
    held: DataFrame | None = None
    state_columns = active.columns
    while True:
        step = write_and_reread(_propose(active, near.pool, rings, None if replace else held, max_days), "match-step")
        offers = step.where("final").select(*state_columns, "best.*")
        if replace:
            held = offers if held is None else held.unionByName(offers)
            lost = None
        else:
            everyone = offers if held is None else held.unionByName(offers)
            keeper = everyone.groupBy("c_team", "c_match").agg(F.min_by(
                F.struct(*[c for c in everyone.columns if c not in ("c_team", "c_match")]), "rank").alias("_k"))
            kept = keeper.select("c_team", "c_match", "_k.*").select(*everyone.columns)
            kept = write_and_reread(kept, "match-held")
            lost = everyone.join(kept.select("event_id"), "event_id", "left_anti").select(*state_columns)
            held = kept
        inside = F.coalesce(F.col("next_ring") <= F.col("last_ring"), F.lit(False))
        open_ = step.where(~F.col("final"))
        following = open_.where(inside).select(
            *[F.col({"ring": "next_ring", "depth": "next_depth", "span": "next_span"}.get(c, c)).alias(c) for c in state_columns])
        if lost is not None:
            following = following.unionByName(lost)
        # who found nothing in its rings widens its squares
        beyond = open_.where(~inside).join(reach.where(F.col("known") < float("inf")), "event_id").select(
            *[(F.col("last") + 1).alias(c) if c == "ring" else F.lit(4).alias(c) if c == "span" else F.lit(16).alias(c) if c == "depth" else F.col(c)
              for c in state_columns], F.lit(True).alias("waits"))
        active = write_and_reread(following.withColumn("waits", F.lit(False)).unionByName(beyond), "match-active")
        left = active.groupBy("waits").count().collect()
        if not left:
            return _pair_columns(held)
        if any(r["waits"] for r in left):
            radius = 2 * radius + 1
            waiting = active.where("waits").select("event_id").join(reach, "event_id")
            more, after = near.meet(waiting, radius)
            rings = rings.unionByName(more)
            reach = write_and_reread(reach.join(after.select("event_id"), "event_id", "left_anti").unionByName(after), "match-reach")
        active = active.drop("waits")


def paired_event_panel(panel: DataFrame, windows: DataFrame, pairs: DataFrame, pre: int = 5, post: int = 5) -> DataFrame:
    """Treated and control windows of every matched pair on one relative timeline."""
    treated = windows.join(pairs.select("event_id"), "event_id", "left_semi")
    anchors = pairs.select("event_id", F.col("treated_team").alias("event_team"),
                           F.col("control_team").alias("team"), F.col("control_pos").alias("pos"))
    control = _window_rows(anchors, panel, pre, post, ["event_id", "event_team"]).withColumns({
        "treated": F.lit(0), "post": (F.col("relative_match") >= 0).cast("int")})
    return treated.unionByName(control.select(*treated.columns))


# ---- estimators -----------------------------------------------------------------------------
def _cell(treated: int, post: int, value: Column) -> Column:
    return F.when((F.col("treated") == treated) & (F.col("post") == post), value)


_CELLS = (("treated_pre", 1, 0), ("treated_post", 1, 1), ("control_pre", 0, 0), ("control_post", 0, 1))


def did_estimate(panel: DataFrame, outcome: str = "win") -> DataFrame:
    """Four cell means, both changes, their difference and the row counts, in one aggregate."""
    require_columns(panel, "treated", "post", outcome)
    y = F.col(outcome)
    out = panel.agg(
        *[F.avg(_cell(t, p, y)).alias(name) for name, t, p in _CELLS],
        F.count(F.when(F.col("treated") == 1, y)).alias("n_treated"),
        F.count(F.when(F.col("treated") == 0, y)).alias("n_control"))
    return out.withColumns({
        "treated_change": F.col("treated_post") - F.col("treated_pre"),
        "control_change": F.col("control_post") - F.col("control_pre"),
        "estimate": (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre")),
    })


def event_study(panel: DataFrame, outcome: str = "win") -> DataFrame:
    y = F.col(outcome)
    one, zero = F.when(F.col("treated") == 1, y), F.when(F.col("treated") == 0, y)
    return panel.groupBy("relative_match").agg(
        F.avg(one).alias("treated_mean"), F.avg(zero).alias("control_mean"),
        F.count(one).alias("treated_n"), F.count(zero).alias("control_n"),
    ).withColumn("difference", F.col("treated_mean") - F.col("control_mean"))


def pretrend_screen(study: DataFrame, limit: float = 0.10) -> DataFrame:
    lead = F.when(F.col("relative_match") < 0, F.abs("difference"))
    return study.agg(
        F.max(F.when(F.col("relative_match") == -1, F.col("difference"))).alias("lead_minus_one"),
        F.max(lead).alias("max_abs_lead_difference"),
    ).withColumn("passes_screen", F.coalesce(F.col("max_abs_lead_difference") <= limit, F.lit(False)))


def bootstrap_did(panel: DataFrame, outcome: str = "win", cluster: str = "event_id", n_boot: int = 2000,
                  seed: int = 0, chunk: int = 4096) -> DataFrame:
    """Cluster bootstrap of the DiD with 2.5 % and 97.5 % quantiles.

    Rows collapse to one row of four cell sums per cluster first; numbered clusters form chunks. The n draws of a
    replicate are first only counted per chunk (draw ``id`` falls into the chunk that holds ``md5(seed:id) mod n``), then
    drawn inside the chunk (``md5(seed:replicate:chunk:j) mod size``). A chunk adds its draws up per replicate, so what is
    shuffled is n_boot x chunks sums, never n_boot x n draws, and the result does not depend on partitioning.
    """
    if n_boot < 100:
        raise ValueError("n_boot must be at least 100")
    y = F.col(outcome)
    sums = [F.coalesce(F.sum(_cell(t, p, y)), F.lit(0.0)).alias(f"s_{name}") for name, t, p in _CELLS]
    counts = [F.count(_cell(t, p, y)).alias(f"n_{name}") for name, t, p in _CELLS]
    cells = panel.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("_cluster")).agg(*sums, *counts)
    indexed = write_and_reread(dense_index(cells, "_cluster", "_i"), "bootstrap-cells")
    n = indexed.count()
    if n < 2:
        raise ValueError("bootstrap requires at least two clusters")
    spark = panel.sparkSession
    names = [c for c in indexed.columns if c not in ("_cluster", "_i")]

    def draw(size: Column, *parts: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size

    tasks = max(spark.sparkContext.defaultParallelism, n_boot * n // 4_000_000)
    shares = spark.range(0, n_boot * n, 1, tasks).select(
        F.floor(F.col("id") / n).alias("replicate"), F.floor(draw(F.lit(n), F.col("id")) / chunk).alias("_chunk")).groupBy(
        "replicate", "_chunk").agg(F.count("*").alias("_m"))
    # one row per chunk: its clusters' cells in order
    held = indexed.groupBy(F.floor(F.col("_i") / chunk).alias("_chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", *names))), lambda x: F.struct(*[x[c].alias(c) for c in names])).alias("_cells"))
    inside = shares.join(held, "_chunk").select("replicate", "_chunk", "_cells", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_j"))
    drawn = inside.select("replicate", F.get("_cells", draw(F.size("_cells"), F.col("replicate"), F.col("_chunk"), F.col("_j")).cast("int")).alias("_c"))
    totals = drawn.groupBy("replicate").agg(*[F.sum(F.col("_c")[c]).alias(c) for c in names])

    def mean(name: str) -> Column:
        return F.try_divide(F.col(f"s_{name}"), F.col(f"n_{name}"))

    estimate = (mean("treated_post") - mean("treated_pre")) - (mean("control_post") - mean("control_pre"))
    spread = totals.select(estimate.alias("e")).where(F.col("e").isNotNull()).agg(
        F.percentile("e", F.lit(0.025)).alias("ci_low"), F.percentile("e", F.lit(0.975)).alias("ci_high"),
        F.count("*").alias("n_boot"))      # n_boot numbers
    point = did_estimate(panel, outcome).select("estimate")
    return point.crossJoin(spread).withColumns({"n_clusters": F.lit(n).cast("long"), "seed": F.lit(seed)})


def balance_table(points: DataFrame, covariates: list[str]) -> DataFrame:
    """n, means and standardised mean difference per covariate (pooled variance, ddof 1)."""
    rows = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in covariates])
    one, zero = F.when(F.col("treated") == 1, F.col("v")), F.when(F.col("treated") == 0, F.col("v"))
    out = points.select("treated", F.inline(rows)).groupBy("covariate").agg(
        F.count(one).alias("treated_n"), F.count(zero).alias("control_n"), F.avg(one).alias("treated_mean"),
        F.avg(zero).alias("control_mean"), F.var_samp(one).alias("_v1"), F.var_samp(zero).alias("_v0"))
    pooled = F.sqrt((F.col("_v1") + F.col("_v0")) / 2.0)
    gap = F.col("treated_mean") - F.col("control_mean")
    smd = F.when((pooled == 0) & (gap == 0), 0.0).when(pooled == 0, float("inf")).otherwise(F.try_divide(gap, pooled))
    return out.withColumn("smd", smd).drop("_v1", "_v0")


# ---- long breaks ----------------------------------------------------------------------------
def gap_rows(long: DataFrame, treated_min: float = 30.0, control_max: float = 14.0, line: Timeline = TEAM) -> DataFrame:
    """Results net of five-contest form, with the group implied by the days since the last contest."""
    from faceoff.operators.features import form_and_rest

    rows = form_and_rest(long, line).where(F.col("rest_days").isNotNull() & F.col("form5").isNotNull())
    group = F.when(F.col("rest_days") >= treated_min, "treated").when(F.col("rest_days") <= control_max, "control")
    return rows.withColumns({"y_net": F.col("win") - F.col("form5"), "group": group})


def gap_contrast(rows: DataFrame, specifications: dict[str, Column]) -> DataFrame:
    """Difference of means with a normal interval, for several row filters in one pass."""
    tagged = rows.where(F.col("group").isNotNull()).select(
        "y_net", "group",
        F.explode(F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in specifications.items()]),
                           lambda x: x.isNotNull())).alias("specification"))
    t, c = (F.when(F.col("group") == g, F.col("y_net")) for g in ("treated", "control"))
    out = tagged.groupBy("specification").agg(
        F.avg(t).alias("_mt"), F.avg(c).alias("_mc"), F.var_samp(t).alias("_vt"), F.var_samp(c).alias("_vc"),
        F.count(t).alias("n_treated"), F.count(c).alias("n_control"))
    est = F.col("_mt") - F.col("_mc")
    se = F.sqrt(F.try_divide(F.col("_vt"), F.col("n_treated")) + F.try_divide(F.col("_vc"), F.col("n_control")))
    return out.select(
        "specification", est.alias("estimate"), se.alias("se"), (est - 1.96 * se).alias("ci_lo"),
        (est + 1.96 * se).alias("ci_hi"), (F.col("n_treated") + F.col("n_control")).alias("n"),
        "n_treated", "n_control")


def pre_trend(long: DataFrame, treated_min: float = 30.0, control_max: float = 14.0, steps: int = 5,
              line: Timeline = TEAM) -> DataFrame:
    """Mean result at each of the ``steps`` contests before a gap, per group, over all points."""
    def make(f: Frames) -> dict[str, Column]:
        return {"_prior": F.collect_list("win").over(f.rows(-steps, -1))}

    from faceoff.operators.features import form_and_rest

    rows = over_frame(form_and_rest(long, line), line, steps, 0, make).where(
        F.col("rest_days").isNotNull() & F.col("form5").isNotNull())
    group = F.when(F.col("rest_days") >= treated_min, "treated").when(F.col("rest_days") <= control_max, "control")
    points = rows.withColumn("group", group).where(F.col("group").isNotNull())
    return points.select("group", F.size("_prior").alias("_n"), F.posexplode("_prior").alias("_k", "won")).groupBy(
        (F.col("_k") - F.col("_n")).alias("step"), "group").agg(F.avg("won").alias("won"), F.count("*").alias("n"))


def roster_study(matches: DataFrame, n_boot: int = 2000, seed: int = 0, pre: int = 5, post: int = 5) -> dict[str, DataFrame]:
    """The whole chain; shared steps are written once."""
    panel = write_and_reread(team_match_panel(matches), "study-panel")
    windows = write_and_reread(event_windows(panel, pre, post), "study-windows")
    points = windows.where("relative_match = 0")
    pairs = write_and_reread(nearest_control_greedy(points, eligible_controls(panel, pre, post)), "study-pairs")
    paired = write_and_reread(paired_event_panel(panel, windows, pairs, pre, post), "study-paired")
    study = event_study(paired)
    return {
        "panel": panel, "windows": windows, "pairs": pairs, "paired": paired, "did": did_estimate(paired),
        "bootstrap": bootstrap_did(paired, n_boot=n_boot, seed=seed), "event_study": study,
        "pretrend": pretrend_screen(study),
        "balance": balance_table(paired.where("relative_match = 0"), ["pre_stable_matches", "change_count"]),
    }
