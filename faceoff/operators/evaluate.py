"""Quality of probabilities: losses, calibration, drift, market comparison, answer grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions import scalar as X
from faceoff.operators.ordering import exact_quantiles

PSI_FLAG = 0.25
PSI_FLOOR = 1e-6
MIN_GROUP = 30


# ---- losses ---------------------------------------------------------------------------------
def loss_columns(p: str = "p", y: str = "y") -> list[Column]:
    """log loss, Brier score and accuracy as one aggregate."""
    pc, yc = F.col(p), F.col(y)
    hit = ((pc >= 0.5).cast("double") == yc).cast("double")
    return [F.avg(X.row_log_loss(pc, yc)).alias("logloss"), F.avg(F.pow(pc - yc, F.lit(2))).alias("brier"),
            F.avg(hit).alias("acc"), F.count("*").alias("n")]


def score(df: DataFrame, by: list[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(*loss_columns(p, y)) if by else df.agg(*loss_columns(p, y))


def with_split(df: DataFrame, cutoff: str, ts: str = "datetime") -> DataFrame:
    """train strictly before the cutoff, test on or after it."""
    edge = F.lit(cutoff).cast(df.schema[ts].dataType)
    return df.withColumn("split", F.when(F.col(ts) < edge, "train").otherwise("test"))


def summarize_split(scored: DataFrame, cutoff: str, by: list[str] = ("model",)) -> DataFrame:
    """Losses per model and split, with the always-0.5 baseline computed from the same rows."""
    rows = with_split(scored, cutoff)
    constant = rows.withColumns({"p": F.lit(0.5), **{b: F.lit("constant_0.5") for b in by}})
    return score(rows, [*by, "split"]).unionByName(score(constant, [*by, "split"]))


# ---- calibration ----------------------------------------------------------------------------
def _bin(p: Column, bins: int) -> Column:
    """Equal-width bin of [0, 1]; edges are closed on the left and p = 1 falls in the last bin."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in edges], F.lit(0))


def _bin_cells(df: DataFrame, by: list[str], bins: int, p: str, y: str) -> DataFrame:
    return df.groupBy(*by, _bin(F.col(p), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("obs_rate"))


def reliability_table(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """One row per bin, empty bins included with null means."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    cells = _bin_cells(df, [], bins, p, y)
    return spine.join(F.broadcast(cells), "bin", "left").select(      # at most ``bins`` rows
        "bin", (F.col("bin") * (1.0 / bins)).alias("bin_lo"), ((F.col("bin") + 1) * (1.0 / bins)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "obs_rate")


def _ece() -> Column:
    return (F.sum(F.col("n") * F.abs(F.col("obs_rate") - F.col("mean_pred"))) / F.sum("n")).alias("ece")


def ece(df: DataFrame, by: list[str] = (), bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    cells = _bin_cells(df, list(by), bins, p, y)
    return cells.groupBy(*by).agg(_ece()) if by else cells.agg(_ece())


def calibration_by_group(df: DataFrame, labels: list[str], bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Losses and ECE per label (several labels join with '/'); groups under 30 rows are left out.

    One pass: rows collapse to (group, bin) cells that carry the loss sums, cells to groups.
    """
    pc, yc = F.col(p), F.col(y)
    group = F.concat_ws("/", *[F.col(c).cast("string") for c in labels]).alias("group")
    cells = df.groupBy(group, _bin(pc, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("obs_rate"),
        F.sum(X.row_log_loss(pc, yc)).alias("_ll"), F.sum(F.pow(pc - yc, F.lit(2))).alias("_br"),
        F.sum(((pc >= 0.5).cast("double") == yc).cast("double")).alias("_hit"))
    total = F.sum("n")

    def weighted(name: str) -> Column:
        return F.sum(F.col("n") * F.col(name)) / total

    return cells.groupBy("group").agg(
        total.alias("_n"), (F.sum("_ll") / total).alias("logloss"), (F.sum("_br") / total).alias("brier"),
        (F.sum("_hit") / total).alias("acc"), _ece(), weighted("mean_pred").alias("_mp"),
        weighted("obs_rate").alias("_or"),
    ).where(F.col("_n") >= MIN_GROUP).select(
        "group", F.col("_n").alias("n"), "logloss", "brier", "acc", "ece",
        F.col("_mp").alias("mean_pred"), F.col("_or").alias("obs_rate"))


def brier_decomposition(df: DataFrame, by: list[str] = (), bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Reliability, resolution and uncertainty from the bin cells in one further aggregate."""
    cells = _bin_cells(df, list(by), bins, p, y)
    n, m, o = F.col("n"), F.col("mean_pred"), F.col("obs_rate")
    base = F.sum(n * o) / F.sum(n)
    gap = F.sum(n * F.pow(m - o, F.lit(2))) / F.sum(n)
    spread = F.sum(n * o * o) / F.sum(n) - base * base
    cols = [gap.alias("reliability"), spread.alias("resolution"), (base * (1.0 - base)).alias("uncertainty")]
    return cells.groupBy(*by).agg(*cols) if by else cells.agg(*cols)


# ---- market ---------------------------------------------------------------------------------
def model_vs_market(df: DataFrame, model: str = "model_p_t1", market: str = "market_p_t1",
                    y: str = "result") -> DataFrame:
    """Losses of both and their differences; no rows is an error, not an empty answer."""
    def pair(p: str, name: str) -> list[Column]:
        return [F.avg(X.row_log_loss(F.col(p), F.col(y))).alias(f"{name}_logloss"),
                F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias(f"{name}_brier")]

    out = df.dropna(subset=[model, market, y]).agg(
        F.count("*").alias("n"), *pair(model, "model"), *pair(market, "market"))
    checked = F.when(F.col("n") == 0, F.raise_error(F.lit("no priced contests")).cast("long")).otherwise(F.col("n"))
    return out.withColumns({
        "n": checked, "delta_logloss": F.col("model_logloss") - F.col("market_logloss"),
        "delta_brier": F.col("model_brier") - F.col("market_brier")})


def rating_lookup(names: DataFrame, ratings: DataFrame, column: str, base: float = 1500.0) -> DataFrame:
    """Add ``<column>_rating`` and ``<column>_unknown``; exact spelling first, then any case."""
    exact = ratings.groupBy(F.col("team").alias(column)).agg(F.max("rating").alias("_exact"))
    loose = ratings.groupBy(F.lower("team").alias("_key")).agg(F.min_by("rating", "team").alias("_loose"))
    found = F.coalesce("_exact", "_loose")
    return (
        names.join(exact, column, "left").withColumn("_key", F.lower(column)).join(loose, "_key", "left")
        .withColumns({f"{column}_rating": F.coalesce(found, F.lit(base)), f"{column}_unknown": found.isNull()})
        .drop("_exact", "_loose", "_key"))


# fixed values: texts of the skip column
SKIP_ODDS = "decimal odds must exceed 1.0"
SKIP_RATING = "no rating for "


def edge_scan(odds: DataFrame, ratings: DataFrame, min_edge: float = 0.0) -> DataFrame:
    """Price every market with the rating curve; unusable rows keep a skip reason."""
    rows = rating_lookup(rating_lookup(odds, ratings, "team1"), ratings, "team2")
    vig = X.devig(F.col("odds1"), F.col("odds2"))
    p1 = X.elo_expected(F.col("team1_rating"), F.col("team2_rating"))
    missing = F.concat_ws(", ", F.when(F.col("team1_unknown"), F.col("team1")),
                          F.when(F.col("team2_unknown"), F.col("team2")))
    skipped = F.when((F.col("odds1") <= 1) | (F.col("odds2") <= 1), SKIP_ODDS).when(
        missing != "", F.concat(F.lit(SKIP_RATING), missing))
    priced = rows.withColumns({"skipped": skipped, "_vig": vig, "elo_p1": p1})
    priced = priced.withColumns({
        "_ev1": X.expected_value(F.col("elo_p1"), F.col("odds1")),
        "_ev2": X.expected_value(1.0 - F.col("elo_p1"), F.col("odds2"))})
    first = F.col("_ev1") >= F.col("_ev2")
    p = F.when(first, F.col("elo_p1")).otherwise(1.0 - F.col("elo_p1"))
    o = F.when(first, F.col("odds1")).otherwise(F.col("odds2"))
    live = F.col("skipped").isNull()

    def only(value: Column) -> Column:
        return F.when(live, value)

    return priced.select(
        *odds.columns, "skipped", only(F.col("_vig.margin")).alias("margin"),
        only(F.col("_vig.p1")).alias("market_p1"), only(F.col("_vig.p2")).alias("market_p2"),
        only(F.col("elo_p1")).alias("elo_p1"),
        only(F.when(first, F.col("team1")).otherwise(F.col("team2"))).alias("best_side"),
        only(F.greatest("_ev1", "_ev2")).alias("best_ev"), only(p - 1.0 / o).alias("best_edge"),
        only(o).alias("best_odds"), only(1.0 / o).alias("best_break_even"),
        only((p - 1.0 / o) > min_edge).alias("bet"))


def edge_counts(scan: DataFrame) -> DataFrame:
    return scan.agg(
        F.count_if("bet").alias("flagged"), F.count_if(F.col("skipped").isNull()).alias("priced"),
        F.count("skipped").alias("skipped"))


# ---- drift ----------------------------------------------------------------------------------
def unpivot_features(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Long (feature, value) rows without nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def psi_edges(expected: DataFrame, bins: int = 10) -> DataFrame:
    """feature -> sorted distinct quantile edges (at most bins + 1 numbers per feature)."""
    probs = [i / bins for i in range(bins + 1)]
    return exact_quantiles(expected, ["feature"], "value", probs, few=True).groupBy("feature").agg(
        F.array_sort(F.collect_set("value")).alias("edges"))


def psi(expected: DataFrame, actual: DataFrame, by: list[str] = (), bins: int = 10,
        open_ends: bool = False) -> DataFrame:
    """Population stability index of long (feature, value) frames, per feature and ``by``.

    Values outside the expected range are counted in the total but in no bin, unless
    ``open_ends`` sends them to the outer bins. A feature with one distinct value scores 0.
    """
    by = list(by)
    edges = psi_edges(expected, bins)

    def binned(df: DataFrame, keys: list[str]) -> DataFrame:
        v, e = F.col("value"), F.col("edges")
        last = F.size(e) - 1
        slot = F.size(F.filter(e, lambda x: x <= v)) - 1
        slot = F.when(v == F.element_at(e, -1), last - 1).otherwise(slot)
        if open_ends:
            slot = F.greatest(F.lit(0), F.least(slot, last - 1))
        rows = df.join(F.broadcast(edges), "feature")       # one row per feature column
        return rows.groupBy(*keys, "feature", slot.alias("_slot"), last.alias("_slots")).agg(F.count("*").alias("_n"))

    def shares(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
        whole = cells.groupBy(*keys, "feature", "_slots").agg(
            F.sum("_n").alias("_total"),
            F.map_from_entries(F.collect_list(F.struct("_slot", "_n"))).alias(name))   # <= bins + 2 entries
        return whole.withColumnRenamed("_total", f"{name}_total")

    exp = shares(binned(expected, []), [], "_e").select("feature", "_slots", "_e", "_e_total")
    act = shares(binned(actual, by), by, "_a").select(*by, "feature", "_a", "_a_total")
    joined = act.join(F.broadcast(exp), "feature")

    def share(counts: str, total: str, i: Column) -> Column:
        raw = F.coalesce(F.try_element_at(counts, i), F.lit(0)) / F.col(total)
        return F.greatest(raw, F.lit(PSI_FLOOR))

    def term(s: Column, i: Column) -> Column:
        a, e = share("_a", "_a_total", i), share("_e", "_e_total", i)
        return s + (a - e) * F.ln(a / e)

    slots = F.when(F.col("_slots") >= 1, F.sequence(F.lit(0), F.col("_slots") - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select(*by, "feature", F.col("_a_total").alias("n"),
                         F.aggregate(slots, F.lit(0.0), term).alias("psi"))


def drift_by_month(df: DataFrame, columns: list[str], cutoff: str, bins: int = 10) -> DataFrame:
    """PSI of every (month, feature) against the rows before the cutoff; the edges are found once."""
    month = F.date_format("datetime", "yyyy-MM").alias("month")
    long = unpivot_features(df, columns, ["datetime"])
    edge = F.lit(cutoff).cast(df.schema["datetime"].dataType)
    rows = df.groupBy(month).agg(F.count("*").alias("_rows"))
    report = psi(long.where(F.col("datetime") < edge), long.select(month, "feature", "value"), ["month"], bins)
    return report.join(rows, "month").select(
        "month", "feature", F.col("_rows").alias("n"), "psi", (F.col("psi") > PSI_FLAG).alias("flag"))


# ---- grading answers ------------------------------------------------------------------------
def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rows as one comparable struct; fractional columns rounded, position instead of name."""
    cells = [
        (F.round(F.col(f"`{f.name}`").cast("double"), digits) if f.dataType.typeName() in ("double", "float", "decimal")
         else F.col(f"`{f.name}`")).cast("string").alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row"))


def _values(df: DataFrame, digits: int = 4) -> DataFrame:
    """Distinct scalar values of the whole result, normalised."""
    cells = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        numeric = f.dataType.typeName() in ("double", "float", "decimal", "long", "integer", "short", "byte")
        cells.append(F.round(value.cast("double"), digits).cast("string") if numeric
                     else F.lower(F.trim(value.cast("string"))))
    return df.select(F.explode(F.array(*cells)).alias("v")).select(F.coalesce("v", F.lit("\u0000")).alias("v")).distinct()


def compare_result_sets(model: DataFrame, gold: DataFrame, multiset: bool = False) -> DataFrame:
    """exact (1.0): same rows; partial (0.5): every gold value occurs; wrong (0.0) otherwise."""
    a, b = _rounded(model), _rounded(gold)
    if not multiset:
        a, b = a.distinct(), b.distinct()
    differing = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("_diff"))
    mv, gv = _values(model), _values(gold)
    absent = gv.join(mv, "v", "left_anti").agg(F.count("*").alias("_absent"))
    sizes = mv.agg(F.count("*").alias("_nm")).crossJoin(gv.agg(F.count("*").alias("_ng")))
    one = differing.crossJoin(absent).crossJoin(sizes)       # one-row frames
    partial = (F.col("_absent") == 0) & (F.col("_nm") > 0) & (F.col("_ng") > 0)
    if len(model.columns) != len(gold.columns):
        exact = F.lit(False)
    else:
        exact = F.col("_diff") == 0
    verdict = F.when(exact, "exact").when(partial, "partial").otherwise("wrong")
    return one.select(verdict.alias("verdict"),
                      F.when(exact, 1.0).when(partial, 0.5).otherwise(0.0).alias("credit"))


def eval_summary(runs: DataFrame) -> DataFrame:
    """Per label, from its latest run: correct answers, execution rate, refused traps, tokens, cost."""
    latest = runs.groupBy("label").agg(F.max("run_at").alias("run_at"))
    rows = runs.join(latest, ["label", "run_at"])
    asked, trap = ~F.col("is_trap"), F.col("is_trap")
    return rows.groupBy("label", "run_at").agg(
        F.count("*").alias("questions"), F.count_if(asked & F.col("result_match")).alias("answerable_correct"),
        F.count_if(asked).alias("answerable_total"), F.count_if(trap & F.col("refused_ok")).alias("traps_refused"),
        F.count_if(trap).alias("traps_total"),
        F.round(F.avg(F.when(asked, F.col("executable").cast("int"))), 4).alias("exec_rate"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum(F.col("prompt_tokens") / 1e6 * F.col("price_in")
                      + F.col("completion_tokens") / 1e6 * F.col("price_out")), 4).alias("est_cost"))
