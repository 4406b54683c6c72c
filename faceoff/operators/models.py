"""Win-probability models on Spark ML, their calibration and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faceoff.functions.scalar import elo_expected, row_log_loss
from faceoff.functions.tails import t_upper_quantile
from faceoff.operators import boosting, calibration, evaluate
from faceoff.operators.features import feature_matrix
from faceoff.operators.longform import side_long
from faceoff.operators.ordering import dense_index, global_position
from faceoff.session import write_and_reread

# ---- fixed values: published model settings -------------------------------------------------
GBM_DEPTH, GBM_ROUNDS, GBM_RATE, GBM_PENALTY, SEED = 3, 200, 0.06, 1.0, 42
PRIOR_MEAN, PRIOR_WIDTH, STRENGTH_SCALE, MIN_SERIES, POOLING = 1500.0, 350.0, 173.0, 10, 30.0
CALIBRATION_MIN_ROWS, ECE_FACTOR = 60, 1.25
BAND_94 = 1.8807936081512509      # normal quantile at 0.97
ODD_FEATURES = ("elo_diff", "form5_diff", "rest_days_diff", "roster_stability_diff", "standin_diff", "bo1_elo")
HALF_FEATURES = ("h2h_t1_win_share",)
REQUEST_DEFAULTS = {"form5_diff": 0.0, "rest_days_diff": 0.0, "h2h_t1_win_share": 0.5,
                    "roster_stability_diff": 0.0, "standin_diff": 0.0}
# ---------------------------------------------------------------------------------------------
Fitter = Callable[[DataFrame], object]
c = F.col


def fit_logistic(train: DataFrame) -> PipelineModel:
    """Standardised L2 logistic regression with unit inverse penalty on the summed loss."""
    n = train.count()
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=1000)
    return Pipeline(stages=[scaler, lr]).fit(train)


def fit_gbm(train: DataFrame, rounds: int = GBM_ROUNDS) -> boosting.BoostedTrees:
    """Histogram boosting with an L2 penalty on the leaves."""
    return boosting.fit_members(train, 1, rounds, GBM_DEPTH, GBM_RATE, GBM_PENALTY)[0]


class AveragedCalibration:
    """Several (model, isotonic map) pairs whose calibrated probabilities are averaged."""

    def __init__(self, members: list[tuple[object, object]]) -> None:
        self.members = members

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        out = df
        for i, (model, iso) in enumerate(self.members):
            scored = predict_proba(model, out).withColumnRenamed("p", "_p")
            out = iso.transform(scored).select(*kept, *[f"_c{j}" for j in range(i)], c("_iso").alias(f"_c{i}"))
        mean = reduce(lambda a, b: a + b, [c(f"_c{i}") for i in range(len(self.members))]) / len(self.members)
        return out.withColumn("p", mean).select(*kept, "p")


def fit_gbm_isotonic(train: DataFrame, folds: int = 5, rounds: int = GBM_ROUNDS) -> AveragedCalibration:
    """Expanding time folds: fit on the first blocks, calibrate on the next one, average.

    The models of all folds grow in the same passes over the rows.
    """
    n = train.count()
    size = n // (folds + 1)
    placed = write_and_reread(global_position(train, "datetime", ["match_id"], name="_pos"), "fold-rows")
    edges = [n - (folds - k) * size for k in range(folds)]
    learns = reduce(lambda a, b: a + b, [F.when(c("_pos") <= edge, 1 << k).otherwise(0) for k, edge in enumerate(edges)])
    fitted = boosting.fit_members(placed.withColumn("_member", learns), folds, rounds, GBM_DEPTH, GBM_RATE, GBM_PENALTY, member="_member")
    members = []
    for model, edge in zip(fitted, edges, strict=True):
        held = placed.where((c("_pos") > edge) & (c("_pos") <= edge + size)).drop("_pos")
        scored = predict_proba(model, held).withColumnRenamed("p", "_p")
        members.append((model, IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_iso").fit(scored)))
    return AveragedCalibration(members)


def _p() -> Column:
    return vector_to_array("probability")[1]


def predict_proba(model: object, df: DataFrame) -> DataFrame:
    """``df`` with the win probability ``p``."""
    if isinstance(model, AveragedCalibration | boosting.BoostedTrees):
        return model.transform(df)
    return model.transform(df).withColumn("p", _p()).select(*df.columns, "p")


# ---- calibration per group ------------------------------------------------------------------
def calibrate_per_group(train: DataFrame, test: DataFrame, method: str = "platt", select: str = "all",
                        group: str = "tier", min_rows: int = CALIBRATION_MIN_ROWS,
                        ece_factor: float = ECE_FACTOR) -> tuple[DataFrame, DataFrame]:
    """Calibrate ``p`` per group from train rows (p, label). Returns (test with p_cal, decisions).

    One aggregate decides about every group; the kept groups are fitted side by side, however many
    they are. Groups that were skipped or never seen keep their probability.
    """
    if method not in ("isotonic", "platt") or select not in ("all", "overconfident"):
        raise ValueError(f"unknown method or selection: {method!r}, {select!r}")
    per_group = evaluate.ece(train, [group], y="label").withColumnRenamed("ece", "group_ece")
    overall = evaluate.ece(train, y="label").select(c("ece").alias("overall_ece"))
    stats = train.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"))
    reason = F.when(c("n") < min_rows, "too-few-rows").when(c("classes") < 2, "single-class")
    if select == "overconfident":
        reason = reason.when(c("group_ece") <= ece_factor * c("overall_ece"), "well-calibrated-on-train")
    decisions = stats.join(per_group, group).crossJoin(overall).select(group, "n", reason.alias("skipped"))
    kept = train.join(decisions.where("skipped IS NULL").select(group), group, "left_semi")
    fitted = (calibration.platt if method == "platt" else calibration.isotonic)(kept, test, group, into="_cal")
    value = F.coalesce("_cal", "p")
    return fitted.select(*test.columns, F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("p_cal")), decisions


def tier_calibration_report(train: DataFrame, test: DataFrame, group: str = "tier") -> DataFrame:
    """method x group (and ALL): ECE and log loss before and after."""
    variants = {"none": test.withColumn("p_cal", c("p"))}
    for name, kw in (("isotonic", {"method": "isotonic"}), ("platt", {}), ("platt-sel", {"select": "overconfident"})):
        variants[name] = calibrate_per_group(train, test, group=group, **kw)[0]
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(m).alias("method"), F.explode(F.array(c(group), F.lit("ALL"))).alias(group), "p", "p_cal", "label")
        for m, df in variants.items()])
    by = ["method", group]
    losses = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(row_log_loss(c("p"), c("label"))).alias("logloss_before"),
        F.avg(row_log_loss(c("p_cal"), c("label"))).alias("logloss_after"))
    before = evaluate.ece(rows, by, y="label").withColumnRenamed("ece", "ece_before")
    after = evaluate.ece(rows, by, p="p_cal", y="label").withColumnRenamed("ece", "ece_after")
    return losses.join(before, by).join(after, by)


# ---- backtests and comparisons --------------------------------------------------------------
def rolling_backtest(store: DataFrame, cutoffs: list[str], extra: list[str] = (), fit: Fitter = fit_logistic,
                     min_train: int = 2000, min_test: int = 100) -> DataFrame:
    """Refit at every cutoff and score everything after it; thin folds are left out.

    The loop is over a handful of cutoffs; every fit and every score is a Spark job.
    """
    parts = []
    sizes = store.agg(*[F.count_if(c("datetime") < F.lit(x).cast(store.schema["datetime"].dataType)).alias(f"t{i}")
                        for i, x in enumerate(cutoffs)], F.count("*").alias("n")).first()
    for i, cutoff in enumerate(cutoffs):
        n_train, n_test = sizes[f"t{i}"], sizes["n"] - sizes[f"t{i}"]
        if n_train < min_train or n_test < min_test:
            continue
        rows, _ = feature_matrix(store, list(extra), cutoff)
        scored = predict_proba(fit(rows.where("split = 'train'")), rows.where("split = 'test'"))
        parts.append(evaluate.score(scored, p="p", y="label").select(
            F.lit(cutoff).alias("cutoff"), F.lit(n_train).cast("long").alias("n_train"), c("n").alias("n_test"),
            "logloss", "brier", "acc"))
    if not parts:
        return store.sparkSession.createDataFrame(
            [], "cutoff string, n_train long, n_test long, logloss double, brier double, acc double")
    return reduce(DataFrame.unionByName, parts)


def summarize_folds(folds: DataFrame, metrics: tuple[str, ...] = ("logloss", "brier", "acc")) -> DataFrame:
    """Mean and 95 % t interval over folds, per metric."""
    long = folds.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("v")) for m in metrics])))
    out = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("_sd"), F.count("v").alias("n_folds"))
    sem = F.coalesce(c("_sd") / F.sqrt("n_folds"), F.lit(0.0))
    half = F.coalesce(t_upper_quantile(c("n_folds") - 1) * sem, F.lit(0.0))
    return out.withColumns({"sem": sem, "ci_lo": c("mean") - half, "ci_hi": c("mean") + half}).drop("_sd")


def model_table(scored: DataFrame) -> DataFrame:
    """Long (model, p, y) rows -> losses and ECE per model."""
    scored = write_and_reread(scored.select("model", "p", "y"), "scored-models")      # scored once, read twice
    return evaluate.score(scored, ["model"]).join(evaluate.ece(scored, ["model"]), "model").select(
        "model", "logloss", "brier", "acc", "ece", "n")


def compare_models(store: DataFrame, cutoff: str, fitters: dict[str, tuple[Fitter, list[str]]]) -> DataFrame:
    """Fit every named (fitter, extra features) on the same split; long (match_id, model, p, y) rows of the test side."""
    parts = []
    for name, (fit, extra) in fitters.items():
        rows, _ = feature_matrix(store, extra, cutoff)
        test = rows.where("split = 'test'")
        parts.append(predict_proba(fit(rows.where("split = 'train'")), test).select(
            "match_id", F.lit(name).alias("model"), "p", c("label").alias("y")))
    constant = test.select("match_id", F.lit("constant_0.5").alias("model"), F.lit(0.5).alias("p"), c("label").alias("y"))
    return reduce(DataFrame.unionByName, [*parts, constant])


def leakage_demo(store: DataFrame, cutoff: str, fitters: dict[str, Fitter], share: float = 0.8) -> DataFrame:
    """The same models on the honest time split and on a random split drawn by a hash per class."""
    rows, _ = feature_matrix(store, [], cutoff)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), c("label").cast("string"), c("match_id").cast("string"))), 1, 8),
                  16, 10).cast("double") / float(2 ** 32)
    splits = {"time": rows, "random": rows.withColumn("split", F.when(draw < share, "train").otherwise("test"))}
    parts = []
    for mode, df in splits.items():
        for name, fit in fitters.items():
            scored = predict_proba(fit(df.where("split = 'train'")), df.where("split = 'test'"))
            parts.append(evaluate.score(scored, p="p", y="label").select(
                F.lit(name).alias("model"), F.lit(mode).alias("split_mode"), "logloss", "brier", "acc", "n"))
    return reduce(DataFrame.unionByName, parts)


def permutation_importance(model: object, test: DataFrame, names: list[str], repeats: int = 20) -> DataFrame:
    """Mean rise of log loss when one feature's values are shuffled.

    A shuffle pairs the i-th row in id order with the i-th row in a hash order of the repeat: two
    distributed numberings and one join. All features and repeats are scored in one pass.
    """
    rows = test.select("match_id", "label", vector_to_array("features").alias("_v"))
    plain = dense_index(rows, "match_id", "_i")
    tagged = rows.select("_v", "match_id").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    tagged = tagged.withColumn("_k", F.md5(F.concat_ws(":", c("repeat").cast("string"), c("match_id").cast("string"))))
    donors = dense_index(tagged, "_k", "_i", ("repeat",)).select("repeat", "_i", c("_v").alias("_d"))
    pairs = plain.join(donors, "_i").withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    swapped = F.transform("_v", lambda x, j: F.when(j == c("_f"), F.get(c("_d"), j)).otherwise(x))
    base = pairs.select("match_id", "label", "repeat", "_f", array_to_vector(swapped).alias("features"))
    shuffled = predict_proba(model, base).groupBy("_f").agg(F.avg(row_log_loss(c("p"), c("label"))).alias("_s"))
    original = predict_proba(model, test.select("features", "label")).agg(
        F.avg(row_log_loss(c("p"), c("label"))).alias("_o"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), c("_f") + 1)
    return shuffled.crossJoin(original).select(label.alias("feature"), (c("_s") - c("_o")).alias("importance"))


# ---- map model ------------------------------------------------------------------------------
def map_win_model(train: DataFrame, min_rows: int = 100) -> PipelineModel:
    """Logistic on elo_diff, map_wr_diff and the map; maps unseen in training get all zeros."""
    clean = train.dropna(subset=["elo_diff", "map_name", "map_wr_diff"])
    n = clean.count()
    if n < min_rows:
        raise ValueError(f"fewer than {min_rows} trusted map rows")
    return Pipeline(stages=[
        StringIndexer(inputCol="map_name", outputCol="_m", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol="_m", outputCol="_map", dropLast=True),
        VectorAssembler(inputCols=["elo_diff", "map_wr_diff", "_map"], outputCol="features"),
        LogisticRegression(labelCol="label", regParam=1.0 / n, standardization=False, maxIter=1000),
    ]).fit(clean)


# ---- strengths ------------------------------------------------------------------------------
def strength_subset(matches: DataFrame, tier: str | None, years: tuple[int, int], min_series: int = MIN_SERIES) -> DataFrame:
    """Contests of one tier and period between entities with enough contests in it."""
    year = F.year("datetime")
    sub = matches.where(year.between(*years))
    if tier is not None:
        sub = sub.where(c("tier") == tier)
    keep = side_long(sub).groupBy("team").count().where(c("count") >= min_series).select("team")
    return sub.join(keep.withColumnRenamed("team", "team1"), "team1", "left_semi").join(
        keep.withColumnRenamed("team", "team2"), "team2", "left_semi")


def bradley_terry(matches: DataFrame, hierarchical: bool = False, tolerance: float = 1e-22, most_steps: int = 500) -> DataFrame:
    """Strength per entity under a normal prior: the posterior mode with a Laplace interval.

    Contests collapse to a table of pairs with their number and wins, in both orientations; a contest counts once per
    orientation, as published. The mode is found by preconditioned conjugate gradients: strengths, gradients and
    directions stay tables keyed by entity, each step is a join with the pair table and one aggregate, and only the
    scalar products reach the driver. It ends when the gradient's preconditioned norm is below ``tolerance``.
    """
    both = side_long(matches).where("team IS NOT NULL AND opponent IS NOT NULL")
    pairs = write_and_reread(both.groupBy("team", "opponent").agg(
        F.count("*").cast("double").alias("n"), F.sum(c("win").cast("double")).alias("wins")), "strength-pairs")
    width = PRIOR_WIDTH / STRENGTH_SCALE
    counts = pairs.groupBy("team").agg(F.sum("n").cast("long").alias("n_series"))
    sigma = (width * c("n_series") / (c("n_series") + POOLING)) if hierarchical else F.lit(width)
    priors = counts.select("team", "n_series", (1.0 / (sigma * sigma)).alias("tau"))

    def paired(state: DataFrame, *names: str) -> DataFrame:
        mine = state.select("team", *[c(x).alias(f"{x}1") for x in names])
        other = state.select(c("team").alias("opponent"), *[c(x).alias(f"{x}2") for x in names])
        return pairs.join(mine, "team").join(other, "opponent")

    p = 1.0 / (1.0 + F.exp(c("theta2") - c("theta1")))

    def with_gradient(state: DataFrame) -> DataFrame:
        """Uphill gradient g of the log posterior, and z = g over the curvature's diagonal."""
        each = paired(state, "theta").groupBy("team").agg(
            F.sum(2.0 * (c("wins") - c("n") * p)).alias("_s"), F.sum(2.0 * c("n") * p * (1.0 - p)).alias("_i"))
        g = c("_s") - c("theta") * c("tau")
        return state.join(each, "team").select(*state.columns, g.alias("g"), (c("_i") + c("tau")).alias("info")).withColumn("z", c("g") / c("info"))

    state = write_and_reread(with_gradient(priors.withColumn("theta", F.lit(0.0))).withColumn("d", c("z")), "strength-step")
    size = state.agg(F.sum(c("g") * c("z"))).first()[0] or 0.0
    for _ in range(most_steps):
        if size <= tolerance:
            break
        bend = paired(state, "theta", "d").agg(F.sum(c("n") * p * (1.0 - p) * F.pow(c("d1") - c("d2"), F.lit(2)))).crossJoin(
            state.agg(F.sum(c("d") * c("d") * c("tau")), F.sum(c("g") * c("d")))).first()      # one-row frames
        step = bend[2] / (bend[0] + bend[1])
        moved = state.select("team", "n_series", "tau", (c("theta") + step * c("d")).alias("theta"), c("d").alias("_d"), c("g").alias("_g"))
        new = write_and_reread(with_gradient(moved), "strength-step")
        now, overlap = new.agg(F.sum(c("g") * c("z")), F.sum(c("_g") * c("z"))).first()
        turn = max((now - overlap) / size, 0.0)
        state, size = new.withColumn("d", c("z") + turn * c("_d")).drop("_d", "_g"), now
    else:
        raise RuntimeError(f"strengths did not settle in {most_steps} steps")
    sd = STRENGTH_SCALE / F.sqrt("info")
    mean = PRIOR_MEAN + STRENGTH_SCALE * c("theta")
    return state.select(
        "team", "n_series", mean.alias("posterior_mean"), (mean - BAND_94 * sd).alias("lo"), (mean + BAND_94 * sd).alias("hi"))


def rating_agreement(replayed: DataFrame, strengths: DataFrame) -> DataFrame:
    """Rating probability against strength probability: count, mean absolute gap, correlation."""
    s = strengths.select("team", "posterior_mean")
    rows = replayed.join(s.toDF("team1", "_m1"), "team1").join(s.toDF("team2", "_m2"), "team2")
    post = 1.0 / (1.0 + F.exp((c("_m2") - c("_m1")) / STRENGTH_SCALE))
    elo = elo_expected(c("elo_t1_pre"), c("elo_t2_pre"))
    return rows.select(elo.alias("e"), post.alias("s")).agg(
        F.count("*").alias("n"), F.avg(F.abs(c("e") - c("s"))).alias("mae"), F.corr("e", "s").alias("pearson_r"))


# ---- entity factors -------------------------------------------------------------------------
def encode_entities(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Indices 1..n by name from the training entities only; unseen entities get 0."""
    names = train.select(F.explode(F.array("team1", "team2")).alias("team")).where("team IS NOT NULL").distinct()
    # sampled ranges of the names themselves hold about equally many, whatever the names begin with
    ranged = write_and_reread(names.repartitionByRange("team").withColumn("_part", F.spark_partition_id()), "entity-names")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_part").orderBy("team")
    vocab = ranged.join(offsets, "_part").select(
        "team", (c("_b") + F.row_number().over(inside)).cast("long").alias("idx"))
    for n in (1, 2):
        rows = rows.join(vocab.select(c("team").alias(f"team{n}"), c("idx").alias(f"team{n}_idx")), f"team{n}", "left").withColumn(
            f"team{n}_idx", F.coalesce(f"team{n}_idx", F.lit(0).cast("long")))
    return rows


def entity_factor_model(train: DataFrame, numeric: list[str], factors: int = 16, rounds: int = 100) -> PipelineModel:
    """Learned entity factors with pair interaction plus numeric inputs: a factorisation machine."""
    scale = VectorAssembler(inputCols=numeric, outputCol="_n")
    return Pipeline(stages=[
        StringIndexer(inputCols=["team1", "team2"], outputCols=["_i", "_j"], stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=["_i", "_j"], outputCols=["_a", "_b"], dropLast=True),
        scale, StandardScaler(inputCol="_n", outputCol="_s", withMean=True),
        VectorAssembler(inputCols=["_a", "_b", "_s"], outputCol="features"),
        FMClassifier(labelCol="label", factorSize=factors, maxIter=rounds, seed=SEED, stepSize=0.02, regParam=1e-3),
    ]).fit(train)


def embedding_pairs(matches: DataFrame, vectors: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent pairs with their record and the cosine of their vectors (team, vector)."""
    a, b = F.least("team1", "team2"), F.greatest("team1", "team2")
    pairs = matches.groupBy(a.alias("a"), b.alias("b")).agg(
        F.count("*").alias("n"), F.count_if(c("winner") == a).alias("a_wins")).orderBy(F.desc("n"), "a", "b").limit(top)
    v = vectors.select("team", F.transform("vector", lambda x: x.cast("double")).alias("v"))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    joined = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    cosine = F.try_divide(dot("va", "vb"), F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    return joined.select("a", "b", "n", "a_wins", (c("n") - c("a_wins")).alias("b_wins"), cosine.alias("cosine"))


# ---- batch scoring and the training run -----------------------------------------------------
def score_batch(model: object, names: list[str], requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Symmetric win probabilities for (request_id, team1, team2, best_of[, context columns]).

    Both orientations are scored in one pass; the answer is the mean of p and 1 - p(swapped).
    Requests with a best_of other than 1, 3, 5 come back rejected.
    """
    rows = evaluate.rating_lookup(evaluate.rating_lookup(requests, ratings, "team1"), ratings, "team2")
    for name, value in REQUEST_DEFAULTS.items():
        given = c(name).cast("double") if name in requests.columns else F.lit(None).cast("double")
        rows = rows.withColumn(name, F.coalesce(given, F.lit(value)))
    rows = rows.withColumn("elo_diff", c("team1_rating") - c("team2_rating"))
    rows = rows.withColumn("is_bo1", (c("best_of") == 1).cast("double"))
    rows = rows.withColumn("bo1_elo", c("is_bo1") * c("elo_diff"))
    known = {*REQUEST_DEFAULTS, "elo_diff", "is_bo1", "bo1_elo"}
    unknown = [n for n in names if n not in known and not n.startswith("tier_")]
    if unknown:
        raise KeyError(f"the batch has no column or default for model inputs {unknown}")
    accepted = rows.where(c("best_of").isin(1, 3, 5))

    def inputs(sign: int) -> Column:
        cells = []
        for n in names:
            value = F.lit(0.0) if n.startswith("tier_") else c(n)
            if sign < 0 and n in ODD_FEATURES:
                value = -value
            if sign < 0 and n in HALF_FEATURES:
                value = 1.0 - value
            cells.append(value)
        return array_to_vector(F.array(*cells))

    both = accepted.select("request_id", F.lit(1).alias("sign"), inputs(1).alias("features")).unionByName(
        accepted.select("request_id", F.lit(-1).alias("sign"), inputs(-1).alias("features")))
    scored = predict_proba(model, both).groupBy("request_id").agg(
        ((F.max(F.when(c("sign") == 1, c("p"))) + 1.0 - F.max(F.when(c("sign") == -1, c("p")))) / 2.0).alias("p_team1"))
    return rows.join(scored, "request_id", "left").select(
        "request_id", "team1", "team2", "best_of", F.when(c("p_team1").isNull(), "rejected").otherwise("ok").alias("status"),
        "p_team1", c("team1_rating").alias("elo_t1"), c("team2_rating").alias("elo_t2"),
        F.concat_ws(", ", F.when(c("team1_unknown"), c("team1")), F.when(c("team2_unknown"), c("team2"))).alias("unknown_team"))


def train_run(store: DataFrame, ratings: DataFrame, folder: str, cutoff: str, extra: list[str], version: str = "lr+roster") -> DataFrame:
    """Fit, evaluate and store model, metadata and final ratings under ``folder``; returns the metadata row."""
    from faceoff.sources.files import write_json

    rows, names = feature_matrix(store, extra, cutoff)
    model = fit_logistic(rows.where("split = 'train'"))
    scored = predict_proba(model, rows.where("split = 'test'"))
    model.write().overwrite().save(f"{folder}/model")
    n_train = rows.where("split = 'train'").agg(F.count("*").alias("n_train"))
    meta = evaluate.score(scored, p="p", y="label").withColumnRenamed("n", "n_test").crossJoin(
        evaluate.ece(scored, p="p", y="label")).crossJoin(n_train).withColumns({      # one-row frames
            "feature_names": F.array(*[F.lit(n) for n in names]), "cutoff": F.lit(cutoff), "model_version": F.lit(version)})
    write_json(meta, f"{folder}/features")
    write_json(ratings.select("team", F.round("rating", 4).alias("rating")), f"{folder}/ratings")
    return store.sparkSession.read.schema(meta.schema).json(f"{folder}/features")


def dated_roster_ab(store: DataFrame, tenure: DataFrame, cutoff: str) -> DataFrame:
    """Log loss with and without the tenure features, on the same split and rows."""
    base, names = feature_matrix(store, ["h2h_t1_win_share", "roster_stability_diff", "standin_diff"], cutoff)
    added = ["tenure_min_diff", "tenure_avg_diff", "recent_join_diff"]
    joined = base.join(tenure.select("match_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in added]), "match_id")
    wide = VectorAssembler(inputCols=["features", *added], outputCol="_x").transform(joined)
    wide = write_and_reread(wide.select("match_id", "label", "split", "features", "_x"), "dated-rows")      # read by two fits and their scores
    parts = []
    for label, column, k in (("current", "features", len(names)), ("with dated roster", "_x", len(names) + len(added))):
        rows = wide.select("match_id", "label", "split", c(column).alias("features"))
        train = rows.where("split = 'train'")
        model = LogisticRegression(labelCol="label", regParam=1.0 / max(train.count(), 1), standardization=False, maxIter=2000).fit(train)
        scored = predict_proba(model, rows.where("split = 'test'"))
        parts.append(evaluate.score(scored, p="p", y="label").crossJoin(evaluate.ece(scored, p="p", y="label")).withColumns(
            {"label": F.lit(label), "n_features": F.lit(k)}))
    return reduce(DataFrame.unionByName, parts).select("label", "n_features", "logloss", "brier", "acc", "ece", "n")
