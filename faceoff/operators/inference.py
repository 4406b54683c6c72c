"""Classical tests: the data side is one aggregate, the tail probability a scalar on its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.tails import chi2_p_value, f_p_value, t_p_value

Z_95 = 1.959963984540054      # fixed value: normal quantile at 0.975


def welch_t(series: DataFrame) -> DataFrame:
    """Margin of multi-map against single-map contests; two-map draws are left out."""
    rows = series.where(~((F.col("margin") == 0) & (F.col("total_maps") == 2)))
    multi, single = (F.when(F.col("is_bo1") == flag, F.col("margin")) for flag in (False, True))
    out = rows.agg(
        F.count(single).alias("n1"), F.count(multi).alias("n2"), F.avg(single).alias("mean1"), F.avg(multi).alias("mean2"),
        (F.var_samp(single) / F.count(single)).alias("_a"), (F.var_samp(multi) / F.count(multi)).alias("_b"))
    c = F.col
    t = (c("mean2") - c("mean1")) / F.sqrt(c("_a") + c("_b"))
    df = F.pow(c("_a") + c("_b"), F.lit(2)) / (
        F.pow(c("_a"), F.lit(2)) / (c("n1") - 1) + F.pow(c("_b"), F.lit(2)) / (c("n2") - 1))
    return out.select("n1", "n2", "mean1", "mean2", t.alias("t"), df.alias("df"),
                      (t * F.sqrt(1.0 / c("n1") + 1.0 / c("n2"))).alias("d"))


def _group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))


def anova_by_group(df: DataFrame, group: str = "tier", value: str = "margin") -> DataFrame:
    """One-way F and eta squared from the group moments."""
    moments = _group_moments(df, group, value)
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    out = moments.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(n * v).alias("ss_within"),
                      (F.sum(n * m * m) - F.pow(F.sum(n * m), F.lit(2)) / F.sum("n")).alias("ss_between"))
    f = (F.col("ss_between") / (F.col("groups") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("groups")))
    return out.withColumns({"f": f, "eta_sq": F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))})


def pairwise_differences(df: DataFrame, group: str = "tier", value: str = "margin") -> DataFrame:
    """Mean differences between the groups (one row per group goes in)."""
    a = _group_moments(df, group, value).select(F.col(group).alias("a"), F.col("m").alias("ma"))
    b = a.select(F.col("a").alias("b"), F.col("ma").alias("mb"))
    return a.join(b, F.col("b") > F.col("a")).select(
        F.concat_ws("-", "b", "a").alias("pair"), (F.col("mb") - F.col("ma")).alias("difference"))


def prop_test(df: DataFrame, hit: Column, p0: float = 0.5) -> DataFrame:
    """Share against ``p0``: continuity-corrected chi-square, Wald and Wilson intervals."""
    out = df.agg(F.count_if(hit).alias("x"), F.count("*").alias("n"))
    x, n = F.col("x").cast("double"), F.col("n").cast("double")
    p = x / n
    off = F.abs(x - n * p0)
    yates = F.least(F.lit(0.5), off)
    se = F.sqrt(p * (1.0 - p) / n)
    z = F.lit(Z_95)
    half = z * z / (2.0 * n)

    def wilson(sign: int) -> Column:
        centre = p + sign * yates / n
        root = z * F.sqrt(centre * (1.0 - centre) / n + half / (2.0 * n))
        bound = (centre + half + sign * root) / (1.0 + 2.0 * half)
        return F.when(centre >= 1, 1.0).otherwise(bound) if sign > 0 else F.when(centre <= 0, 0.0).otherwise(bound)

    return out.select(
        "x", "n", p.alias("share"), (F.pow(off - yates, F.lit(2)) / (n * p0 * (1.0 - p0))).alias("chi2"),
        (p - 1.96 * se).alias("wald_lo"), (p + 1.96 * se).alias("wald_hi"),
        wilson(-1).alias("wilson_lo"), wilson(1).alias("wilson_hi"))


def inference_table(series: DataFrame) -> DataFrame:
    """The three tests in one (test, statistic, p_value, effect_size) table."""
    c = F.col
    t = welch_t(series).select(
        F.lit("welch_t_margin_bo1_vs_bo3plus").alias("test"), c("t").alias("statistic"),
        t_p_value(c("t"), c("df")).alias("p_value"), F.abs("d").alias("effect_size"))
    a = anova_by_group(series).select(
        F.lit("anova_margin_by_tier").alias("test"), c("f").alias("statistic"),
        f_p_value(c("f"), c("groups") - 1, c("n") - c("groups")).alias("p_value"), c("eta_sq").alias("effect_size"))
    s = prop_test(series.where("games_played >= 2"), c("swept")).select(
        F.lit("proptest_sweep_share_50pct").alias("test"), c("chi2").alias("statistic"),
        chi2_p_value(c("chi2")).alias("p_value"), c("share").alias("effect_size"))
    return t.unionByName(a).unionByName(s)
