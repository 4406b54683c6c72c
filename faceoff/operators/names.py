"""Batch resolution of typed names against the names in the data and a curated alias sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.scalar import key_of, name_key

c = F.col


def _substrings(df: DataFrame, text: str, lengths: DataFrame) -> DataFrame:
    """All substrings of ``text`` whose length occurs in ``lengths``.

    A "contains" condition thereby becomes an equi-join. A name is short, so each gives at most
    length x distinct-lengths rows.
    """
    sizes = lengths.agg(F.collect_set("n").alias("_sizes"))      # one row: distinct request lengths
    starts = F.when(F.length(text) >= c("_size"), F.sequence(F.lit(1), F.length(text) - c("_size") + 1))
    return (
        df.crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes"))
        .withColumn("_start", F.explode(starts))
        .withColumn("_part", c(text).substr(c("_start"), c("_size")))
        .drop("_sizes", "_size", "_start").distinct())


def _outcome(matches: DataFrame, tier: int, name: str, identity: str, only_if_single: bool = False) -> DataFrame:
    """One row per request this tier can answer."""
    out = matches.groupBy("request").agg(
        F.min(c(name)).alias("resolved"), F.countDistinct(identity).alias("_ids"), F.countDistinct(name).alias("n_matches"))
    if only_if_single:
        out = out.where("n_matches = 1")
    return _answers(out, tier)


def _answers(out: DataFrame, tier: int) -> DataFrame:
    """(request, resolved, _ids, n_matches) as the answers of a tier."""
    single = c("_ids") == 1
    return out.select("request", F.lit(tier).alias("tier"), F.when(single, c("resolved")).alias("resolved"),
                      F.when(single, "ok").otherwise("ambiguous").alias("status"), "n_matches")


def _loose(keyed: DataFrame, sheet: DataFrame) -> DataFrame:
    """Requests whose key lies inside an alias, or all of whose words are words of it: resolved, _ids, n_matches.

    Aliases are summed up per fragment before any request meets them, so a request of one letter costs one row. Words in another
    order than the alias's can only add matches for keys of several words: these read the postings of their rarest word,
    compare the others there, and count what no fragment has counted.
    """
    lengths = keyed.select(F.length("_key").alias("n")).distinct()
    fragments = _substrings(sheet, "_alias", lengths).groupBy("_part").agg(
        F.min("canonical").alias("resolved"), F.countDistinct("canonical").alias("n_matches"))
    inside = keyed.join(fragments, c("_key") == c("_part")).select("request", "resolved", "n_matches")
    words: Column = F.array_distinct(F.split("_key", " "))
    postings = sheet.withColumn("_have", F.array_distinct(F.split("_alias", " "))).withColumn("_word", F.explode("_have"))
    common = postings.groupBy("_word").agg(F.count("*").alias("_n"))
    several = keyed.withColumn("_want", words).where(F.contains("_key", F.lit(" "))).withColumn("_word", F.explode("_want"))
    rarest = several.join(common, "_word").groupBy("request", "_key", "_want").agg(
        F.min_by("_word", F.struct("_n", "_word")).alias("_word"), F.count("*").alias("_known")).where(F.size("_want") == c("_known"))
    met = rarest.join(postings, "_word").where(F.forall("_want", lambda w: F.array_contains("_have", w))).select("request", "_key", "canonical").distinct()
    own = sheet.groupBy("canonical").agg(F.collect_set("_alias").alias("_all"))      # a name's own aliases
    apart = met.join(own, "canonical").where(~F.exists("_all", lambda a: F.contains(a, c("_key")))).groupBy("request").agg(
        F.min("canonical").alias("resolved"), F.count("*").alias("n_matches"))
    return inside.unionByName(apart).groupBy("request").agg(F.min("resolved").alias("resolved"), F.sum("n_matches").alias("n_matches")).withColumn(
        "_ids", c("n_matches"))


def resolve_names(requests: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """request -> (resolved, status ok / ambiguous / missing, tier, n_matches).

    Tiers: 1 exact, 2 any case, 3 nickname, 4 fragment, 5 curated exact, 6 curated loose. The
    first tier that says anything decides; several identities are reported, never guessed.
    ``requests(request)``, ``names(player)``, ``aliases(canonical, alias)``.
    """
    asked = requests.select(F.trim("request").alias("request")).distinct().withColumn("_low", F.lower("request"))
    known = names.select("player").distinct().withColumns({
        "identity": key_of(c("player")), "_full": F.lower("player"),
        "_nick": F.lower(F.substring_index("player", " (", 1))})
    lengths = asked.select(F.length("_low").alias("n")).distinct()
    # one row per fragment before any request meets it: a common fragment is no hot key
    fragments = _substrings(known.select("player", "identity", "_full"), "_full", lengths).groupBy("_part").agg(
        F.min("player").alias("resolved"), F.countDistinct("identity").alias("_ids"), F.countDistinct("player").alias("n_matches"))
    tiers = [
        _outcome(asked.join(known, c("request") == c("player")), 1, "player", "player"),
        _outcome(asked.join(known, c("_low") == c("_full")), 2, "player", "player", only_if_single=True),
        _outcome(asked.join(known, c("_low") == c("_nick")), 3, "player", "identity"),
        _answers(asked.join(fragments, c("_low") == c("_part")), 4),
    ]
    if aliases is not None:
        keyed = asked.withColumn("_key", name_key(c("request"))).where("_key <> ''")
        sheet = aliases.select("canonical", name_key(c("alias")).alias("_alias")).distinct()
        tiers.append(_outcome(keyed.join(sheet, c("_key") == c("_alias")), 5, "canonical", "canonical"))
        tiers.append(_answers(_loose(keyed, sheet), 6))
    first = reduce(DataFrame.unionByName, tiers).groupBy("request").agg(
        F.min_by(F.struct("tier", "resolved", "status", "n_matches"), "tier").alias("_o"))
    return asked.select("request").join(first, "request", "left").select(
        "request", "_o.resolved", F.coalesce("_o.status", F.lit("missing")).alias("status"), "_o.tier",
        F.coalesce("_o.n_matches", F.lit(0)).alias("n_matches"))
