"""Structured records out of page text: transfer templates and infobox fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faceoff.functions.scalar import PAGE_COUNTRY_CODES, _lookup

# ---- fixed values: the page formats ---------------------------------------------------------
TRANSFER_PATTERN = r"(?s)\{\{Transfer Row\|(.*?)\}\}"
FOOTNOTE_PATTERN = r"(?s)<ref[^>]*>.*?</ref>"
INFOBOX_FIELDS = ("name", "romanized_name", "country")
# ---------------------------------------------------------------------------------------------


def extract_transfers(pages: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """One row per person in every dated transfer template (up to five people per template)."""
    body = F.explode(F.regexp_extract_all(F.col(text), F.lit(TRANSFER_PATTERN), F.lit(1))).alias("_body")
    chunks = F.filter(F.split("_body", r"\|"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(chunks, lambda x: F.struct(
        F.trim(F.substring_index(x, "=", 1)).alias("k"),
        F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    rows = pages.select(F.col(page).alias("page"), body).withColumn("_f", pairs)

    def field(name: str) -> Column:
        """The last value given for a field; '' when absent."""
        hits = F.filter("_f", lambda x: x["k"] == name)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(""))

    def person(slot: str) -> Column:
        role = field(f"role{slot}")
        return F.struct(
            field(f"name{slot}").alias("player"), field(f"flag{slot}").alias("flag"),
            F.when(role != "", role).otherwise(field("role1")).alias("role"))

    return rows.select(
        field("date").alias("date"), field("team1").alias("from_team"), field("team2").alias("to_team"), "page",
        F.inline(F.array(*[person(s) for s in ("", "2", "3", "4", "5")])),
    ).where("date <> '' AND player <> ''").select("date", "player", "flag", "from_team", "to_team", "role", "page")


def infobox_field(text: Column, name: str) -> Column:
    """The first ``|name = value`` line, without footnotes; '' when absent."""
    raw = F.regexp_extract(text, rf"(?md)^\|\s*{name}\s*=\s*(.+?)\s*$", 1)
    return F.trim(F.regexp_replace(raw, FOOTNOTE_PATTERN, ""))


def extract_infobox(pages: DataFrame, expected: str = "country", text: str = "text") -> DataFrame:
    """Name fields of each page and whether its country contradicts the expected code."""
    out = pages.withColumns({f"page_{n}": infobox_field(F.col(text), n) for n in INFOBOX_FIELDS})
    got = F.coalesce(_lookup(PAGE_COUNTRY_CODES, F.lower("page_country")), F.upper(F.substring("page_country", 1, 2)))
    want = F.upper(F.coalesce(F.col(expected), F.lit("")))
    return out.withColumns({
        "page_code": got, "country_mismatch": (want != "") & (got != "") & (got != want)}).drop(text)
