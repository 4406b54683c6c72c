"""Column expressions: names, slugs, odds, ratings. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the published behaviour) --------------------------------------
SEASON_DAYS = {"winter": "01-15", "spring": "04-15", "summer": "07-15", "fall": "10-15",
               "autumn": "10-15"}
DEFAULT_DAY = "07-01"
COUNTRY_CODES = {
    "argentina": "AR", "australia": "AU", "austria": "AT", "belarus": "BY", "belgium": "BE",
    "bosnia and herzegovina": "BA", "brazil": "BR", "bulgaria": "BG", "canada": "CA",
    "chile": "CL", "china": "CN", "colombia": "CO", "croatia": "HR", "czech republic": "CZ",
    "czechia": "CZ", "denmark": "DK", "egypt": "EG", "estonia": "EE", "finland": "FI",
    "france": "FR", "germany": "DE", "greece": "GR", "hong kong": "HK", "hungary": "HU",
    "india": "IN", "indonesia": "ID", "ireland": "IE", "israel": "IL", "italy": "IT",
    "japan": "JP", "jordan": "JO", "kazakhstan": "KZ", "latvia": "LV", "lebanon": "LB",
    "lithuania": "LT", "malaysia": "MY", "mexico": "MX", "mongolia": "MN", "netherlands": "NL",
    "new zealand": "NZ", "norway": "NO", "peru": "PE", "philippines": "PH", "poland": "PL",
    "portugal": "PT", "romania": "RO", "russia": "RU", "serbia": "RS", "singapore": "SG",
    "slovakia": "SK", "south africa": "ZA", "south korea": "KR", "spain": "ES", "sweden": "SE",
    "switzerland": "CH", "taiwan": "TW", "thailand": "TH", "tunisia": "TN", "turkey": "TR",
    "ukraine": "UA", "united kingdom": "GB", "united states": "US", "uruguay": "UY",
    "uzbekistan": "UZ", "vietnam": "VN",
}
PAGE_COUNTRY_CODES = {"ukraine": "UA", "russia": "RU", "kazakhstan": "KZ", "belarus": "BY",
                      "mongolia": "MN", "uzbekistan": "UZ", "kyrgyzstan": "KG",
                      "azerbaijan": "AZ", "estonia": "EE", "latvia": "LV", "lithuania": "LT"}
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")
QUOTE_MARKS = "«»„“”\"‘’'"
YEAR_PATTERN = r"(?<!\d)(20[0-2]\d)(?!\d)"
SEASON_PATTERN = r"(?i)\b(winter|spring|summer|fall|autumn)\b"
NICKNAME_PATTERN = r"\s*'[^']*'\s*"
QUOTED_PATTERN = "[«„\"“”'‘’]([^«»„“”\"'‘’]*)[»“”'’]"
LABEL_PATTERN = r"^(.*?)\s*\((.*?)\),\s*([A-Z]{2})$"
ELO_SCALE = 400.0
LOSS_CLIP = 1e-15
LOGIT_CLIP = 1e-6
# ---------------------------------------------------------------------------------------------


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    """A small literal map; missing keys give null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(hi)), F.lit(lo)))


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(name))


# ---- event slugs ----------------------------------------------------------------------------
def slug_year(slug: Column) -> Column:
    found = F.regexp_extract(slug, YEAR_PATTERN, 1)
    return F.when(found != "", found.cast("int"))


def _season(slug: Column) -> Column:
    return F.lower(F.regexp_extract(slug, SEASON_PATTERN, 1))


def slug_game(slug: Column) -> Column:
    year, season = slug_year(slug), _season(slug)
    late = (year == 2023) & season.isin("fall", "autumn", "winter")
    return F.when((year >= 2024) | late, "cs2").otherwise("csgo")


def slug_date(slug: Column) -> Column:
    day = F.coalesce(_lookup(SEASON_DAYS, _season(slug)), F.lit(DEFAULT_DAY))
    year = slug_year(slug)
    return F.coalesce(F.concat_ws("-", year.cast("string"), F.when(year.isNotNull(), day)), F.lit(""))


# ---- player names ---------------------------------------------------------------------------
def country_code(country: Column) -> Column:
    return F.coalesce(_lookup(COUNTRY_CODES, F.lower(F.trim(country))), F.lit(""))


def player_label(nick: Column, real: Column, country: Column) -> Column:
    """'Nick (Real Name), CC'; parts that are unknown are left out."""
    nick = F.trim(F.coalesce(nick, F.lit("")))
    real = F.regexp_replace(F.coalesce(real, F.lit("")), NICKNAME_PATTERN, " ")
    real = F.regexp_replace(F.trim(real), r"\s{2,}", " ")
    code = country_code(F.coalesce(country, F.lit("")))
    name = F.when(real != "", F.concat(nick, F.lit(" ("), real, F.lit(")"))).otherwise(nick)
    return F.when(code != "", F.concat(name, F.lit(", "), code)).otherwise(name)


def short_label(nick: Column, country: Column) -> Column:
    code = country_code(F.coalesce(country, F.lit("")))
    return F.when(code != "", F.concat(F.trim(nick), F.lit(", "), code)).otherwise(F.trim(nick))


def key_of(label: Column) -> Column:
    """Identity across spellings: case-folded nickname and country code."""
    text = F.trim(label)
    before = F.substring_index(text, " (", 1)
    nick = F.substring_index(before, ",", 1)
    tail = F.when(F.contains(before, F.lit(",")), F.regexp_extract(before, r"(?s)^[^,]*,(.*)$", 1)).otherwise("")
    code = F.when(F.contains(text, F.lit("),")), F.substring_index(text, "),", -1)).otherwise(tail)
    return F.concat(F.lower(F.trim(nick)), F.lit("|"), F.lower(F.trim(code)))


def name_key(value: Column) -> Column:
    """Comparison key: quoted nickname and quote marks removed, blanks collapsed, lower case."""
    text = F.regexp_replace(F.replace(value, F.lit("_"), F.lit(" ")), QUOTED_PATTERN, " ")
    text = F.translate(text, QUOTE_MARKS, "")
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parse_label(label: Column) -> Column:
    """struct(nick, real, cc) of a long-form label; null when it has another shape."""
    text = F.trim(label)
    part = [F.regexp_extract(text, LABEL_PATTERN, i) for i in (1, 2, 3)]
    return F.when(
        F.regexp_like(text, F.lit(LABEL_PATTERN)),
        F.struct(F.lower(F.trim(part[0])).alias("nick"), part[1].alias("real"),
                 F.lower(part[2]).alias("cc")),
    )


# ---- odds -----------------------------------------------------------------------------------
def de_vig(p1: Column, p2: Column) -> Column:
    """Side-one share of two implied probabilities."""
    return F.try_divide(p1, p1 + p2)


def devig(odds1: Column, odds2: Column) -> Column:
    """struct(p1, p2, margin) from decimal odds; null unless both exceed 1."""
    a, b = 1.0 / odds1, 1.0 / odds2
    return F.when((odds1 > 1) & (odds2 > 1), F.struct(
        (a / (a + b)).alias("p1"), (b / (a + b)).alias("p2"), (a + b - 1.0).alias("margin")))


def odds_to_probability(odds: Column) -> Column:
    return 1.0 / F.greatest(odds, F.lit(1.001))


def expected_value(p: Column, odds: Column) -> Column:
    return p * (odds - 1.0) - (1.0 - p)


# ---- ratings and probabilities --------------------------------------------------------------
def elo_expected(ra: Column, rb: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (rb - ra) / ELO_SCALE))


def elo_update(ra: Column, rb: Column, result: Column, k: float | Column = 32.0) -> Column:
    return ra + k * (result - elo_expected(ra, rb))


def bo3_probability(p: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("probability outside [0, 1]: "), p.cast("string")))
    return F.when((p < 0) | (p > 1), bad.cast("double")).otherwise(p * p * (3.0 - 2.0 * p))


def series_probability(p: Column, best_of: int) -> Column:
    """P(win a best-of-n) from an independent per-map probability: a binomial tail."""
    q = clip(p, 1e-6, 1 - 1e-6)
    if best_of == 1:
        return q
    from math import comb

    need = (best_of + 1) // 2
    games = 2 * need - 1
    terms = [F.lit(float(comb(games, w))) * F.pow(q, F.lit(w)) * F.pow(1.0 - q, F.lit(games - w))
             for w in range(need, games + 1)]
    return clip(reduce(lambda a, b: a + b, terms), 0.0, 1.0)


def logit(p: Column) -> Column:
    q = clip(p, LOGIT_CLIP, 1 - LOGIT_CLIP)
    return F.ln(q / (1.0 - q))


def row_log_loss(p: Column, y: Column) -> Column:
    q = clip(p, LOSS_CLIP, 1.0 - LOSS_CLIP)
    return -(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q))


# ---- text rendering -------------------------------------------------------------------------
def fixed_point(value: Column, digits: int, sign: str = "") -> Column:
    """Text of a number with ``digits`` decimals, null for null; an exact tie of the stored double goes to the even digit.

    ``sign`` "+" also shows the sign of positive numbers. Java's ``%.nf`` would round the shortest decimal half up instead.
    """
    number, shape = value.cast("double"), "0" + ("." + "0" * digits if digits else "")
    text = F.call_function("format_number", number, F.lit(f"+{shape};-{shape}" if sign == "+" else shape))
    inf = F.lit(float("inf"))
    return F.when(number == inf, F.lit(f"{sign}inf")).when(number == -inf, F.lit("-inf")).otherwise(text)


def render_number(value: Column, digits: int = 2) -> Column:
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), "—").otherwise(fixed_point(number, digits))


def render_share(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), "—").otherwise(
        F.concat(fixed_point(value.cast("double") * 100.0, digits), F.lit("%")))


def month_label(ts: Column) -> Column:
    """'1996/March' - the year/month-name label of a timestamp."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(ts))
    return F.concat_ws("/", F.year(ts).cast("string"), name)
