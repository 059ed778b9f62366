"""Column functions for names, identifiers, addresses, values and coordinates.

All are compositions of built-in expressions, so they stay in generated code.
A missing value gives a missing key unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Surname particles that are no evidence of identity.
PARTICLES = (
    "DE", "DEL", "DELA", "DELAS", "DELOS", "LA", "LAS", "LE", "LOS", "DA", "DAS",
    "DI", "DO", "DOS", "VAN", "VANDER", "VON", "DER", "DEN", "TER", "TEN",
    "ST", "STE", "MC", "MAC", "EL", "AL", "BIN", "IBN", "BEN", "ABU", "Y", "I",
)
MIN_SURNAME_TOKEN = 4
# Credentials and titles dropped from personal names.
NAME_NOISE = (
    "DNP", "DNSC", "DNS", "PHD", "EDD", "MD", "DO", "MSN", "MSC", "MS", "MA", "MPH",
    "BSN", "BS", "BA", "RN", "APRN", "ARNP", "CNM", "CM", "CNS", "CRNP", "CRNA",
    "NP", "FNP", "WHNP", "PNP", "ANP", "AGNP", "IBCLC", "LCCE", "FACNM", "FAAN",
    "RNC", "LM", "CPM", "DR", "PROF", "MR", "MRS", "MISS", "JR", "SR", "II", "III", "IV",
)
# Street words and their abbreviations.
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "BOULEVARD": "BLVD", "PLACE": "PL", "LANE": "LN", "COURT": "CT",
    "PARKWAY": "PKWY", "HIGHWAY": "HWY", "SUITE": "STE", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
# Words that do not tell organizations apart.
ORG_STOP = ("INC", "LLC", "PC", "PA", "LLP", "CORP", "CORPORATION", "COMPANY", "CO", "THE", "OF", "AND")
# Codes of states and territories.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL",
    "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA",
    "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "AMERICAN SAMOA": "AS", "GUAM": "GU", "NORTHERN MARIANA ISLANDS": "MP", "PUERTO RICO": "PR", "VIRGIN ISLANDS": "VI",
}
# Letters with a stroke, and pairs of letters written as one, which have no decomposition.
STROKES = {"Ø": "O", "Ł": "L", "Đ": "D", "Ħ": "H", "Ŧ": "T", "Æ": "AE", "Œ": "OE", "ß": "SS", "ẞ": "SS", "Þ": "TH", "Ð": "D", "ı": "I"}


def _bases() -> tuple[str, str]:
    """Capital Latin letters with marks, and the letters that they are made of."""
    import unicodedata

    pairs = [(chr(c), base) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (base := unicodedata.normalize("NFD", chr(c))[0]) != chr(c) and base.isascii() and base.isupper()]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _bases()


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def transliterate(x: Column) -> Column:
    """Upper case, Latin letters without marks."""
    u = F.translate(F.upper(x), _FROM, _TO)
    for letter, plain in STROKES.items():
        u = F.replace(u, F.lit(letter), F.lit(plain))
    return F.regexp_replace(u, r"\p{M}", "")


def name_key(x: Column) -> Column:
    return squish(transliterate(x))


def has_name(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))


def blank_key(x: Column) -> Column:
    return F.coalesce(name_key(x), F.lit(""))


def first_initial(x: Column) -> Column:
    return F.nullif(F.substring(name_key(x), 1, 1), F.lit(""))


def surname_tokens(x: Column) -> Column:
    parts = F.split(F.regexp_replace(blank_key(x), r"[^A-Z']+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= MIN_SURNAME_TOKEN) & ~t.isin(*PARTICLES)))


def split_given(x: Column) -> tuple[Column, Column]:
    """(first word, rest or null) of a given name."""
    k = name_key(x)
    return F.nullif(F.substring_index(k, " ", 1), F.lit("")), F.nullif(F.trim(F.regexp_replace(k, r"^\S+\s*", "")), F.lit(""))


def strip_name_noise(x: Column) -> Column:
    """A name without words that are titles or degrees once their dots are gone; other dots turn into spaces."""
    parts = F.filter(F.split(x, r"[\s,]+"), lambda t: (t != "") & ~F.upper(F.replace(t, F.lit("."), F.lit(""))).isin(*NAME_NOISE))
    return squish(F.replace(F.array_join(parts, " "), F.lit("."), F.lit(" ")))


def parse_person(x: Column) -> Column:
    """struct(first, middle, last) of "Last, First Middle" or "First Middle Last"."""
    comma = F.contains(x, F.lit(","))
    tail = strip_name_noise(F.regexp_replace(x, r"^[^,]*,", ""))
    direct = strip_name_noise(x)
    turned = comma & (F.length(tail) > 0)
    last = F.when(turned, F.trim(F.substring_index(x, ",", 1))).otherwise(F.substring_index(direct, " ", -1))
    rest = F.when(turned, tail).otherwise(F.trim(F.regexp_replace(direct, r"\S+$", "")))
    first, middle = split_given(rest)
    return F.struct(first.alias("first"), middle.alias("middle"), F.nullif(name_key(last), F.lit("")).alias("last"))


def given_tokens(x: Column) -> Column:
    """Whole given-name tokens of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(blank_key(x), r"[^A-Z]+", " "), " "), lambda t: F.length(t) >= 2))


def same_person(last_a: Column, given_a: Column, last_b: Column, given_b: Column) -> Column:
    return F.coalesce((name_key(last_a) == name_key(last_b)) & F.arrays_overlap(given_tokens(given_a), given_tokens(given_b)), F.lit(False))


def normalise_text(x: Column) -> Column:
    return F.nullif(squish(F.regexp_replace(transliterate(x), "[^A-Z0-9 ]", " ")), F.lit(""))


def letters_only(x: Column) -> Column:
    return F.nullif(F.regexp_replace(transliterate(x), "[^A-Z]", ""), F.lit(""))


def state_code(x: Column, strict: bool = True) -> Column:
    """Two-letter code of a state's name or code; other values are null, or kept when not ``strict``."""
    k = normalise_text(x)
    by_name = reduce(lambda c, kv: c.when(k == kv[0], kv[1]), STATES.items(), F.when(k.isin(*STATES.values()), k))
    return by_name if strict else by_name.otherwise(k)


def licence_number(x: Column) -> Column:
    """Letters and digits, leading zeros kept."""
    return F.nullif(F.regexp_replace(transliterate(x), "[^A-Z0-9]", ""), F.lit(""))


def licence_key(state: Column, number: Column) -> Column:
    s, n = state_code(state), licence_number(number)
    return F.when(s.isNotNull() & n.isNotNull(), F.concat_ws("::", s, n))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def npi(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) == 10, d)


def npi_valid(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9]{10}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), x)), F.lit(False))


def pad(x: Column, width: int) -> Column:
    """Left-pad with zeros, never cut; blank is null."""
    t = blank_to_null(x.cast("string"))
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def zip5_padded(x: Column) -> Column:
    d = F.nullif(digits(x), F.lit(""))
    return F.when(F.length(d) <= 5, F.lpad(d, 5, "0")).otherwise(F.substring(d, 1, 5))


def zip5_strict(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) >= 5, F.substring(d, 1, 5))


def zip5_first_run(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "([0-9]{5})", 1), F.lit(""))


def zip9(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) == 9, d)


def phone10(x: Column) -> Column:
    d = digits(x)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def address(x: Column) -> Column:
    """Street key that keeps the unit."""
    y = squish(F.regexp_replace(F.upper(F.trim(x)), "[.,#]", " "))
    for word, short in STREET_WORDS.items():
        y = F.regexp_replace(y, rf"\b{word}\b", short)
    return F.nullif(squish(y), F.lit(""))


# Further suffixes and directions of the postal standard.
POSTAL_WORDS = {
    "TERRACE": "TER", "CIRCLE": "CIR", "TRAIL": "TRL", "SQUARE": "SQ", "PLAZA": "PLZ", "ALLEY": "ALY", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "TURNPIKE": "TPKE", "CROSSING": "XING", "RIDGE": "RDG", "POINT": "PT", "MOUNT": "MT",
    "FORT": "FT", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW", "APARTMENT": "APT", "BUILDING": "BLDG", "FLOOR": "FL", "ROOM": "RM", "DEPARTMENT": "DEPT",
}


def standard_address(x: Column) -> Column:
    """Street key with the postal standard's suffixes, directions and unit words."""
    y = address(x)
    for word, short in POSTAL_WORDS.items():
        y = F.regexp_replace(y, rf"\b{word}\b", short)
    return y


def address_without_unit(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(address(F.regexp_replace(x, "#", " STE ")), r"\b(STE|APT|UNIT|FL|FLOOR|RM|ROOM)\b.*$", "")), F.lit(""))


def address_key(street: Column, state: Column) -> Column:
    """Exact-equality key; an empty street has none."""
    s = address_without_unit(street)
    return F.when(s.isNotNull(), F.concat_ws("_", s, F.upper(F.trim(state))))


def organization(x: Column) -> Column:
    """Organization key, empty for a missing name."""
    y = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), "['’ʼ`]", "")
    y = F.regexp_replace(F.regexp_replace(y, "[^A-Z0-9 ]", " "), rf"\b({'|'.join(ORG_STOP)})\b", " ")
    return squish(y)


def school(x: Column) -> Column:
    return F.nullif(squish(F.regexp_replace(squish(F.replace(F.upper(x), F.lit("&"), F.lit(" AND "))), "^THE ", "")), F.lit(""))


def year_of(x: Column, low: int = 1900, high: int = 2100) -> Column:
    """Year at the head of an ISO date or in the last four digits, within bounds."""
    head, tail = F.regexp_extract(x, "^([0-9]{4})-", 1), F.regexp_extract(x, "([0-9]{4})$", 1)
    y = F.when(head != "", head).otherwise(tail).try_cast("int")
    return F.when(y.between(low, high), y)


def suppressed_count(x: Column) -> Column:
    """struct(value, flag) of a count that may be a suppression word."""
    t = F.trim(x)
    value = F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    flag = F.when(t.isin("Suppressed", "Unreliable", "Not Applicable", "Missing"), F.lower(t)).when(value.isNotNull(), "ok").otherwise("unparsed")
    return F.struct(value.alias("value"), flag.alias("flag"))


def band(x: Column, edges: list[float], labels: list[str], low: float = 0, high: float | None = None) -> Column:
    """Half-open ladder: labels[i] below edges[i]; outside [low, high] or not finite is null."""
    v = x.try_cast("double")
    bad = v.isNull() | F.isnan(v) | (v < low) | (F.abs(v) == float("inf"))
    if high is not None:
        bad |= v > high
    out = F.when(bad, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(v < edge, label)
    return out.otherwise(labels[-1])


# Bands of years and of rurality codes.
def band_years_since_enumeration(x: Column) -> Column:
    return band(x, [5, 10, 15, 20], ["<5 years", "5-9 years", "10-14 years", "15-19 years", ">=20 years"], 0, 25)


def band_years_observed(x: Column) -> Column:
    return band(x, [5, 10, 15], ["<5 years", "5-9 years", "10-14 years", ">=15 years"], 1)


def band_rurality(x: Column) -> Column:
    v = x.try_cast("int")
    return F.when(v.between(1, 3), "Metropolitan (RUCC 1-3)").when(v.between(4, 6), "Nonmetropolitan, adjacent (RUCC 4-6)").when(v.between(7, 9), "Nonmetropolitan, remote (RUCC 7-9)")


# Bands of age.
def band_age(x: Column) -> Column:
    return band(x, [35, 45, 55, 65], ["<35", "35-44", "45-54", "55-64", ">=65"], 0, 120)


def decade(x: Column) -> Column:
    """Decade of a number, as 30s."""
    v = x.try_cast("int")
    return F.when(v.isNotNull(), F.concat((F.floor(v / 10) * 10).cast("string"), F.lit("s")))


# Boxes of places.
def classify_coordinate(lon: Column, lat: Column) -> Column:
    lon, lat = lon.try_cast("double"), lat.try_cast("double")
    box = lambda a, b, c, d: lon.between(a, b) & lat.between(c, d)
    have = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    return (
        F.when(~have, F.lit(None).cast("string"))
        .when(box(-68, -64, 17, 19) | box(-171, -168, -15, -13) | box(144, 147, 13, 21), "territory")
        .when(box(-180, -129, 51, 72) | box(-161, -154, 18, 23), "noncontiguous")
        .when(box(-125, -66, 24, 50), "conus")
        .otherwise("implausible")
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def safe_divide(a: Column, b: Column, default: float | None = None, tiny: float = 1e-10) -> Column:
    """a / b; the default where either is missing or the denominator is near zero."""
    bad = a.isNull() | b.isNull() | (F.abs(b) < tiny)
    return F.when(bad, F.lit(default).cast("double")).otherwise(a.cast("double") / b)


def safe_percent(a: Column, b: Column, digits: int = 1) -> Column:
    return F.bround(safe_divide(a, b, 0.0) * 100, digits)


def safe_rate(a: Column, b: Column, per: float = 1000.0, default: float | None = None) -> Column:
    return safe_divide(a, b, default) * per


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    return safe_divide(a, b, default)


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.6f_%.6f", lat, lon))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, in Arrow batches (there is no built-in form)."""
    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


def jaro_winkler_of(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    """Whole transpositions count; a common beginning helps texts above ``boost`` only."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= boost:
        return jaro
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro)


def sentence(template: str, *clauses: Column) -> Column:
    """A sentence with ``{column}`` filled in, and the clauses that are there after commas."""
    parts = re.split(r"\{(\w+)\}", template)
    filled = F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    return F.concat(F.concat_ws(", ", filled, *clauses), F.lit("."))


def across(df: DataFrame, columns: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """The same function over several columns."""
    return df.withColumns({c: f(F.col(c)) for c in columns})
