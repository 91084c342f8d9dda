"""Column functions. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_offset(month: str | Column, start: str | Column, one_based: bool = True) -> Column:
    m, s = col(month), col(start)
    return (F.year(m) - F.year(s)) * 12 + F.month(m) - F.month(s) + int(one_based)


def convert_units(variable: str | Column, value: str | Column, month: str | Column) -> Column:
    """Kelvin to Celsius, metres of snow to mm, metres a day of rain and runoff to mm a month, evaporation with its sign turned."""
    v, x, days = col(variable), col(value), F.day(F.last_day(col(month)))
    return F.when(v == "T", x - 273.15).when(v == "SWE", x * 1000).when(v.isin("P", "R"), x * 1000 * days).when(v == "Evap", -x * 1000 * days).otherwise(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def name_tokens(name: str | Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct upper-case words of a name, punctuation as spaces, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.upper(col(name)), r"[().,'\-\s]+", " ")), " ")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, (*stop, ""))))


def excluded_direction(name: str | Column) -> Column:
    """Whether a station's name says that it lies above or at the inlet of the water body."""
    return F.upper(col(name)).rlike(r"\b(ABOVE|INLET)\b")


def parse_bool(text: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col(text).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def to_number(text: str | Column) -> Column:
    """A double, or null for text that is none."""
    return col(text).try_cast("double")


def pair_key(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws("|", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def lag_map_json(entries: str | Column) -> Column:
    """JSON text of an array of (variable, lag) structs, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(col(entries))))


def within_years(value: str | Column, year: str | Column, first: str | Column, last: str | Column) -> Column:
    """The value inside a sub-period of years, else null."""
    return F.when(col(year).between(col(first), col(last)), col(value))


def temporal_class(significant: str | Column, lag: str | Column) -> Column:
    d = col(lag)
    return F.when(~F.coalesce(col(significant), F.lit(False)), "not_significant").when(d > 0, "resolved").when(d == 0, "unresolved").otherwise("rejected_reverse")


def pair_seed(cause: str | Column, effect: str | Column) -> Column:
    """Seed of an edge's random numbers: the first 8 hex digits of md5(cause|effect)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", col(cause), col(effect))), 1, 8), 16, 10).cast("long")


def fingerprint(config: Column) -> Column:
    """16 hex digits that name a configuration (a struct or map column)."""
    return F.substring(F.sha2(F.to_json(config), 256), 1, 16)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation of the pairs that are known, null if either side does not vary (corr would fail)."""
    x, y = col(x), col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / (2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def number_text(x: str | Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(x))


def p_text(p: str | Column) -> Column:
    return F.when(col(p) < 0.001, F.format_string("%.2e", col(p))).otherwise(F.format_string("%.3f", col(p)))
