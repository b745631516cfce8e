"""Scalar column functions: NaN handling, transforms, calendar and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds below which a scale counts as degenerate.
TINY = 1e-12
#: 0.75 quantile of the standard normal distribution (fixed value).
MAD_TO_SD = 0.67448975
#: 0.95 quantile of the chi-squared distribution with one degree of freedom (fixed value).
CHI2_1_95 = 3.841458820694124


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """NaN means missing in the sources; Spark's aggregates only skip NULL."""
    return F.when(~F.isnan(col(c)), col(c))


def is_finite(c: Column | str) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), F.lit(False))


def slot_of(ts: Column | str, one_based: bool = False) -> Column:
    """Quarter-hour slot of the local wall clock, 0..95, or 1..96."""
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15) + int(one_based)).cast("int")


def vst(c: Column | str) -> Column:
    """Variance-stabilising transform."""
    return F.asinh(c)


def inverse_vst(c: Column | str) -> Column:
    return F.sinh(c)


def wind_speed(u: Column | str, v: Column | str) -> Column:
    """Speed from two components, NULL unless both are there."""
    return F.hypot(u, v)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year (the anonymous calendar rule)."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    i = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    m = F.floor((a + 11 * h + 22 * i) / 451)
    n = h + i - 7 * m + 114
    return F.make_date(year, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))


#: Nationwide German holidays (fixed values): (month, day), and days after Easter Sunday.
FIXED_HOLIDAYS = [(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)]
EASTER_HOLIDAYS = [-2, 1, 39, 50]


def is_holiday(date: Column | str) -> Column:
    """1 on a nationwide German public holiday, else 0.

    Computed from the date itself, so no dimension table is joined.
    """
    d = col(date)
    fixed = reduce(lambda a, b: a | b, [(F.month(d) == m) & (F.day(d) == n) for m, n in FIXED_HOLIDAYS])
    moving = F.datediff(d, easter(F.year(d))).isin(EASTER_HOLIDAYS)
    return (fixed | moving).cast("int")


def weekday_flags(date: Column | str) -> list[Column]:
    """weekday_0 (Monday) .. weekday_6."""
    return [(F.weekday(col(date)) == k).cast("int").alias(f"weekday_{k}") for k in range(7)]


def regime_flag(ts: Column | str, since: str) -> Column:
    """1 from a local date on."""
    return (col(ts) >= F.lit(since).cast("date")).cast("int")


#: Substring rules of feature names, first match counts (fixed values): label, any of.
GROUP_RULES = [
    ("Auction", ["exaa_d0"]),
    ("Price d-1", ["price_d1_"]),
    ("Price d-2", ["price_d2_"]),
    ("Price d-7", ["price_d7_"]),
    ("Load", ["load_d0"]),
    ("Wind", ["wind"]),
    ("Solar", ["ssrd", "sw_dir", "sw_dif"]),
    ("Weekday", ["weekday"]),
    ("Holiday", ["holiday"]),
    ("Market regime", ["is_15min"]),
]


def feature_group(name: Column | str, rules: list = GROUP_RULES) -> Column:
    """Group label of a feature name by ordered substring rules, else ``Other``."""
    low = F.lower(col(name))
    out = F.lit("Other")
    for label, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), label).otherwise(out)
    return out


def feature_cluster(name: Column | str) -> Column:
    """``Wind Cluster i`` or ``Solar Cluster i`` of a feature name, else ``Other``.

    Hourly (``_h``) and quarter-hourly (``_mtu``) solar names are both known.
    """
    low = F.lower(col(name))
    wind = F.regexp_extract(low, r"wind_speed_cluster_(\d+)_h\d+", 1)
    solar = F.regexp_extract(low, r"(?:ssrd|sw_dir|sw_dif)\w*cluster_(\d+)_(?:h|mtu)\d+", 1)
    return F.when(wind != "", F.concat(F.lit("Wind Cluster "), wind)).when(solar != "", F.concat(F.lit("Solar Cluster "), solar)).otherwise("Other")


def id_of_label(label: Column | str, prefix: str) -> Column:
    """The number after ``prefix`` in a label, NULL without it."""
    found = F.regexp_extract(col(label), prefix + r" (\d+)", 1)
    return F.when(found != "", found).cast("int")


def label_of(key: Column | str, labels: dict[str, str]) -> Column:
    """Display label of a key, the key itself if it has none."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, col(key)), col(key))


def pinball(y: Column | str, q: Column | str, tau: Column | str | float) -> Column:
    """Pinball loss of a quantile forecast."""
    d = col(y) - col(q)
    t = F.lit(tau) if isinstance(tau, float) else col(tau)
    return F.greatest(t * d, (t - 1) * d)


def covered(y: Column | str, low: Column | str, high: Column | str) -> Column:
    """1 if the value is in the closed interval, else 0."""
    return col(y).between(col(low), col(high)).cast("int")


def interval_score(y: Column | str, low: Column | str, high: Column | str, nominal: float) -> Column:
    """Width of the interval plus the penalty for a miss."""
    miss = F.greatest(col(low) - col(y), F.lit(0.0)) + F.greatest(col(y) - col(high), F.lit(0.0))
    return (col(high) - col(low)) + 2 / (1 - nominal) * miss


def sorted_quantiles(q: Column | str) -> Column:
    """Quantiles in ascending order; NaN, then NULL, last."""
    return F.array_sort(col(q))


def differences(q: Column | str) -> Column:
    """Differences of neighbours in an array."""
    a = col(q)
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def crosses(q: Column | str, tolerance: float = 0.0) -> Column:
    """True if a quantile lies below its lower neighbour."""
    return F.exists(differences(q), lambda d: d < -tolerance)


#: Terms of the two expansions of :func:`erfc`, enough for an error of 1e-14 (relative beyond the border, absolute below it).
ERFC_TERMS, ERFC_BORDER = 60, 2.0


def erfc(x: Column | str) -> Column:
    """Complementary error function of a number that is not negative, in column expressions.

    Below the border 1 minus the series e^(-x^2) 2/sqrt(pi) sum 2^n x^(2n+1) / (2n+1)!!, of
    which all terms are positive; from there the continued fraction of Laplace.
    """
    x = col(x)
    square = x * x
    terms = F.sequence(F.lit(ERFC_TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda s, n: 1 + s * 2 * square / (2 * n + 1))
    fraction = F.aggregate(terms, x, lambda s, n: x + n / 2 / s)
    bell = F.exp(-square) / 1.772453850905516
    return F.when(x < ERFC_BORDER, 1 - 2 * bell * x * series).otherwise(bell / fraction)
