"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def ratio0(n: Column, d: Column) -> Column:
    """n / d; 0 where d is 0 or either is missing."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def nearest(x: Column | str, digits: int) -> Column:
    """x at so many decimals: its product with a power of ten to the nearest whole number, halves away from 0.

    So do DuckDB and C. Spark's own round goes by the shortest decimal text of x, and so turns up products just below
    a half. Where the product overflows x stays.
    """
    x, scale = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    y = F.round(x * scale, 0) / scale
    return F.when(F.abs(y) == float("inf"), x).otherwise(y)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments; 0 for a constant side or fewer than two rows."""
    return ratio0(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))


def running(*keys: str, order: str = "date") -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def product(x: Column, over: Window | None = None) -> Column:
    """The product of x as an aggregate or over a window: 0 from the first 0 on, signs and sizes apart."""
    at = (lambda c: c) if over is None else (lambda c: c.over(over))
    zero_seen = at(F.max((x == 0).cast("int"))) == 1
    odd = F.coalesce(at(F.sum((x < 0).cast("int"))), F.lit(0)) % 2 == 1
    size = F.exp(F.coalesce(at(F.sum(F.ln(F.abs(F.nullif(x, F.lit(0.0)))))), F.lit(0.0)))
    return F.when(zero_seen, 0.0).otherwise(F.when(odd, -size).otherwise(size))


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year by Gauss's rule."""
    div = lambda a, b: F.floor(a / b)
    k = div(year, 100)
    m = (15 - div(13 + 8 * k, 25) + k - div(k, 4)) % 30
    d = (19 * (year % 19) + m) % 30
    e = (2 * (year % 4) + 4 * (year % 7) + 6 * d + (4 + k - div(k, 4)) % 7) % 7
    late = (d == 29) & (e == 6) | (d == 28) & (e == 6) & ((11 * m + 11) % 30 < 19)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), (d + e - F.when(late, 7).otherwise(0)).cast("int"))


#: Fixed: the days of the year (month, day) and the days from Easter Sunday on which XETRA is closed.
XETRA_DATES = ((1, 1), (5, 1), (10, 3), (12, 24), (12, 25), (12, 26), (12, 31))
XETRA_FROM_EASTER = (-2, 1, 50)


def trading_day(day: Column, exchange: Column) -> Column:
    """A weekday, on XETRA without its holidays."""
    feasts = F.datediff(day, easter(F.year(day))).isin(*XETRA_FROM_EASTER)
    fixed = (F.month(day) * 100 + F.dayofmonth(day)).isin(*(100 * m + d for m, d in XETRA_DATES))
    return (F.weekday(day) < 5) & ~((F.upper(exchange) == "XETRA") & (feasts | fixed))


def normalized_name(x: Column) -> Column:
    """Case-folded (with the sharp s) and with white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def listing_key(isin: str = "isin", exchange: str = "exchange", code: str = "code") -> Column:
    return F.concat_ws("__", exchange, isin, code)


def pair_key(left: str = "left", right: str = "right") -> Column:
    return F.concat(F.col(left), F.lit("___"), F.col(right))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def hash_bucket(text: Column, n: int) -> Column:
    """The first 64 bits of SHA-256, unsigned, modulo n."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for output, -0.0 as 0.0."""
    return df.select(*((nearest(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
