"""Column expressions whose treatment of missing values is fixed.

Missing values are SQL nulls throughout; NaN and infinities are turned into
nulls on the way in (:func:`finite`).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the code for "no date" in day offsets.
NO_DATE = 365243


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_sentinel(c: Column | str, sentinel: int = NO_DATE) -> Column:
    """The sentinel as null."""
    return F.nullif(_c(c), F.lit(sentinel))


def holds(condition: Column) -> Column:
    """A condition as 0/1, where an unknown condition doesn't hold."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def missing(c: Column | str) -> Column:
    """1 where the value is missing, else 0."""
    return _c(c).isNull().cast("int")


def present(c: Column | str) -> Column:
    return _c(c).isNotNull().cast("int")


def total(flags: Iterable[Column]) -> Column:
    """Row-wise sum of flags."""
    return reduce(lambda a, b: a + b, flags)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null for a zero or missing denominator and for an infinite result."""
    return finite(F.try_divide(_c(a), F.nullif(_c(b).cast("double"), F.lit(0.0))))


def finite(c: Column | str) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(_c(c)) | (F.abs(_c(c)) == float("inf")), None).otherwise(_c(c))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(_c(c).isNotNull(), F.least(F.greatest(_c(c), F.lit(low)), F.lit(high)))


def ordinal(c: Column | str, ranks: dict[str, float]) -> Column:
    """Code of a category; categories without a code, and missing ones, are null."""
    out = F.lit(None).cast("double")
    for name, rank in ranks.items():
        out = F.when(_c(c) == name, F.lit(float(rank))).otherwise(out)
    return out


def longest_prefix(c: Column | str, prefixes: Iterable[str], default: str) -> Column:
    """The longest of the prefixes that the string starts with."""
    out = F.lit(default)
    for p in sorted(prefixes, key=len):
        out = F.when(_c(c).startswith(p), F.lit(p)).otherwise(out)
    return out


def hash_order(*cols: Column | str, seed: int = 42) -> Column:
    """A reproducible pseudo-random order: md5 of the values and a seed."""
    return F.md5(F.concat_ws("|", *(_c(c).cast("string") for c in cols), F.lit(str(seed))))


def uniform(*cols: Column | str, seed: int = 42) -> Column:
    """A reproducible number in [0, 1) from the same digest."""
    return F.conv(F.substring(hash_order(*cols, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 as 0.0), so sums in any order print alike."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
