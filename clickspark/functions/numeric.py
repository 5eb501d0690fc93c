"""Column helpers shared by the operators.

All of them are built-in expressions (JVM side, whole-stage codegen); none
is a Python UDF.
"""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_sql(x, n: int = 2) -> Column:
    """SQL ``ROUND`` on the binary double: half away from zero on the stored
    value (1.005 -> 1.0), not on its printed decimal as Spark's ``round``."""
    x = _c(x)
    p = float(10 ** n)
    return F.signum(x) * F.floor(F.abs(x) * p + F.lit(0.5)) / F.lit(p)


def round_np(x, n: int = 2) -> Column:
    """numpy/pandas ``.round(n)``: half to even on ``x * 10**n``."""
    x = _c(x)
    p = float(10 ** n)
    return F.rint(x * F.lit(p)) / F.lit(p)


def ratio_or_null(num, den) -> Column:
    """``num / NULLIF(den, 0)`` as double (null when the denominator is 0 or
    null)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def ratio_or_zero(num, den) -> Column:
    """Python's guarded ``a / b if b else 0``."""
    den = _c(den)
    return F.when(den != 0, _c(num).cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def qcut_bucket(rn, n, q: int) -> Column:
    """Equal-frequency bin of unique rank ``rn`` (1..n) into ``q`` bins, as
    ``qcut(rank(method='first'), q)`` does: bins are right-closed on the
    rank quantiles ``1 + i*(n-1)/q``; the first rank is in bin 1.  Integer
    arithmetic, so no floating-point edge effects; n = 1 gives bin 1."""
    rn, n = _c(rn).cast("long"), _c(n).cast("long")
    num = (rn - 1) * q
    den = n - 1
    return (F.when(den <= 0, F.lit(1))
            .otherwise(F.greatest(F.lit(1), ((num + den - 1) / den).cast("long")).cast("int"))
            .cast("int"))


def ordered_key(x) -> Column:
    """A double as a bigint of the same order: its binary exponent and 52 bits
    of fraction, negated below zero.  Equal keys mean equal values (-0.0 is
    0.0); NaN and null have none.  Scaling by powers of two is exact, so no
    bit is lost; all built-in expressions."""
    x = _c(x)
    a, two = F.abs(x), F.lit(2.0)
    e = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))  # off by one at most
    e = F.when(a < F.pow(two, e), e - 1).when(a >= F.pow(two, e + 1), e + 1).otherwise(e)
    unit = F.lit(float(2 ** 52))
    normal = (e + 1023) * F.lit(2 ** 52) + ((a * F.pow(two, -e) - 1) * unit).cast("long")
    small = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    key = (F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52))
            .when(a < 2.0 ** -1022, small).otherwise(normal))
    return F.when(F.isnan(x), F.lit(None).cast("long")).when(x < 0, -key).otherwise(key)


def value_of_key(k: int) -> float:
    """The double that ``ordered_key`` maps to ``k``."""
    v = struct.unpack("<d", struct.pack("<q", abs(k)))[0]
    return -v if k < 0 else v


def micros(ts) -> Column:
    """Timestamp as microseconds since the epoch (bigint)."""
    return F.unix_micros(_c(ts))


def seconds_between(start, end) -> Column:
    """``end - start`` in fractional seconds (an interval's total_seconds)."""
    return (micros(end) - micros(start)).cast("double") / F.lit(1e6)


def whole_days_between(start, end) -> Column:
    """``(end - start).days``: whole elapsed days, floored (not calendar
    days)."""
    return F.floor((micros(end) - micros(start)) / F.lit(86400 * 1000000)).cast("long")


def minute_boundaries(start, end) -> Column:
    """``DATEDIFF('minute', start, end)``: number of minute boundaries crossed."""
    return ((F.unix_seconds(F.date_trunc("minute", _c(end)))
             - F.unix_seconds(F.date_trunc("minute", _c(start)))) / 60).cast("long")


# Sums of doubles: the magnitude of a value is cut into limbs of 24 bits, in
# units of 2^-60, which are summed as longs.  Long addition is associative, so
# the total does not depend on how rows meet, and it is exact.
_LIMB, _UNIT = 24, 60
_HUGE = 2.0 ** 74


def exact_parts(x, cond: Column | None = None) -> Column:
    """Aggregate: the limb sums of a double column as one struct (null values,
    and rows where ``cond`` fails, take no part).  ``merge_parts`` adds up such
    structs, ``exact_value`` turns one into the sum."""
    x = _c(x).cast("double")
    if cond is not None:
        x = F.when(cond, x)
    a, sign = F.abs(x), F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    step = float(2 ** _LIMB)
    high = F.floor(a * F.lit(2.0 ** (_UNIT - 3 * _LIMB)))                 # each rest below is exact
    r = (a - high.cast("double") * F.lit(2.0 ** (3 * _LIMB - _UNIT))) * F.lit(2.0 ** (_UNIT - 2 * _LIMB))
    mid = F.floor(r)
    r = (r - mid.cast("double")) * F.lit(step)
    low = F.floor(r)
    last = F.rint((r - low.cast("double")) * F.lit(step)).cast("long")
    plain = a < _HUGE  # false for NaN and infinity too
    limbs = [F.sum(F.when(plain, sign * limb)).alias(n) for n, limb in zip("dcba", (high, mid, low, last))]
    return F.struct(*limbs, F.sum(F.when(~plain, x)).alias("rest"))


def merge_parts(parts) -> Column:
    """Aggregate: the sum of ``exact_parts`` structs."""
    p = _c(parts)
    return F.struct(*[F.sum(p[n]).alias(n) for n in ("d", "c", "b", "a", "rest")])


def exact_value(parts) -> Column:
    """The double nearest to the sum (null when nothing was summed)."""
    p = _c(parts)
    total = p["a"].cast("decimal(38,0)")
    for i, n in enumerate("bcd", 1):
        total = total + (p[n].cast("decimal(19,0)") * F.lit(Decimal(2 ** (_LIMB * i))).cast("decimal(22,0)")).cast("decimal(38,0)")
        total = total.cast("decimal(38,0)")
    value = total.cast("double") * F.lit(2.0 ** -_UNIT)
    return F.when(p["rest"].isNull(), value).otherwise(F.coalesce(value, F.lit(0.0)) + p["rest"])


def exact_sum(x, cond: Column | None = None) -> Column:
    """Aggregate: the sum of a double column, added without rounding and
    rounded once, whatever the partitioning; null when nothing was summed.

    Exact for values that are multiples of 2^-60 (every double of magnitude
    0.004 or more; smaller ones are taken to the nearest multiple, each by
    itself).  Values of 2^74 and more, infinities and NaN are added as plain
    doubles.  A group may hold 2^39 rows, a total reach 2^60; beyond it Spark
    reports an overflow rather than give a wrong sum."""
    return exact_value(exact_parts(x, cond))


def exact_avg(x, cond: Column | None = None) -> Column:
    """Aggregate: ``exact_sum`` by the number of values (null without any)."""
    v = _c(x) if cond is None else F.when(cond, _c(x))
    return F.try_divide(exact_sum(x, cond), F.count(v).cast("double"))


def flag(cond: Column) -> Column:
    """Boolean as 0/1 int (``CASE WHEN cond THEN 1 ELSE 0 END``)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_when(cond: Column) -> Column:
    """``COUNT(*) FILTER (WHERE cond)`` as bigint."""
    return F.count(F.when(cond, F.lit(1)))
