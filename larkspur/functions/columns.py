"""Column expressions that batch and streaming plans share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def bucket_close(ts: Column, unit: str = "hour") -> Column:
    """The instant the bucket of ``ts`` closes: a row stamped 14:00 covers [13:00, 14:00)."""
    return F.date_trunc(unit, ts) + F.expr(f"INTERVAL 1 {unit.upper()}")


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, floored."""
    return F.unix_timestamp(ts)


def shrunk_rate(clicks: Column, shown: Column, prior: Column, strength: float) -> Column:
    """(clicks + prior x strength) / (shown + strength)."""
    if strength <= 0:
        raise ValueError("strength must be positive")
    return (clicks + prior * strength) / (shown + strength)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def digest_digits(*parts: Column) -> Column:
    """The eight hexadecimal digits of ``digest_number``, whose order is that of the numbers."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)


def digest_number(*parts: Column) -> Column:
    """A non-negative 32-bit number from an MD5 over the parts; any engine can make it again."""
    return F.conv(digest_digits(*parts), 16, 10).cast("long")


def digest_uniform(*parts: Column) -> Column:
    """``digest_number`` scaled to [0, 1)."""
    return digest_number(*parts) / F.lit(float(1 << 32))


def half_life_weight(age_days: Column, half_life_days: float) -> Column:
    """exp(-ln 2 x age / half-life)."""
    if half_life_days <= 0:
        raise ValueError("a half-life must be positive")
    return F.exp(-F.lit(math.log(2) / half_life_days) * age_days)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of ``period`` steps."""
    angle = value.cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


SQL_FUNCTIONS = {
    "smoothed_ctr": "(clicks DOUBLE, shown DOUBLE, prior DOUBLE, strength DOUBLE) RETURNS DOUBLE RETURN (clicks + prior * strength) / (shown + strength)",
    "freshness": "(age DOUBLE, half_life DOUBLE) RETURNS DOUBLE RETURN pow(2.0D, -age / half_life)",
    "cosine": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN try_divide(aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, x) -> s + x),
        sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))""",
}


def register_sql_functions(spark) -> None:
    """Makes the scalar functions callable from SQL in this session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
