"""Column expressions: null-safe arithmetic and text forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL when the divisor is 0."""
    return F.try_divide(top, bottom)


def log_ratio(now: ColumnOrName, before: ColumnOrName) -> Column:
    """Natural log of now/before; NULL when either is missing or 0."""
    return F.ln(ratio(col(now), col(before)))


def number(c: ColumnOrName) -> Column:
    """Text to double; NULL when it is not a number, ``NaN`` included."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def plus_minutes(time: Column, minutes: Column) -> Column:
    """A time so many minutes later; the count may exceed 32 bits."""
    day = 24 * 60
    days = F.floor(minutes / day).cast("int")
    return time + F.make_dt_interval(days=days, mins=(minutes - days.cast("long") * day).cast("int"))


def truncate(value: Column) -> Column:
    """Drop the fraction, toward zero."""
    return value.cast("long")


def fold_prefix(product: ColumnOrName, prefixes: Sequence[str]) -> Column:
    """Give products that share one of the prefixes (say ``"OPT_"``) one name (``"OPT"``)."""
    name = col(product)
    return reduce(
        lambda rest, p: F.when(name.startswith(p), F.lit(p.rstrip("_"))).otherwise(rest), prefixes, name
    )


def feature_vector(columns: Sequence[str], dtype: str = "double") -> Column:
    return F.array(*[F.col(c).cast(dtype) for c in columns])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def order_text(product: ColumnOrName, price: ColumnOrName, quantity: ColumnOrName) -> Column:
    return F.concat(
        F.lit("("), col(product), F.lit(", "), col(price).cast("string"), F.lit(", "),
        col(quantity).cast("string"), F.lit(")"),
    )


def trade_text(
    product: ColumnOrName,
    buyer: ColumnOrName,
    seller: ColumnOrName,
    price: ColumnOrName,
    quantity: ColumnOrName,
    time: ColumnOrName,
) -> Column:
    return F.concat(
        F.lit("("), col(product), F.lit(", "), F.coalesce(col(buyer), F.lit("")), F.lit(" << "),
        F.coalesce(col(seller), F.lit("")), F.lit(", "), col(price).cast("string"), F.lit(", "),
        col(quantity).cast("string"), F.lit(", "), col(time).cast("string"), F.lit(")"),
    )
