"""Numeric scalar functions (C1, C4, C10-C12) on exact decimals.

The reference keeps numbers as text; here they are DECIMAL columns and
NULL means unknown.  Rounding is half-even on the exact decimal value
(``bround``), which equals the reference's float formatting except at
ties a binary double cannot hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col

PRICE_TYPE = "decimal(18,4)"
SIZE_TYPE = "decimal(18,4)"
PRICE_PER_M2_TYPE = "decimal(18,1)"
AMOUNT_TYPE = "decimal(18,2)"


def parse_euro_amount(text: Column | str) -> Column:
    """First Belgian-format number, 2 decimals half-even; NULL if none.

    "1.250" -> 1250, "650,50" -> 650.5, "599.50" -> 599 (the dot is not a
    decimal mark here), "1 250" -> 1.  A no-break space would become a
    space first, which cannot change the match, so that step is folded.
    """
    raw = F.regexp_extract(col(text), K.AMOUNT_PATTERN, 0)
    plain = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    exact = F.nullif(plain, F.lit("")).try_cast("decimal(38,6)")
    return F.bround(exact, 2).try_cast(AMOUNT_TYPE)


def price_per_m2(price: Column | str, size: Column | str) -> Column:
    """C4: price / size to one decimal when both are known and > 0."""
    p, s = col(price).try_cast(PRICE_TYPE), col(size).try_cast(SIZE_TYPE)
    return F.when((p > 0) & (s > 0), F.bround(p / s, 1).try_cast(PRICE_PER_M2_TYPE))


def first_truthy(*cols: Column | str, falsy=0) -> Column:
    """C11: Python's ``a or b or c`` -- falsy values fall through, the last
    value is returned as it is (even when falsy)."""
    cs = [col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(falsy)) for c in cs[:-1]], cs[-1])


def trunc_int(c: Column | str) -> Column:
    """``int(float(x))`` -- truncate toward zero; NULL when not numeric."""
    return col(c).try_cast("double").try_cast("bigint")


def range_from(rng: Column | str) -> Column:
    """The ``from`` value of a ``{from, to}`` range as a number."""
    return col(rng).getField("from").try_cast(PRICE_TYPE)
