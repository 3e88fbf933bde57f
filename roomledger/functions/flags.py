"""Three-valued feature flags.

A flag is a nullable BOOLEAN: True = yes, False = no, NULL = unknown.
Only structured sources produce False; keyword scans give True or NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col


def yes_no_text(flag: Column | str) -> Column:
    """True/False/NULL -> 'Yes'/'No'/NULL, for presentation only."""
    c = col(flag)
    return F.when(c, F.lit("Yes")).when(~c, F.lit("No"))


def cost_covered(code: Column | str, covered: Sequence[int] = K.COST_COVERED) -> Column:
    """NULL stays unknown, a covered code is yes, any other code no."""
    return col(code).isin(*covered)


def all_costs_covered(*codes: Column | str, covered: Sequence[int] = K.COST_COVERED) -> Column:
    """Over the known codes, all covered -> yes, else no; none known -> NULL."""
    known = F.filter(F.array(*[col(c).cast("int") for c in codes]), lambda x: x.isNotNull())
    allowed = F.array(*[F.lit(v) for v in covered])
    return F.when(F.size(known) > 0, F.forall(known, lambda x: F.array_contains(allowed, x)))


def options_contain(options: Column | str, code: int) -> Column:
    """``code in set(options or [])``; a NULL list is empty, so False."""
    return F.coalesce(F.array_contains(col(options), F.lit(code)), F.lit(False))


def facility_flag(options: Column | str, code: int, item_flag: Column | str | None = None) -> Column:
    """Option present, or the search item's own boolean -> yes, else no."""
    flag = options_contain(options, code)
    if item_flag is not None:
        flag = flag | F.coalesce(col(item_flag).cast("boolean"), F.lit(False))
    return flag


def internet_flag(cost_code: Column | str, options: Column | str,
                  net_codes: Sequence[int] = (K.OPT_INTERNET_WIFI, K.OPT_INTERNET_CABLE)) -> Column:
    """The cost code decides when present, else yes if a net option exists."""
    opts = F.coalesce(col(options), F.array().cast("array<int>"))
    has_net = F.arrays_overlap(opts, F.array(*[F.lit(c) for c in net_codes]))
    return F.when(col(cost_code).isNotNull(), cost_covered(cost_code)).when(F.coalesce(has_net, F.lit(False)), F.lit(True))


def count_positive(count: Column | str) -> Column:
    """Count > 0; NULL stays unknown."""
    return col(count) > 0


def furnished_coalesce(furnished: Column | str, is_furnished: Column | str) -> Column:
    """C14: ``furnished`` unless it is NULL, then ``isFurnished``; False does not fall through."""
    return F.coalesce(col(furnished).cast("boolean"), col(is_furnished).cast("boolean"))


def bath_flag(bathroom_count: Column | str, shower_count: Column | str) -> Column:
    """First truthy of the two counts; NULL unknown, > 0 yes, 0 no."""
    n = F.coalesce(F.nullif(col(bathroom_count), F.lit(0)), col(shower_count))
    return n.try_cast("bigint") > 0


def kitchen_flag(kitchen_type: Column | str) -> Column:
    """A non-empty kitchen type -> yes, else unknown."""
    return F.when(F.coalesce(col(kitchen_type), F.lit("")) != "", F.lit(True))
