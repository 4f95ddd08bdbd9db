"""Calendar Column expressions: campaign attribution (C1), seasonal index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiscope.functions.fixed import MONTH_FACTORS, WEEKEND_FACTOR
from kpiscope.functions.numeric import col_


def campaign_of(d) -> Column:
    d = col_(d)
    m, day = F.month(d), F.dayofmonth(d)
    return (F.when(m.isin(3, 4), "spring_sale")
            .when(m.isin(6, 7), "summer_blast")
            .when(m == 8, "back_to_school")
            .when(m.isin(9, 10), "fall_promo")
            .when((m == 11) & (day >= 20), "black_friday")
            .when(m == 12, "holiday_special")
            .otherwise("none"))


def iso_weekday(d) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(col_(d)) + 1


def seasonal_index(d) -> Column:
    d = col_(d)
    month_factor = F.element_at(
        F.create_map(*[x for k, v in MONTH_FACTORS.items() for x in (F.lit(k), F.lit(v))]),
        F.month(d))
    return F.when(iso_weekday(d) >= 6, month_factor * F.lit(WEEKEND_FACTOR)).otherwise(month_factor)


def inclusive_days(start, end) -> Column:
    return F.datediff(col_(end), col_(start)) + 1
