"""Calendar columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of x on a circle of the given period."""
    angle = 2 * F.pi() * x / period
    return F.sin(angle), F.cos(angle)


def is_us_holiday(day: Column) -> Column:
    """True on a US federal holiday as observed (a weekend date moves to the nearest workday).

    A pure expression of the date, so no holiday table has to be built, joined or broadcast.
    """
    month, dom, dow = F.month(day), F.dayofmonth(day), F.weekday(day)

    def nth(mon: int, weekday: int, n: int) -> Column:
        return (month == mon) & (dow == weekday) & dom.between(7 * n - 6, 7 * n)

    def fixed(mon: int, d: int, first_year: int = 0) -> Column:
        def hits(c: Column) -> Column:
            return (F.month(c) == mon) & (F.dayofmonth(c) == d) & (F.year(c) >= first_year)
        return ((hits(day) & (dow < 5))
                | (hits(F.date_add(day, 1)) & (dow == 4))
                | (hits(F.date_sub(day, 1)) & (dow == 0)))

    return (fixed(1, 1) | fixed(7, 4) | fixed(11, 11) | fixed(12, 25)
            | fixed(6, 19, 2021)
            | (nth(1, 0, 3) & (F.year(day) >= 1986))
            | nth(2, 0, 3) | nth(9, 0, 1) | nth(10, 0, 2) | nth(11, 3, 4)
            | ((month == 5) & (dow == 0) & (dom >= 25)))
