"""Weather physics as Column functions (degrees Fahrenheit). A null input gives null."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def cooling(temp: Column, base: float = 65.0) -> Column:
    """Cooling degree hours."""
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), temp - base))


def heating(temp: Column, base: float = 65.0) -> Column:
    """Heating degree hours."""
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), base - temp))


def heat_index(temp: Column, rh: Column) -> Column:
    """US weather service heat index: the simple form, Rothfusz' polynomial from 80 F on."""
    mild = (temp + 61.0 + (temp - 68.0) * 1.2 + rh * 0.094) * 0.5
    # Rothfusz regression, coefficient of T^i * RH^j.
    rothfusz = [
        (-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1),
        (-0.22475541, 1, 1), (-6.83783e-3, 2, 0), (-5.481717e-2, 0, 2),
        (1.22874e-3, 2, 1), (8.5282e-4, 1, 2), (-1.99e-6, 2, 2),
    ]
    hot = F.lit(0.0)
    for k, i, j in rothfusz:
        term = F.lit(k)
        for factor in [temp] * i + [rh] * j:
            term = term * factor
        hot = hot + term
    return F.when((mild + temp) / 2.0 >= 80.0, hot).otherwise(mild)


def wet_bulb(temp: Column, rh: Column) -> Column:
    """Stull (2011) wet-bulb temperature; humidity is limited to [0.001, 100] percent."""
    c = (temp - 32.0) * 5.0 / 9.0
    h = F.when(rh.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(1e-3), rh)))
    wet = (c * F.atan(0.151977 * F.sqrt(h + 8.313659)) + F.atan(c + h) - F.atan(h - 1.676331)
           + 0.00391838 * F.pow(h, F.lit(1.5)) * F.atan(0.023101 * h) - 4.686035)
    return wet * 9.0 / 5.0 + 32.0
