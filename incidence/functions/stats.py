"""Statistical Column formulas that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Abramowitz-Stegun coefficients (7.1.26) of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """The complementary error function, to about 1.5e-7."""
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4])))) * F.exp(-x * x)
    return F.when(x >= 0, poly).otherwise(2.0 - poly)


def erfc_sql(x: str) -> str:
    """The same in SQL."""
    t = f"(1e0 / (1e0 + {ERF_P}e0 * abs({x})))"
    poly = f"{t} * ({ERF_A[0]}e0 + {t} * ({ERF_A[1]}e0 + {t} * ({ERF_A[2]}e0 + {t} * ({ERF_A[3]}e0 + {t} * {ERF_A[4]}e0)))) * exp(-({x}) * ({x}))"
    return f"case when ({x}) >= 0 then {poly} else 2e0 - {poly} end"


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where nothing is there."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(share(part, whole) * 100.0, digits)
