"""Number rules shared by all operators: what pandas calls NaN or inf is NULL here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = 1e-12  # of a difference of values near 1 that come from sums
FILLER = 1e-7  # stands in for missing values once a stage is done


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NULL instead of NaN and the infinities (NaN sorts above infinity in Spark)."""
    x = _c(x)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def sanitize(x: Column | str) -> Column:
    return F.coalesce(finite(x), F.lit(FILLER))


def div(x: Column | str, y: Column | str) -> Column:
    return finite(F.try_divide(_c(x), _c(y)))


def ln(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x >= 0, F.sqrt(x))


def signif(x: Column | str) -> Column:
    """Seven significant digits, for comparison with engines whose sums differ in the last bits.

    Prices have few decimals, so exact ties occur; rounding to twelve digits first takes the noise
    off them, and then all of them round away from zero. A change x / y - 1 of values that are equal
    but for their last bits is noise below 1e-12, and shown as 0; no operator rounds.
    """
    x = _c(x)
    clean = F.when(F.abs(x) < NOISE, 0.0).otherwise(F.format_string("%.11e", x).cast("double"))
    return F.when(x.isNotNull(), F.format_string("%.6e", clean).cast("double"))
