"""Rounding rules that differ from Spark's ``round`` and ``format_string``.

Spark rounds the shortest decimal form of a double half up. The rules here look at the
double's exact value (ties to even), and at its scaled value respectively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(magnitude: Column, digits: int) -> Column:
    """Exact nearest count of 10**-digits units in a non-negative double."""
    scale = 10 ** digits
    whole = F.floor(magnitude)
    part = magnitude - whole
    # Ten leading bits of the fraction scale without error; the rest only tips the balance.
    lead = F.floor(part * F.lit(1024.0)) / F.lit(1024.0)
    base = F.floor(part * F.lit(float(scale)))
    excess = (lead * F.lit(float(scale)) - base - F.lit(0.5)) + (part - lead) * F.lit(float(scale))
    up = (excess > 0) | ((excess == 0) & (base % 2 == 1))
    return whole * F.lit(scale) + base + up.cast("bigint")


def fixed_text(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, exact value rounded, ties to even."""
    scale = F.lit(10 ** digits)
    units = _units(F.abs(value), digits)
    sign = F.when(value < 0, "-").otherwise("")
    decimals = F.lpad((units % scale).cast("string"), digits, "0")
    return F.concat(sign, F.floor(units / scale).cast("string"), F.lit("."), decimals)


def round_exact(value: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits to the exact value, ties to even."""
    return F.signum(value) * _units(F.abs(value), digits) / F.lit(float(10 ** digits))


def round_scaled(value: Column, digits: int) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale
