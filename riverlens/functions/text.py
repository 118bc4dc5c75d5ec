"""Number-to-text helpers that format like Python's ``f'{x:.Nf}'``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column | str, decimals: int = 2) -> Column:
    """Fixed-point text. ``format_number`` rounds the exact binary value half-even,
    which is how Python and C printf behave (``format_string`` rounds the
    shortest decimal half-up and disagrees on ties such as 0.015)."""
    col = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.format_number(col, decimals), ",", "")


def p_value_text(p: Column | str) -> Column:
    """Scientific below 1e-4, 5 decimals below 1e-3, else 4 decimals."""
    col = F.col(p) if isinstance(p, str) else p
    return (F.when(col.isNull(), F.lit(None))
             .when(col < 1e-4, F.format_string("%.2e", col))
             .when(col < 1e-3, fixed(col, 5))
             .otherwise(fixed(col, 4)))


def stars(p: Column | str) -> Column:
    """Significance stars at .001 / .01 / .05, else 'ns'."""
    col = F.col(p) if isinstance(p, str) else p
    return (F.when(col < 0.001, "***").when(col < 0.01, "**")
             .when(col < 0.05, "*").otherwise("ns"))


def display_round(x: Column | str, decimals: int) -> Column:
    """Python ``round(x, n)`` on a float: nearest multiple, ties to even on the exact binary value."""
    return fixed(x, decimals).cast("double")
