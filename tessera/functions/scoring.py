"""Debt, grades and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import half_up

# The scale of grades and the assumed cost of a line.
MINUTES_PER_LINE = 30
GRADES = (("A", 0.05), ("B", 0.1), ("C", 0.2), ("D", 0.5))
GRADE_ORDER = "ABCDE"


def debt_ratio(debt: Column, sloc: Column) -> Column:
    """Debt over the cost of writing the lines; 0 where there are none."""
    return F.when(sloc > 0, debt / (sloc * MINUTES_PER_LINE)).otherwise(F.lit(0.0))


def grade_of(ratio: Column) -> Column:
    out = F.lit("E")
    for grade, most in reversed(GRADES):
        out = F.when(ratio <= most, grade).otherwise(out)
    return out


def score_columns(debt: Column, sloc: Column) -> dict[str, Column]:
    """debt_ratio to four places; score and grade from the exact ratio."""
    ratio = debt_ratio(debt, sloc)
    return {
        "debt_ratio": F.floor(ratio * 10000 + 0.5) / 10000,
        "score": half_up(F.greatest(F.lit(0.0), 1 - ratio / 0.5) * 100).cast("int"),
        "grade": grade_of(ratio),
    }


def format_debt(minutes: Column) -> Column:
    """45 min, 3 h 20 min, 2 d 1 h; a day has eight hours."""
    hours, rest = F.floor(minutes / 60), minutes % 60
    days, left = F.floor(hours / 8), hours % 8
    text = lambda x: x.cast("long").cast("string")
    return (
        F.when(minutes < 60, F.concat(text(minutes), F.lit(" min")))
        .when(hours < 8, F.concat(text(hours), F.lit(" h"), F.when(rest > 0, F.concat(F.lit(" "), text(rest), F.lit(" min"))).otherwise("")))
        .otherwise(F.concat(text(days), F.lit(" d"), F.when(left > 0, F.concat(F.lit(" "), text(left), F.lit(" h"))).otherwise("")))
    )


def maintainability_index(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    raw = (171 - 5.2 * F.ln(volume) - 0.23 * cyclomatic - 16.2 * F.ln(sloc)) * 100 / 171
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
