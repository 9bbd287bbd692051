"""Derived columns: categories out of text, threshold bins, row sums.  All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The title rule and the bins of age and fare.
TITLE_PATTERN = r"(?U),\s*(\w+)\."
TITLES = ("Mr", "Mrs", "Miss", "Master", "Dr")
AGE_BINS = (("<", 13, "Child"), ("<", 18, "Teen"), ("<=", 30, "YoungAdult"), ("<=", 60, "Adult"))
FARE_BINS = (("<", 8, "Budget"), ("<=", 30, "Economy"), ("<=", 100, "Comfort"))


def extract_category(c: Column, pattern: str = TITLE_PATTERN, allowed: Sequence[str] = TITLES, default: str = "Other") -> Column:
    """The first group of the first match if it is allowed, else ``default``; null gives ``default``."""
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found.isin(*allowed), found).otherwise(default)


def bin_column(c: Column, bins: Sequence[tuple], otherwise: str, missing: str | None = None) -> Column:
    """The label of the first bin (operator, bound, label) that holds.  Null and NaN give ``missing``
    where it is set; else they fail every comparison and give ``otherwise``."""
    out = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(missing)) if missing is not None else None
    for op, bound, label in bins:
        holds = (c < bound) if op == "<" else (c <= bound)
        if missing is None:
            holds = holds & ~F.isnan(c.cast("double"))
        out = F.when(holds, F.lit(label)) if out is None else out.when(holds, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def age_group(c: Column) -> Column:
    return bin_column(c, AGE_BINS, "Senior", "Unknown")


def fare_group(c: Column) -> Column:
    return bin_column(c, FARE_BINS, "Luxury")


def family_size(siblings: Column, parents: Column) -> Column:
    return siblings + parents + F.lit(1)


def engineer(df: DataFrame, name: str = "Name", siblings: str = "SibSp", parents: str = "Parch", age: str = "Age", fare: str = "Fare", drop: Sequence[str] = ("Cabin", "Ticket")) -> DataFrame:
    """Title, FamilySize, AgeGroup, FareGroup in this order; then ``drop`` goes where present."""
    out = df.withColumns({"Title": extract_category(F.col(name)), "FamilySize": family_size(F.col(siblings), F.col(parents)), "AgeGroup": age_group(F.col(age)), "FareGroup": fare_group(F.col(fare))})
    return out.drop(*drop)


def share_pct(condition: Column) -> Column:
    """Percent of all rows where the condition holds; an unknown condition does not hold."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int")) * 100


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE rules: over 0 an infinity with both signs, or NaN of 0 / 0, where ANSI division raises."""
    return F.when(b == 0, a * F.when(b.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(a / b)


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB does, by its multiple; F.round takes its decimal text, which differs where that ends in 5."""
    return F.round(c * 10.0**digits) / 10.0**digits
