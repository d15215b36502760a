"""Checks of tables and maps, shares of rows, numbers for display, and timing."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def non_null_map(names: Mapping[str, str | None]) -> dict[str, str]:
    """The entries that have a value."""
    return {k: v for k, v in names.items() if v}


def check_map(names: Mapping[str, str | None], keys: Iterable[str], values: Iterable[str]) -> dict[str, str]:
    """The entries that have a value; keys or values outside the given lists are an error that names them."""
    unknown = sorted(set(names) - set(keys)), sorted(set(non_null_map(names).values()) - set(values))
    if any(unknown):
        raise ValueError(f"unknown keys {unknown[0]}, unknown values {unknown[1]}")
    return non_null_map(names)


def unmapped(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Distinct non-null values of a column that a table doesn't have, for maps that are tables."""
    seen = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return seen.join(known.select(F.col(known_column).alias("value")).distinct(), "value", "left_anti")


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """The frame itself; another number of rows is an error."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df


def share_of_rows(df: DataFrame, condition: Column) -> DataFrame:
    """One row: rows, those that meet the condition (null is no), and their percentage; 0 for an empty table."""
    hit = F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), hit.alias("hits"), F.when(n > 0, 100 * hit / n).otherwise(F.lit(0.0)).alias("percent"))


def show_number(x: Column, decimals: int = 1) -> Column:
    """A number as text with so many decimals, an em dash where it is null or not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.format_string(f"%.{decimals}f", x.cast("double"))).otherwise(F.lit("—"))


def show_percent(x: Column, decimals: int = 1) -> Column:
    """A share as a percentage, an em dash where it is null or not finite."""
    text = show_number(x * 100, decimals)
    return F.when(text == "—", text).otherwise(F.concat(text, F.lit("%")))


class Stopwatch:
    """Time of a with block in seconds, and items a second; readable while the block runs."""

    def __init__(self, what: str = "", report=None) -> None:
        self.what, self.report, self.started, self.ended = what, report, time.perf_counter(), None

    def __enter__(self) -> Stopwatch:
        self.started, self.ended = time.perf_counter(), None
        return self

    def __exit__(self, *_) -> None:
        self.ended = time.perf_counter()
        if self.report:
            self.report(f"{self.what}: {self.seconds * 1000:,.0f} ms")

    @property
    def seconds(self) -> float:
        return (self.ended or time.perf_counter()) - self.started

    def per_second(self, items: int) -> float:
        return items / max(self.seconds, 1e-9)
