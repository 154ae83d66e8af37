"""Row filters and the audit of removed rows. A missing value passes a domain check."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import all_of

from .quantiles import medians, quantiles
from .storage import cut


def domain_test(bounds: dict[str, tuple[float | None, float | None]], non_positive_missing: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> Column:
    """True where the values are missing or in bounds. For non_positive_missing columns values <= 0 count
    as missing; for positive ones a present value <= 0 fails."""
    tests = []
    for c, (low, high) in bounds.items():
        x = F.when(F.col(c) > 0, F.col(c)) if c in non_positive_missing else F.col(c)
        inside = all_of([t for t in (x >= low if low is not None else None, x <= high if high is not None else None) if t is not None])
        tests.append(F.coalesce(inside, F.lit(True)))
    return all_of(tests + [F.coalesce(F.col(c) > 0, F.lit(True)) for c in positive])


def domain_filter(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], non_positive_missing: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass domain_test."""
    return df.where(domain_test(bounds, non_positive_missing, positive))


def valid_test(required: list[str], most: dict[str, float] | None = None) -> Column:
    return all_of([F.col(c).isNotNull() for c in required] + [F.coalesce(F.col(c) <= x, F.lit(True)) for c, x in (most or {}).items()])


def drop_invalid(df: DataFrame, required: list[str], most: dict[str, float] | None = None) -> DataFrame:
    return df.where(valid_test(required, most))


def date_window(df: DataFrame, date: str, since: dt.date | None = None, recent_years: int | None = None, as_of: dt.date | None = None) -> DataFrame:
    """Rows from `since` on, or of the last recent_years before as_of; as_of is given, never today."""
    if recent_years is not None:
        since_c = F.add_months(F.lit(as_of), -12 * recent_years)
    else:
        since_c = F.lit(since)
    return df.where(F.col(date) >= since_c)


def target_range(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(target).between(low, high))


def audit_removed(before: DataFrame, after: DataFrame, key: str, step: str) -> DataFrame:
    """Rows of before whose key is gone after the step."""
    return before.join(after.select(key), key, "left_anti").withColumn("removed_step", F.lit(step))


def audit_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) in one pass: each row is tagged with the first step whose test it fails, no join."""
    tag = F.coalesce(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in steps])
    tagged = df.withColumn("removed_step", tag)
    return tagged.where("removed_step is null").drop("removed_step"), tagged.where("removed_step is not null")


#: A step of audit_filters: from the rows and the mark of those still there to (rows with what the test needs, test).
Step = Callable[[DataFrame, Column], tuple[DataFrame, Column]]


def by_test(test: Column) -> Step:
    """A step that needs only the row: domain_test, valid_test or any condition."""
    return lambda df, there: (df, test)


def by_mean(col: str, k: float = 9) -> Step:
    """mean_multiple_filter as a step; the mean is that of the rows still there."""

    def step(df: DataFrame, there: Column) -> tuple[DataFrame, Column]:
        return df.join(F.broadcast(df.agg(F.avg(F.when(there, F.col(col))).alias("_mean")))), F.col(col) <= k * F.col("_mean")

    return step


def by_group_median(col: str, by: list[str], k: float = 5) -> Step:
    """group_median_filter as a step; a row with a null in `by` fails."""

    def step(df: DataFrame, there: Column) -> tuple[DataFrame, Column]:
        return df.join(medians(df, by, {"_median": F.when(there, F.col(col))}), by, "left"), F.col(col) <= k * F.col("_median")

    return step


def by_qualified_group(by: str, col: str, min_n: int = 3, frac: float = 0.5) -> Step:
    """qualify_groups as a step; counts and medians are those of the rows still there."""

    def step(df: DataFrame, there: Column) -> tuple[DataFrame, Column]:
        value = F.when(there, F.col(col))
        groups = quantiles(df, [by], {"_median": (value, 0.5)}, {"_n": F.count(F.when(there, 1))})
        got = df.join(groups, by, "left").join(F.broadcast(medians(df, [], {"_all": value})))
        return got, (F.col("_n") > min_n) & (F.col("_median") >= frac * F.col("_all"))

    return step


#: Steps that fit the bits of one mask.
MOST_STEPS = 63


def audit_filters(df: DataFrame, steps: list[tuple[str, Step]]) -> DataFrame:
    """All rows of df, with failed_steps (bit i set where the row fails step i; a null test fails) and removed_step,
    the first step that it fails, null for a row that all steps keep. The rows that a filter chain would leave after
    each step are those without a bit before it, so a step's statistics are the chain's. No key is needed and no step
    joins rows with rows: tests are columns, statistics are one row for each group. Unlike audit_steps it takes every
    filter here."""
    if len(steps) > MOST_STEPS:
        raise ValueError(f"at most {MOST_STEPS} steps")
    zero = F.lit(0).cast("long")
    df = cut(df)  # each step's statistics read it again
    work = df.withColumn("failed_steps", zero)
    for i, (_, step) in enumerate(steps):
        work, test = step(work, F.col("failed_steps") == 0)
        failed = F.when(F.coalesce(test, F.lit(False)), zero).otherwise(F.lit(1 << i).cast("long"))
        work = work.withColumn("failed_steps", F.col("failed_steps").bitwiseOR(failed)).select(*[F.col(f"`{c}`") for c in df.columns], "failed_steps")
    first = [F.when(F.col("failed_steps").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, (name, _) in enumerate(steps)]
    return work.withColumn("removed_step", F.coalesce(*first) if first else F.lit(None).cast("string"))


def mean_multiple_filter(df: DataFrame, col: str, k: float = 9) -> DataFrame:
    """Rows whose value is at most k times the overall mean."""
    mean = df.agg(F.avg(col).alias("_mean"))
    return df.join(F.broadcast(mean), F.col(col) <= k * F.col("_mean")).drop("_mean")


def group_median_filter(df: DataFrame, col: str, by: list[str], k: float = 5) -> DataFrame:
    """Rows whose value is at most k times their group's median (grouped first, then joined)."""
    m = medians(df, by, {"_median": F.col(col)})
    return df.join(m, by).where(F.col(col) <= k * F.col("_median")).drop("_median")


def qualify_groups(df: DataFrame, by: str, col: str, min_n: int = 3, frac: float = 0.5) -> DataFrame:
    """Rows of groups with more than min_n rows and a median of at least frac of the global one."""
    total = medians(df, [], {"_all": F.col(col)})
    good = quantiles(df, [by], {"_median": (F.col(col), 0.5)}, {"_n": F.count("*")}).join(F.broadcast(total), F.col("_median") >= frac * F.col("_all"))
    return df.join(good.where(F.col("_n") > min_n).select(by), by, "left_semi")


def dedup_latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each group, the last in the given order: a grouped maximum, so no group is gathered."""
    rest = [c for c in df.columns if c not in by]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c in by else F.col(f"_last.{c}") for c in df.columns])
