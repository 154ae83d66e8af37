"""Schema normalisation and row-wise features: projections only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import clean_string, parse_number, safe_name

#: Grades and their order.
GRADES = {"POOR": 1, "PO": 1, "FAIR": 2, "FA": 2, "AVERAGE": 3, "AV": 3, "GOOD": 4, "GD": 4, "EXCELLENT": 5, "EX": 5}


def normalize_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename aliases (any case) to canonical names; where several are there the first non-null counts."""
    by = {a.lower(): c for a, c in aliases.items()}
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(by.get(c.lower(), c), []).append(c)
    pick = lambda name, own: F.coalesce(*[F.col(f"`{c}`") for c in sorted(own, key=lambda c: c != name)]) if len(own) > 1 else F.col(f"`{own[0]}`")
    return df.select(*[pick(name, own).alias(name) for name, own in groups.items()])


def clean_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: clean_string(F.col(c)) for c in cols})


def derive_car(df: DataFrame, total: str, garage: str, offstreet: str, how: str = "greatest", out: str = "car") -> DataFrame:
    """greatest: the larger of the total and the sum of parts, null only if all are; sum: parts, null as 0."""
    parts = F.coalesce(F.col(garage), F.lit(0)) + F.coalesce(F.col(offstreet), F.lit(0))
    known = F.when(F.col(garage).isNotNull() | F.col(offstreet).isNotNull(), parts)
    return df.withColumn(out, F.greatest(F.col(total), known) if how == "greatest" else F.coalesce(F.col(total), parts))


def fill_defaults(df: DataFrame, cols: list[str], value: float = 0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def map_ordinals(df: DataFrame, cols: list[str], grades: dict[str, int] | None = None) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in (grades or GRADES).items() for x in kv])
    return df.withColumns({c: F.try_element_at(known, F.upper(F.trim(F.col(c)))) for c in cols})


def date_parts(date: Column) -> dict[str, Column]:
    angle = F.month(date) * F.lit(2 * 3.141592653589793 / 12)
    return {"year": F.year(date), "month": F.month(date), "week_of_year": F.weekofyear(date), "day_of_week": F.weekday(date), "month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def add_date_parts(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns(date_parts(F.col(date)))


def add_time_index(df: DataFrame, date: str, train: Column, days: int = 30, out: str = "time_index") -> DataFrame:
    """Whole periods since the earliest train date; null dates give 0."""
    first = df.where(train).agg(F.min(date).alias("_first"))
    index = F.floor(F.datediff(F.col(date), F.col("_first")) / days)
    return df.join(F.broadcast(first)).withColumn(out, F.coalesce(index, F.lit(0)).cast("int")).drop("_first")


def add_log_features(df: DataFrame, cols: list[str], zero_flags: bool = False) -> DataFrame:
    logs = {f"log_{c}": F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))) for c in cols}
    flags = {f"{c}_is_zero": F.coalesce((F.col(c) == 0).cast("int"), F.lit(0)) for c in cols} if zero_flags else {}
    return df.withColumns(logs | flags)


def skewed_columns(df: DataFrame, cols: list[str], threshold: float = 2.0) -> list[str]:
    """Columns whose population skewness is beyond the threshold; one pass."""
    row = df.agg(*[F.skewness(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and abs(row[c]) > threshold]


def add_skew_logs(df: DataFrame, cols: list[str], threshold: float = 2.0) -> DataFrame:
    return add_log_features(df, skewed_columns(df, cols, threshold))


def add_ratio_features(df: DataFrame, year: int, floor: str, land: str, bed: str, bath: str, car: str, built: str) -> DataFrame:
    """Age, shares and flags; division by zero or null gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.when(F.col(b) > 0, F.col(b).cast("double"))), F.lit(0.0))
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    return df.withColumns({
        "age_years": F.when(F.col(built).isNotNull(), F.greatest(F.lit(0), F.lit(year) - F.col(built))),
        "is_newer_2010": flag(F.col(built) >= 2010),
        "floor_land_ratio": ratio(floor, land),
        "bed_bath_ratio": ratio(bed, bath),
        "has_car": flag(F.col(car) >= 1), "has_car_2": flag(F.col(car) >= 2), "has_car_3": flag(F.col(car) >= 3),
    })


def add_unit_price(df: DataFrame, price: str, floor: str, out: str = "unit_price") -> DataFrame:
    return df.where(F.col(floor) > 0).withColumn(out, F.col(price) / F.col(floor))


def add_gross_yield(df: DataFrame, price: str, capital: str, out: str = "gross_yield") -> DataFrame:
    return df.where(F.col(capital) > 0).withColumn(out, F.col(price) * 52 / F.col(capital))


def apply_feature_policy(df: DataFrame, keep_logs: list[str], drop: list[str] = (), max_km: float = 50.0) -> DataFrame:
    """Logs that aren't listed go, so does the raw twin of a kept log; distances are capped."""
    def stays(c: str) -> bool:
        if c in drop or (c.startswith("log_") and c not in keep_logs):
            return False
        return f"log_{c}" not in keep_logs or f"log_{c}" not in df.columns

    cap = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(max_km))).alias(c) if c.startswith("dist_") and c.endswith("_km") else F.col(f"`{c}`")
    return df.select(*[cap(c) for c in df.columns if stays(c)])


def drop_leaky_columns(df: DataFrame, target: str, leaks: list[str] = ()) -> DataFrame:
    """Columns that are named as leaks or hold the target's name go, the target itself stays."""
    bad = [c for c in df.columns if c != target and (c in leaks or target.lower() in c.lower())]
    return df.drop(*bad)


def interactions(df: DataFrame, pairs: list[tuple[str, str]], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Products: number x number, or number x 0/1 column for each listed level of the second column."""
    out = {}
    for a, b in pairs:
        if levels and b in levels:
            for v in levels[b]:
                out[f"{safe_name(a)}_x_{safe_name(b)}_{safe_name(v)}"] = F.when(F.col(b) == v, F.col(a)).otherwise(0.0)
        else:
            out[f"{safe_name(a)}_x_{safe_name(b)}"] = F.col(a) * F.col(b)
    return df.withColumns(out)


def parse_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: parse_number(F.col(c)) for c in cols})
