"""Time-blocked splits and folds with embargo and group purging. Folds are long tables (fold, key, role),
or masks on the rows, one bit a fold, which a single shuffle by group purges."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import month_label


def _months(df: DataFrame, date: str) -> list[int]:
    """Distinct month labels, a few hundred at most."""
    rows = df.where(F.col(date).isNotNull()).select(month_label(F.col(date)).alias("m")).distinct().collect()
    return sorted(r["m"] for r in rows)


def split_by_months(df: DataFrame, date: str, test_m: int = 3, early_m: int = 2, gap_m: int = 1, out: str = "split") -> DataFrame:
    """The last test_m months present are test, those before early, then a gap (embargo), the rest train.

    With too few months 2 are test, 1 early and there is no gap. Null dates are train.
    """
    months = _months(df, date)
    if len(months) < test_m + early_m + gap_m + 1:
        test_m, early_m, gap_m = 2, 1, 0
    cut = lambda n: months[-n] if 0 < n <= len(months) else (months[0] if months and n > 0 else 10**9)
    m = month_label(F.col(date))
    role = F.when(m >= cut(test_m), "test").when(m >= cut(test_m + early_m), "early")
    if gap_m:
        role = role.when(m >= cut(test_m + early_m + gap_m), "embargo")
    return df.withColumn(out, role.otherwise("train"))


def split_by_fraction(df: DataFrame, date: str, key: str, train: float = 0.7, early: float = 0.1, out: str = "split") -> DataFrame:
    """Chronological cut at row fractions. Rows are ranked by counts of earlier days and by key inside a
    day, so no task ranks the whole table."""
    day = F.col(date).cast("date")
    daily = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = daily.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = daily.agg(F.sum("_n").alias("_total"))
    work = df.withColumn("_day", day).withColumn("_in", F.row_number().over(Window.partitionBy("_day").orderBy(key)))
    work = work.join(before.select(F.col("_day").alias("_d"), "_before"), F.col("_day").eqNullSafe(F.col("_d"))).join(F.broadcast(total))
    place = F.col("_before") + F.col("_in") - 1
    first = lambda share: F.floor(F.lit(Decimal(repr(round(share, 9)))) * F.col("_total"))  # noqa: E731  0.7 + 0.1 isn't 0.8 in binary
    role = F.when(place < first(train), "train").when(place < first(train + early), "early").otherwise("test")
    return work.withColumn(out, role).drop("_day", "_in", "_d", "_before", "_total")


def _join_groups(df: DataFrame, group: str, flags: DataFrame) -> DataFrame:
    """df with the columns of flags, one row for each group in _g; a null group has none. A hot group is one row of flags."""
    return df.join(flags, F.col(group) == F.col("_g"), "left").drop("_g")


def block_split_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Train rows whose group is in early or test go, and early rows whose group is in test; null groups block
    nothing, rows without a split stay. One aggregate tells the roles of a group as bits, one join brings them to the rows."""
    bit = F.when(F.col(split) == "early", 1).when(F.col(split) == "test", 2).otherwise(0)
    roles = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.bit_or(bit).alias("_roles")).where("_roles > 0")
    blocked = F.when(F.col(split) == "train", F.col("_roles") > 0).when(F.col(split) == "early", F.col("_roles") >= 2)
    return _join_groups(df, group, roles).where(~F.coalesce(blocked, F.lit(False))).drop("_roles")


def _fold_table(df: DataFrame, date: str, key: str, specs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(fold, key, role) from specs (fold, train from, train to, val from, val to) in month labels."""
    spec = df.sparkSession.createDataFrame(specs, "fold int, t0 int, t1 int, v0 int, v1 int") if specs else df.sparkSession.range(0).selectExpr("cast(id as int) fold", "cast(id as int) t0", "cast(id as int) t1", "cast(id as int) v0", "cast(id as int) v1")
    rows = df.where(F.col(date).isNotNull()).select(F.col(key), month_label(F.col(date)).alias("_m"))
    is_train, is_val = F.col("_m").between(F.col("t0"), F.col("t1")), F.col("_m").between(F.col("v0"), F.col("v1"))
    joined = rows.join(F.broadcast(spec), is_train | is_val)  # at most 12 specs
    return joined.select("fold", key, F.when(is_val, "val").otherwise("train").alias("role"))


#: Folds that fit the bits of one mask.
MOST_FOLDS = 63


def walk_forward_specs(df: DataFrame, date: str, val_blocks: int = 5, gap_months: int = 1, last: int = 12) -> list[tuple[int, int, int, int, int]]:
    """(fold, train from, train to, validation from, validation to) in month labels: expanding train months and
    a validation window of a fifth of the months, moving forward."""
    months = _months(df, date)
    width = max(1, len(months) // val_blocks)
    specs, at = [], width
    while at + width <= len(months):
        end = at - gap_months
        if end > 0:
            specs.append((months[0], months[end - 1], months[at], months[at + width - 1]))
        at += width
    return [(i, *s) for i, s in enumerate(specs[-last:])]


def walk_forward_folds(df: DataFrame, date: str, key: str, val_blocks: int = 5, gap_months: int = 1, last: int = 12) -> DataFrame:
    """The folds of walk_forward_specs as a long table."""
    return _fold_table(df, date, key, walk_forward_specs(df, date, val_blocks, gap_months, last))


def monte_carlo_folds(df: DataFrame, date: str, key: str, folds: int = 12, seed: int = 7, width: int = 2, gap_months: int = 1) -> DataFrame:
    """Random month blocks as validation, train before them, sorted by first validation month."""
    months, rng = _months(df, date), random.Random(seed)
    places = [i for i in range(gap_months + 1, len(months) - width + 1)]
    chosen = sorted(rng.sample(places, min(folds, len(places))))
    return _fold_table(df, date, key, [(n, months[0], months[i - gap_months - 1], months[i], months[i + width - 1]) for n, i in enumerate(chosen)])


def _bit(fold: int) -> Column:
    return F.lit(1 << fold).cast("long")


def _mask(tests: list[tuple[int, Column]]) -> Column:
    out = F.lit(0).cast("long")
    for fold, test in tests:
        out = out.bitwiseOR(F.when(test, _bit(fold)).otherwise(F.lit(0).cast("long")))
    return out


def fold_masks(df: DataFrame, date: str, specs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """df with train_folds and val_folds: bit n is set if the row is in fold n by its month. No join and no
    shuffle; a null date is in no fold."""
    if any(not 0 <= s[0] < MOST_FOLDS for s in specs):
        raise ValueError(f"folds have to be 0 to {MOST_FOLDS - 1}")
    m = month_label(F.col(date))
    val = [(n, m.between(v0, v1)) for n, _, _, v0, v1 in specs]
    train = [(n, m.between(t0, t1) & ~m.between(v0, v1)) for n, t0, t1, v0, v1 in specs]
    return df.withColumns({"train_folds": _mask(train), "val_folds": _mask(val)})


def purge_masks(masked: DataFrame, group: str) -> DataFrame:
    """masked without the train bits of folds that validate on the row's group: one aggregate by group, combined
    before it is shuffled, and one join. Null groups are purged of nothing."""
    held = masked.where(F.col(group).isNotNull() & (F.col("val_folds") != 0)).groupBy(F.col(group).alias("_g")).agg(F.bit_or("val_folds").alias("_held"))
    free = F.col("train_folds").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("long"))))
    return _join_groups(masked, group, held).withColumn("train_folds", free).drop("_held")


def mask_roles(masked: DataFrame, key: str, folds: list[int]) -> DataFrame:
    """The long table (fold, key, role) of masks; rows in no fold have none."""
    has = lambda c, n: F.col(c).bitwiseAND(_bit(n)) != 0
    of = [F.when(has("val_folds", n), F.struct(F.lit(n).alias("fold"), F.lit("val").alias("role"))).when(has("train_folds", n), F.struct(F.lit(n).alias("fold"), F.lit("train").alias("role"))) for n in folds]
    none = F.array().cast("array<struct<fold:int,role:string>>")
    each = masked.select(key, F.explode(F.array_compact(F.array(*of)) if of else none).alias("_r"))
    return each.select("_r.fold", key, "_r.role")


def check_masks(masked: DataFrame, date: str, group: str, folds: list[int], min_val: int = 1) -> DataFrame:
    """check_folds from masks: both masks of each month and each group are united by one aggregate, in which a
    group or a month is one row; folds without rows are left out."""
    zero = F.lit(0).cast("long")
    n = [F.struct(*[F.sum(F.when(F.col(f"{r}_folds").bitwiseAND(_bit(f)) != 0, 1).otherwise(0)).alias(r) for r in ("train", "val")]).alias(f"n{f}") for f in folds]
    keyed = masked.where((F.col("train_folds") != 0) | (F.col("val_folds") != 0)).select(month_label(F.col(date)).alias("_m"), F.col(group).alias("_g"), "train_folds", "val_folds")
    sets = keyed.groupingSets([["_m"], ["_g"]], "_m", "_g").agg(F.grouping("_m").alias("_of_group"), F.bit_or("train_folds").bitwiseAND(F.bit_or("val_folds")).alias("_both"), *n)
    one = lambda f: F.coalesce(F.col("_both"), zero).bitwiseAND(_bit(f)) != 0
    total = [F.struct(F.lit(f).alias("fold"), *[F.sum(F.when(F.col("_of_group") == 0, F.col(f"n{f}.{r}"))).alias(f"n_{r}") for r in ("train", "val")],
                      F.count(F.when((F.col("_of_group") == 0) & one(f), 1)).alias("shared_months"), F.count(F.when((F.col("_of_group") == 1) & one(f), 1)).alias("shared_groups")) for f in folds]
    none = F.array().cast("array<struct<fold:int,n_train:bigint,n_val:bigint,shared_months:bigint,shared_groups:bigint>>")
    out = sets.agg((F.array(*total) if folds else none).alias("_all")).select(F.explode("_all").alias("_f")).select("_f.*").where("n_train + n_val > 0")
    return out.withColumn("ok", (F.col("shared_months") == 0) & (F.col("shared_groups") == 0) & (F.col("n_val") >= min_val))


def shuffled_kfold(df: DataFrame, key: str, n: int = 5, seed: int = 7, out: str = "fold") -> DataFrame:
    """Fold by two rounds of a mixing hash of an integer key: the same at every run and partitioning, and
    unlike the key's residues."""
    first = F.pmod(F.pmod(F.col(key), F.lit(2_147_483_647)) * 48_271 + seed, F.lit(2_147_483_647))
    second = F.pmod(first * 69_621 + F.floor(first / 127_773), F.lit(2_147_483_647))
    return df.withColumn(out, F.pmod(F.floor(second / 1_009), F.lit(n)).cast("int"))


def auto_gap_days(windows: list[int], buffer: int = 7) -> int:
    """The embargo for features over windows of so many days: the longest one and a buffer."""
    return max([0, *windows]) + buffer


def embargo_days(folds: DataFrame, df: DataFrame, date: str, key: str, gap: int | None = None, windows: list[int] = ()) -> DataFrame:
    """Train rows later than the fold's first validation day minus gap go; by default auto_gap_days(windows)."""
    gap = auto_gap_days(list(windows)) if gap is None else gap
    dated = folds.join(df.select(key, F.col(date).cast("date").alias("_d")), key)
    first = dated.where("role = 'val'").groupBy("fold").agg(F.min("_d").alias("_first"))
    return dated.join(F.broadcast(first), "fold").where((F.col("role") == "val") | (F.col("_d") < F.date_sub("_first", gap))).select("fold", key, "role")


def purge_groups(folds: DataFrame, df: DataFrame, group: str, key: str) -> DataFrame:
    """Train rows whose group is in the fold's validation go. Any number of folds; a group's validating folds are
    one row, joined once (fold_masks and purge_masks need no join of folds and rows)."""
    named = folds.join(df.select(key, F.col(group).alias("_g")), key)
    held = named.where((F.col("role") == "val") & F.col("_g").isNotNull()).groupBy(F.col("_g").alias("_h")).agg(F.collect_set("fold").alias("_held"))
    gone = (F.col("role") == "train") & F.coalesce(F.array_contains("_held", F.col("fold")), F.lit(False))
    return named.join(held, F.col("_g") == F.col("_h"), "left").where(~gone).select("fold", key, "role")


def inferred_gap(df: DataFrame, date: str, split: str = "split") -> DataFrame:
    """One row: months between the last train and the first holdout month."""
    m = month_label(F.col(date))
    return df.agg((F.min(F.when(F.col(split).isin("early", "test"), m)) - F.max(F.when(F.col(split) == "train", m)) - 1).alias("gap_months"))


def check_folds(folds: DataFrame, df: DataFrame, date: str, group: str, key: str, min_val: int = 1) -> DataFrame:
    """For each fold: rows by role, validation months also in train, shared groups, and ok. One aggregate over
    the months and the groups of the folds' rows."""
    x = folds.join(df.select(key, month_label(F.col(date)).alias("_m"), F.col(group).alias("_g")), key)
    n = {f"_{r}": F.count(F.when(F.col("role") == r, 1)) for r in ("train", "val")}
    sets = x.groupingSets([["fold", "_m"], ["fold", "_g"]], "fold", "_m", "_g").agg(F.grouping("_m").alias("_of_group"), *[c.alias(k) for k, c in n.items()])
    of = lambda group, c: F.when(F.col("_of_group") == int(group), c)
    both = F.when((F.col("_train") > 0) & (F.col("_val") > 0), 1)
    out = sets.groupBy("fold").agg(*[F.sum(of(False, F.col(f"_{r}"))).alias(f"n_{r}") for r in ("train", "val")], F.count(of(False, both)).alias("shared_months"), F.count(of(True, both)).alias("shared_groups"))
    return out.withColumn("ok", (F.col("shared_months") == 0) & (F.col("shared_groups") == 0) & (F.col("n_val") >= min_val))


def check_holdout(df: DataFrame, split: str = "split", min_test: int = 120, min_early: int = 80, strict: bool = False) -> DataFrame:
    """One row: rows of test and early, and whether they are enough (early may be empty). strict: an error if not."""
    n = df.agg(*[F.count(F.when(F.col(split) == r, 1)).alias(f"n_{r}") for r in ("test", "early")])
    out = n.withColumn("ok", (F.col("n_test") >= min_test) & ((F.col("n_early") == 0) | (F.col("n_early") >= min_early)))
    if strict and not out.first()["ok"]:
        raise ValueError("too few rows held out")
    return out


def check_required_features(df: DataFrame, cols: list[str], most_null: float = 0.2) -> DataFrame:
    """(feature, present, null_share, ok) for each required column."""
    have = [c for c in cols if c in df.columns]
    wide = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in have])
    share = lambda c: 1 - F.col(c) / F.greatest(F.col("_n"), F.lit(1)) if c in have else F.lit(1.0)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in have).alias("present"), share(c).alias("null_share"), (F.lit(c in have) & (share(c) <= most_null)).alias("ok")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
