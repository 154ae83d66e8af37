"""Exact quantiles by group, without one reducer that holds a group's values.

Groups of a counted, bounded size take one exact aggregate. Beyond it, a first pass takes counts and approximate quantiles, which bracket each wanted one with a known error of
rank. A second pass counts what lies below the bracket and the distinct values inside it, a few in ten
thousand of a group's rows; the exact quantile is read off those. Groups of `accuracy` rows or fewer have
no bracket. Linear interpolation between neighbours, as percentile() has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Groups whose brackets may be broadcast to the second pass (some 100 bytes for each quantile).
MOST_BROADCAST = 100_000
#: Rows of the largest group up to which one buffer may hold a group's distinct values (some 50 bytes each, for each column).
MOST_DIRECT = 300_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group, counted."""
    return df.groupBy(*by).agg(F.count("*").alias("__rows")).agg(F.max("__rows")).first()[0] or 0


def _by_value(wanted: dict[str, tuple[Column, float]]) -> dict[str, tuple[Column, list[float]]]:
    """The distinct values that are asked for, each with all its p."""
    out: dict[str, tuple[Column, list[float]]] = {}
    for c, p in wanted.values():
        ps = out.setdefault(str(c), (c, []))[1]
        if p not in ps:
            ps.append(p)
    return out


def _direct(df: DataFrame, keys: list[Column], wanted: dict[str, tuple[Column, float]], extra: dict[str, Column]) -> DataFrame:
    """One aggregate over all columns; a group's distinct values of a column meet in one buffer."""
    values = _by_value(wanted)
    place = {k: f"_p{i}" for i, k in enumerate(values)}
    got = df.groupBy(*keys).agg(*[F.percentile(c.cast("double"), ps).alias(place[k]) for k, (c, ps) in values.items()], *[a.alias(n) for n, a in extra.items()])
    pick = [F.col(place[str(c)])[values[str(c)][1].index(p)].alias(n) for n, (c, p) in wanted.items()]
    return got.select(*[c for c in got.columns if c not in place.values() and c not in extra], *pick, *extra)


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], extra: dict[str, Column] | None = None, accuracy: int = 10_000, most: int | None = None) -> DataFrame:
    """One row for each group (one row for no keys): its keys, the wanted quantiles {name: (value, p)}, and
    other aggregates. Null keys are a group; null values don't count; a group without values has nulls.

    most: a known bound of the rows of a group; else they are counted. Up to MOST_DIRECT rows one exact aggregate takes
    all columns in a single pass, as its buffers are bounded by that; beyond it brackets do, one sketch for each value.
    The result is written, and marked for a broadcast join if it has at most MOST_BROADCAST groups."""
    by, extra = list(by), extra or {}
    g = [f"_g{i}" for i in range(len(by))]
    keys = [F.col(b).alias(n) for b, n in zip(by, g, strict=True)]
    if (largest_group(df, by) if most is None else most) <= MOST_DIRECT:
        out = cut(_direct(df, keys, wanted, extra).withColumnsRenamed(dict(zip(g, by, strict=True))))
        return F.broadcast(out) if not by or out.count() <= MOST_BROADCAST else out
    values = [c.cast("double") for c, _ in wanted.values()]
    d = 2.0 / accuracy
    sketched = {k: F.percentile_approx(c.cast("double"), [e for p in ps for e in (max(0.0, p - d), min(1.0, p + d))], accuracy) for k, (c, ps) in _by_value(wanted).items()}
    at_p = {k: ps for k, (_, ps) in _by_value(wanted).items()}

    def bracket(c: Column, p: float) -> Column:
        ends, i, n = sketched[str(c)], 2 * at_p[str(c)].index(p), F.count(c.cast("double"))
        large = n > accuracy
        return F.struct(n.alias("n"), F.when(large, ends[i]).alias("lo"), F.when(large, ends[i + 1]).alias("hi"), F.lit(float(p)).alias("p"))

    stats = df.groupBy(*keys).agg(F.array(*[bracket(c, p) for c, p in wanted.values()]).alias("_q"), *[a.alias(n) for n, a in extra.items()])
    stats = cut(stats)
    asked = stats.select(*[F.col(n).alias(f"{n}s") for n in g], F.posexplode("_q").alias("_w", "_a")).select(*[f"{n}s" for n in g], F.col("_w").alias("_ws"), "_a.*").where("n > 0")
    small = stats.count() <= MOST_BROADCAST
    if small:
        asked = F.broadcast(asked)
    rows = df.select(*keys, F.posexplode(F.array(*values)).alias("_w", "_v")).where("_v is not null")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in g], F.col("_w") == F.col("_ws"))
    inside = F.when(F.col("lo").isNull() | (F.col("_v") >= F.col("lo")), F.col("_v"))
    counted = rows.join(asked, same).where("hi is null or _v <= hi").groupBy(*g, "_w", "n", "p", inside.alias("v")).agg(F.count("*").alias("c"))
    held = F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "c"))))
    picked = counted.groupBy(*g, "_w", "n", "p").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"), held.alias("items"))

    def at(rank: Column) -> Column:
        start = F.struct(F.col("below").alias("run"), F.lit(None).cast("double").alias("v"))
        step = lambda s, x: F.struct((s["run"] + x["c"]).alias("run"), F.coalesce(s["v"], F.when(s["run"] + x["c"] > rank, x["v"])).alias("v"))
        return F.aggregate("items", start, step, lambda s: s["v"])

    place = F.col("p") * (F.col("n") - 1)
    low = F.floor(place)
    value = F.when(place == low, at(low)).otherwise((low + 1 - place) * at(low) + (place - low) * at(low + 1))
    picked = picked.select(*g, "_w", value.alias("_x"))
    wide = picked.groupBy(*[F.col(n).alias(f"{n}s") for n in g]).agg(*[F.max(F.when(F.col("_w") == i, F.col("_x"))).alias(n) for i, n in enumerate(wanted)])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in g], F.lit(True))
    out = stats.join(wide, same, "left") if by else stats.join(F.broadcast(wide), how="left")
    out = cut(out.select(*[F.col(n).alias(b) for n, b in zip(g, by, strict=True)], *wanted, *extra))
    return F.broadcast(out) if small else out


def medians(df: DataFrame, by: list[str], cols: dict[str, Column], most: int | None = None) -> DataFrame:
    """quantiles() at 0.5 for {name: value}."""
    return quantiles(df, by, {n: (c, 0.5) for n, c in cols.items()}, most=most)
