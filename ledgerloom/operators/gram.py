"""Sums of products of columns: each task multiplies its rows' matrix with itself, and Spark adds the tasks' sums.

A task holds one Arrow batch and one k x k matrix for each part it meets, so the number of columns is not bounded
by what one expression list may hold; rows are read once, whatever the number of parts or folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(n).to_numpy(zero_copy_only=False), float) for n in names], axis=1)


def gram(df: DataFrame, columns: list[Column], part: Column, weight: Column | None = None) -> DataFrame:
    """(part, i, j, v) for i <= j: sums of weight * column i * column j over the rows of each part (a string). Column 0 is 1, so
    v of (0, 0) is the weight and that of (0, j) the sum of a column. Null or nan values count as 0."""
    names = [f"c{i}" for i in range(len(columns))]
    clean = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    rows = df.select(part.cast("string").alias("part"), clean(F.lit(1.0) if weight is None else weight).alias("w"), *[clean(c).alias(n) for c, n in zip(columns, names, strict=True)])
    k = len(columns) + 1
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch, names)], axis=1) if names else np.ones((batch.num_rows, 1))
            w = np.asarray(batch.column("w").to_numpy(zero_copy_only=False), float)
            coded = batch.column("part").dictionary_encode()
            code = np.asarray(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False))
            for c in np.unique(code):
                own = code == c
                key = None if c < 0 else coded.dictionary[int(c)].as_py()
                total[key] = total.get(key, 0) + (x[own] * w[own][:, None]).T @ x[own]
        for key, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["part", "i", "j", "v"])

    return rows.mapInArrow(run, "part string, i int, j int, v double").groupBy("part", "i", "j").agg(F.sum("v").alias("v"))


def matrices(sums: DataFrame) -> dict[str | None, np.ndarray]:
    """gram() on the driver: a symmetric matrix for each part."""
    out: dict = {}
    rows = sums.toPandas()
    k = int(rows["j"].max()) + 1 if len(rows) else 0
    for key, own in rows.groupby("part", dropna=False):
        m = out.setdefault(None if key != key or key is None else key, np.zeros((k, k)))
        m[own["i"], own["j"]] = m[own["j"], own["i"]] = own["v"]
    return out


def ridge(g: np.ndarray, reg: float) -> np.ndarray:
    """(intercept, coefficients) of least squares with an L2 penalty on the coefficients of scaled columns, from a Gram
    matrix of 1, the features and the target. Columns without spread have coefficient 0; the penalty
    is `reg` over the target's deviation, as Spark's linear regression has it."""
    mean = g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    scale, y = spread[:-1], spread[-1]
    live = np.flatnonzero(scale > 1e-12 * np.maximum(1, np.abs(mean[:-1])))
    b = np.zeros(len(scale))
    if y > 0 and len(live):
        s = scale[live]
        a = cov[np.ix_(live, live)] / np.outer(s, s) + reg / y * np.eye(len(live))
        b[live] = np.linalg.solve(a, cov[live, -1] / (s * y)) * y / s
    return np.append(mean[-1] - b @ mean[:-1], b)


def pair_correlations(df: DataFrame, cols: list[str], block: int = 64) -> DataFrame:
    """(x, y, corr) for every two of the columns, x before y: Pearson correlation over the rows that have both.

    Numbers, sums, squares and products of all pairs are matrix products of values and masks, a block of columns against
    all in each."""
    names = [f"c{i}" for i in range(len(cols))]
    rows = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(cols, names, strict=True)])
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = np.zeros((5, k, k)), None
        for batch in batches:
            x = _matrix(batch, names)
            there = ~np.isnan(x)
            m = there.astype(float)
            if shift is None:  # sums about a value of the column lose fewer digits; undone below
                shift = np.array([c[t][0] if t.any() else 0.0 for c, t in zip(x.T, there.T, strict=True)])
            x = np.where(there, x - shift, 0)
            for a in range(0, k, block):
                s = slice(a, a + block)
                for at, (u, v) in enumerate(((m, m), (x, m), (x * x, m), (x, x))):
                    total[at, s] += u[:, s].T @ v
        if shift is None:
            return
        n, sx, sxx, sxy, _ = total
        sy, syy = sx.T, sxx.T
        p, q = shift[:, None], shift[None, :]
        full = (n, sx + n * p, sxx + 2 * p * sx + n * p * p, sy + n * q, syy + 2 * q * sy + n * q * q, sxy + q * sx + p * sy + n * p * q)
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in full]], ["i", "j", "n", "sx", "sxx", "sy", "syy", "sxy"])

    sums = rows.mapInArrow(run, "i int, j int, n double, sx double, sxx double, sy double, syy double, sxy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "syy", "sxy")])
    c = F.col
    under = F.sqrt(F.greatest(F.lit(0.0), c("sxx") - c("sx") * c("sx") / c("n"))) * F.sqrt(F.greatest(F.lit(0.0), c("syy") - c("sy") * c("sy") / c("n")))
    known = F.array(*[F.lit(x) for x in cols])
    value = F.when(c("n") > 1, F.try_divide(c("sxy") - c("sx") * c("sy") / c("n"), F.when(under > 0, under)))
    return sums.select(known[c("i")].alias("x"), known[c("j")].alias("y"), value.alias("corr"))
