"""Quality of a training table: correlation, constants, inflation, coverage and imbalance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation(a: str, b: str):
    """Pearson's r over the rows that have both; null where one of them is constant."""
    both = lambda x, y: F.when(F.col(y).isNotNull(), F.col(x))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(both(a, b)) * F.stddev_samp(both(b, a)))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` of all column pairs, in one pass: the pairs are columns of one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def correlated(rows: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    return correlations(rows, columns).where(F.abs("r") >= least).orderBy(F.abs("r").desc(), "a", "b")


def findings(rows: DataFrame, columns: list[str], share: float = 0.95, least: int = 20) -> DataFrame:
    """``column, n, distinct_values, top_share, finding``: constant and nearly constant columns, at six decimals."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in columns]))).where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("top"))
    top = F.col("top") / F.col("n")
    return each.select("column", "n", "distinct_values", top.alias("top_share"), F.when(F.col("distinct_values") == 1, F.lit("constant")).when(
        (F.col("n") >= least) & (top >= share), F.lit("nearly constant")).alias("finding"))


def table_findings(rows: DataFrame, columns: list[str], least_r: float = 0.95, per_column: int = 5) -> DataFrame:
    """``finding, a, b, value``: what is odd in a training table; it says so and changes nothing.

    ``fewer rows than columns`` or ``few rows a column`` (value: rows), ``constant``, ``nearly constant`` (share of the commonest value), ``duplicate``
    and ``opposite`` columns (equal in every row, or with the sign changed), and ``correlated`` ones (r) that are neither. Pairs are columns of one aggregate.
    """
    told = {r.column: r for r in findings(rows, columns).collect()}  # one row a column
    constant = {c for c in columns if c not in told or told[c].finding == "constant"}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if a not in constant and b not in constant]
    differ = lambda i, a, b: [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}"), F.count_if(~F.coalesce(F.abs(F.col(a) + F.col(b)) <= 1e-9, F.lit(False))).alias(f"o{i}"), correlation(a, b).alias(f"r{i}")]
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[x for i, (a, b) in enumerate(pairs) for x in differ(i, a, b)]).first()
    out, n = [], wide.n
    if n and n < per_column * len(columns):
        out.append(("fewer rows than columns" if n < len(columns) else "few rows a column", None, None, float(n)))
    out += [(told[c].finding, c, None, float(told[c].top_share)) for c in columns if c in told and told[c].finding]
    for i, (a, b) in enumerate(pairs if n else []):
        r = wide[f"r{i}"]
        if not wide[f"d{i}"]:
            out.append(("duplicate", a, b, 1.0))
        elif not wide[f"o{i}"]:
            out.append(("opposite", a, b, -1.0))
        elif n >= 3 and r is not None and abs(r) >= least_r:
            out.append(("correlated", a, b, float(r)))
    return rows.sparkSession.createDataFrame(out, "finding string, a string, b string, value double")


def imbalance(rows: DataFrame, code: str) -> DataFrame:
    sizes = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))


def coverage(rows: DataFrame, groups: dict[str, list[str]], good: float = 0.8, poor: float = 0.3) -> DataFrame:
    """Share of the rows with a value in each group of columns."""
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.coalesce(*[F.col(c) for c in cols])).alias(f"g{i}") for i, cols in enumerate(groups.values())])
    each = wide.select(F.inline(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"g{i}").alias("with_value"), F.try_divide(F.col(f"g{i}").cast("double"), F.col("n").cast("double")).alias("share")) for i, g in enumerate(groups)])))
    return each.withColumn("flag", F.when(F.col("share") >= good, F.lit("good")).when(F.col("share") >= poor, F.lit("partial")).otherwise(F.lit("poor")))


def inflation(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column, from the correlation matrix (columns x columns, not rows).

    NaN for constants; infinite where the others determine the column.
    """
    n, matrix = len(columns), np.eye(len(columns))
    for row in correlations(rows, columns).collect():
        i, j = columns.index(row.a), columns.index(row.b)
        matrix[i, j] = matrix[j, i] = math.nan if row.r is None else row.r
    fine = [i for i in range(n) if n == 1 or not np.isnan(np.delete(matrix[i], i)).all()]
    part, out = matrix[np.ix_(fine, fine)], {c: math.nan for c in columns}
    if fine:
        values = np.diag(np.linalg.pinv(part, hermitian=True))
        singular = np.linalg.matrix_rank(part, tol=1e-10) < len(fine)
        for k, i in enumerate(fine):
            others = np.delete(np.delete(part, k, 0), k, 1)
            r2 = float(np.delete(part[k], k) @ np.linalg.pinv(others, hermitian=True) @ np.delete(part[k], k)) if len(fine) > 1 else 0.0
            out[columns[i]] = math.inf if r2 >= 1 - 1e-10 else (1 / (1 - r2) if singular else float(values[k]))
    return out


def eliminate(rows: DataFrame, columns: list[str], most: float = 10.0, protected: tuple[str, ...] = ()) -> list[tuple[str, float]]:
    """Columns dropped, constants first and then the most inflated one at a time; the later of equals goes."""
    kept, dropped = list(columns), []
    while len(kept) > 1:
        values = inflation(rows, kept)
        constant = [c for c in kept if math.isnan(values[c]) and c not in protected]
        if constant:
            dropped += [(c, math.nan) for c in constant]
            kept = [c for c in kept if c not in constant]
            continue
        worst = max((c for c in kept if c not in protected), key=lambda c: (values[c], kept.index(c)), default=None)
        if worst is None or not values[worst] > most:
            break
        dropped.append((worst, values[worst]))
        kept.remove(worst)
    return dropped
