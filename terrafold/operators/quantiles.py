"""Exact quantiles and ranks of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.sources.tables import saved

#: Distinct values that one window sorts.
MOST = 100_000


def _alike(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def at_ranks(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, Column], pieces: int = 128, most: int = MOST) -> DataFrame:
    """``keys, n, name_, at_`` and ``low_, high_``: the values at the whole ranks (from 0) around ``at_``, which ``wanted`` says by name in terms of ``n``.

    Nulls and NaN are left out. No group is gathered or sorted whole. Values are counted first; as long as some part of a group has
    more than ``most`` distinct values, approximate quantiles of bounded size cut each part into pieces, the pieces are counted, and only those that hold a
    wanted rank go on. What is left is summed up in order, part by part.
    """
    double = F.col(value).cast("double")
    parts = saved(rows.where(double.isNotNull() & ~F.isnan(double)).groupBy(*keys, double.alias("v_")).agg(F.count(F.lit(1)).alias("c_")).withColumn("part_", F.lit(0).cast("long")), "value-counts")
    names = F.array(*[F.struct(F.lit(name).alias("name_"), at.cast("double").alias("at_")) for name, at in wanted.items()])
    at = parts.groupBy(*keys).agg(F.sum("c_").alias("n")).select(*keys, "n", F.inline(names))
    ranks = at.select(*keys, "n", "name_", "at_", F.explode(F.array_distinct(F.array(F.floor("at_"), F.ceil("at_")))).alias("rank_"), F.lit(0).cast("long").alias("part_"), F.lit(0).cast("long").alias("before_"))
    own = [*keys, "part_"]
    fractions = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    while (parts.groupBy(*own).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0) > most:
        cuts = saved(parts.groupBy(*own).agg(F.array_distinct(F.percentile_approx("v_", fractions, F.lit(10 * pieces))).alias("cuts_")), "cuts")
        piece = F.size(F.filter("cuts_", lambda c: c < F.col("v_"))).cast("long")
        parted = parts.join(cuts, _alike(parts, cuts, own)).select(*[parts[k] for k in own], "v_", "c_", piece.alias("piece_"))
        sums = parted.groupBy(*own, "piece_").agg(F.sum("c_").alias("s_"))
        earlier = Window.partitionBy(*own).orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
        sums = sums.withColumn("p_", F.coalesce(F.sum("s_").over(earlier), F.lit(0)))
        begin = F.col("before_") + F.col("p_")
        met = ranks.join(sums, _alike(ranks, sums, own) + [F.col("rank_") >= begin, F.col("rank_") < begin + F.col("s_")])
        held = saved(met.select(*[ranks[k] for k in keys], "n", "name_", "at_", "rank_", (ranks["part_"] * pieces + F.col("piece_")).alias("part_"), begin.alias("before_")), "wanted-ranks")
        some = held.select(*own).distinct()
        inside = parted.withColumn("part_", F.col("part_") * pieces + F.col("piece_")).drop("piece_")
        parts, ranks = saved(inside.join(some, _alike(inside, some, own), "left_semi"), "value-counts"), held
    up = Window.partitionBy(*own).orderBy("v_")
    summed = parts.withColumn("to_", F.sum("c_").over(up))
    found = ranks.join(summed, _alike(ranks, summed, own) + [F.col("rank_") - F.col("before_") >= F.col("to_") - F.col("c_"), F.col("rank_") - F.col("before_") < F.col("to_")])
    return found.groupBy(*[ranks[k] for k in keys], "n", "name_", "at_").agg(F.min("v_").alias("low_"), F.max("v_").alias("high_"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], pieces: int = 128, most: int = MOST) -> DataFrame:
    """``keys``, ``n`` and, for each name, the quantile of the group's values, linear between the two nearest ones."""
    each = at_ranks(rows, keys, value, {name: (F.col("n") - 1) * float(q) for name, q in quantiles.items()}, pieces, most)
    value_ = F.col("low_") + (F.col("high_") - F.col("low_")) * (F.col("at_") - F.floor("at_"))
    return each.withColumn("x_", value_).groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name_") == name, F.col("x_"))).alias(name) for name in quantiles])


def column_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]], least: int = 1) -> DataFrame:
    """One row: for each name the quantile of a column, null where the column has fewer than ``least`` values."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    at = {f"q{i}": q for i, q in enumerate(dict.fromkeys(q for _, q in wanted.values()))}
    of = {q: name for name, q in at.items()}
    found = exact_quantiles(rows.select(F.inline(each)), ["variable"], "value", at).where(F.col("n") >= least)
    return found.agg(*[F.max(F.when(F.col("variable") == c, F.col(of[q]))).alias(name) for name, (c, q) in wanted.items()])
