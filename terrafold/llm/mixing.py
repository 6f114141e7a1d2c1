"""Mixing sources to target weights with Efraimidis-Spirakis keys (DataFrame operations only).

Every document draws u in (0, 1) from a hash of its id and gets the exponential key -ln(u) / quality; the
smallest keys of a source come first. A source whose target is several times its size is taken whole that many
times, and only the rest of its budget is selected by key, through a prefix sum of sizes in key order.

The prefix sum never gathers a source: its keys are cut into ranges of a few thousand rows, the sizes of the
ranges are summed first, and each range then continues from the sum of those before it.

Defined results: a null text or quality counts as size 0 or quality 0 (raised to ``LEAST_QUALITY``); a null
source is a source of its own, the last in order; sources without words take nothing; documents without words
take nothing; repeated rows are separate documents; an empty table gives an empty result. Ties between equal keys
go by id, then size. Columns of the input other than id, source, size and quality are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.shared import stored
from terrafold.llm.textcols import text_of, uniform, words_of

LEAST_QUALITY = 1e-3
VARIED = 4.0
JUNK = "0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"


def text_quality(text: Column, n_words: Column, n_kinds: Column) -> Column:
    """Between 0 and 1: the share of characters that are neither digits nor ASCII punctuation, times the variety of words,
    which is their number of kinds over the root of their number (so that length alone changes little), full at
    ``VARIED``. Junk and texts that repeat their lines weigh little."""
    clean = (1 + F.length(F.translate(text, JUNK, ""))) / (1 + F.length(text))
    return clean * F.least(F.lit(1.0), (1 + n_kinds) / (VARIED * F.sqrt(1 + n_words)))


def source_targets(sizes: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """``source_key, source_size, target`` from one row a source.

    Weights are 1..cycle in order of the source's code points, null last. The whole size is shared by weight; a
    target stops at ``most`` times the size and the excess is shared again by weight. That repetition has a
    closed form: with sources in order of cap / weight, the capped ones are a prefix of that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # The level before the first source that isn't capped is the one that holds for all that follow.
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return levels.withColumn("water", water.getField("level")).select(
        "source", "source_size", "n_docs", "mean_quality",
        F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", quality_col: str = "quality",
        most: float = 3.0, cycle: int = 3, seed: str = "mix-1", rows_per_range: int = 4096, tie_col: str | None = None) -> DataFrame:
    """``id, source, size, source_size, target, epochs, key, taken`` for every row of ``docs``.

    ``taken`` sums to the floor of the target over a source: whole epochs for all, then documents in key order,
    the last of them in part. Where ids are null, ``tie_col`` draws in their place.
    """
    drawn = F.coalesce(F.col(id_col).cast("string"), F.col(tie_col)) if tie_col else F.col(id_col)
    quality = F.greatest(F.coalesce(F.col(quality_col).cast("double"), F.lit(0.0)), F.lit(LEAST_QUALITY))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"), quality.alias("quality"), uniform(drawn, seed=seed).alias("u"),
        ).withColumn("key", -F.log("u") / F.col("quality")).drop("u"),
        "mix-rows",
    )
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("quality").alias("mean_quality"))
    targets = source_targets(per_source, most, cycle)
    keyed = rows.withColumnRenamed("source", "own_source").join(targets, F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / rows_per_range))
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("key") * F.col("mean_quality"))) * ranges))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    words = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    part = words - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    return placed.select(
        "id", "source", "size", "source_size", "target", epochs.alias("epochs"), "key",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` over documents: size is the number of words, quality that of ``text_quality``."""
    counts = F.get(F.transform(F.array(words_of("text")), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds"))), F.lit(0))
    counted = docs.select("doc_id", "source", text_of("text").alias("text"), counts.alias("n"))
    sized = counted.select("doc_id", "source", F.col("n.words").alias("size"), text_quality(F.col("text"), F.col("n.words"), F.col("n.kinds")).alias("quality"),
                           F.when(F.col("doc_id").isNull(), F.md5("text")).alias("tie"))
    return mix(sized, tie_col="tie", **options)


def op8_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"), "taken", F.col("epochs").cast("long").alias("epochs"))


#: The same rows in DuckDB. Its recursion shares the excess again and again, as the definition says.
OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         len(w)::BIGINT AS size, md5(text) AS tie,
         (1 + length(translate(coalesce(text, ''), '{JUNK}', '')))::DOUBLE / (1 + length(coalesce(text, '')))
         * least(1.0::DOUBLE, (1 + len(list_distinct(w)))::DOUBLE / ({VARIED}::DOUBLE * sqrt((1 + len(w))::DOUBLE))) AS quality
  FROM (SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents)),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, tie, '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / greatest(quality, 0.001) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, weight, 0.0::DOUBLE AS target, false AS capped,
         (SELECT sum(size) FROM d)::DOUBLE AS excess FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, least(t, 3.0 * source_size), t >= 3.0 * source_size,
         sum(greatest(t - 3.0 * source_size, 0)) OVER ()
  FROM (SELECT *, target + CASE WHEN capped THEN 0 ELSE excess * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS t
        FROM fill WHERE excess > 1e-7 AND round < 200)
),
t AS (SELECT source, source_size, target FROM fill WHERE round = (SELECT max(round) FROM fill)),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         floor(t.target + 1e-6)::BIGINT AS words
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
        + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken,
       (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END)::BIGINT AS epochs
FROM p
"""
