"""Filter interaction audit by a product of incidence matrices.

Five filters give each document a mask of the conditions that it fails. Per part (language) and kind of label the masks are counted
into a histogram of 32 entries; histograms are the rows of a matrix. Four matrices of 32 by 600 whole numbers say of each
mask what becomes of it at each step of each of the 120 orders: kept, removed here, redundant (failing here, removed earlier) and
failing this filter only. The product of rows and matrices is the audit of all orders at once, and no document is looked at twice.

Whether a text was seen in a smaller id is decided by one row a text (128 bits of its MD5): its smallest id, joined back
on ids, so copies of one text never meet in a task.

Defined results: null text is empty; a null language is the part of the empty string; a null id is smaller than none, has none smaller
and no labels; rows that repeat an id are counted each, and the smallest id of a text passes in all its rows; a document is good or
toxic if any label of its id says so, and a null label says nothing; an empty table gives no parts. Columns other than those named in the call are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import stored
from terrafold.llm.textcols import text_of, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
STEPS = len(ORDERS) * len(FILTERS)

LEAST_WORDS = 100
LEAST_VARIETY = 80
MOST_CAPITALS = 10
SYMBOLS = "[#$%&*|]"
#: The kinds of histograms: all documents, good ones, toxic ones.
KINDS = ("n", "good", "toxic")


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text."""
    n, variety = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < LEAST_WORDS, 100 * variety < LEAST_VARIETY * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(SYMBOLS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part that fail exactly the filters of a mask."""
    text = text_of(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words_of(text_col).alias("words"))
    narrow = stored(narrow.select("id", "part", own_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")), "filter-masks")
    firsts = narrow.where("id is not null").groupBy("key").agg(F.min("id").alias("id"))
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic", F.lit(None).cast("binary").alias("key"))
    # One row an id: its labels, and the texts of which it is the first.
    about = marks.unionByName(firsts.select("id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), "key")).where("id is not null")
    about = about.groupBy("id").agg(said("quality"), said("toxic"), F.collect_set("key").alias("first_of"))
    met = narrow.join(about, "id", "left")
    seen = F.col("id").isNotNull() & ~F.coalesce(F.array_contains("first_of", F.col("key")), F.lit(False))
    mask = F.col("mask") + F.when(seen, F.lit(16)).otherwise(F.lit(0))
    total = lambda c, name: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(name)
    return met.groupBy("part", mask.cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n"), total("quality", "good"), total("toxic", "toxic"))


def incidence() -> dict[str, np.ndarray]:
    """For each outcome the 32 by 600 matrix: whether a mask has it at a step of an order."""
    masks = np.arange(MASKS)[:, None]
    here = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(len(order))])
    fails, gone = (masks & here) > 0, (masks & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == here}
    return {name: x.astype(np.int64) for name, x in found.items()}


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    effects = incidence()
    names, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    filter_at = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    of_filter = (filter_at[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    for batch in batches:
        rows = {kind: np.array(batch.column(kind).to_pylist(), np.int64).reshape(-1, MASKS) for kind in KINDS}
        outcome = {name: rows["n"] @ effects[name] for name in effects}
        outcome |= {"good_lost": rows["good"] @ effects["removed"], "toxic_lost": rows["toxic"] @ effects["removed"], "shapley": (outcome["removed"] @ of_filter)[:, filter_at]}
        columns = [pa.array(batch.column("part").to_pylist(), pa.string()).take(pa.array(np.repeat(np.arange(batch.num_rows), STEPS))), pa.array(np.tile(names, batch.num_rows)), pa.array(np.tile(steps, batch.num_rows))]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(x.ravel()) for x in outcome.values()], names=["part", "filter_order", "step", *outcome])


def audit(counts: DataFrame) -> DataFrame:
    """The outcomes of every part, order and step, of counts (part, mask, n, good, toxic).

    A part has at most 32 rows, so a task holds some parts whole.
    """
    entry = lambda kind: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.try_element_at(F.col("by_mask"), m)[kind], F.lit(0).cast("long"))).alias(kind)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS))))
    return counts.groupBy("part").agg(by_mask.alias("by_mask")).select("part", *[entry(kind) for kind in KINDS]).mapInArrow(_multiply, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(histograms(read("documents"), read("labels")))


OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < {LEAST_WORDS}, 100 * len(list_distinct(words)) < {LEAST_VARIETY} * len(words),
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text), regexp_matches(text, '{SYMBOLS}'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN marks USING (doc_id)),
masks AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS here, list_transform(string_split(filter_order[:step - 1], ''), lambda y: ascii(y) - 64) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step, here, n, good, toxic, fails, fails[here] AS bad, step > 1 AND list_bool_or(list_transform(before, lambda k: coalesce(fails[k], false))) AS gone FROM masks, steps),
sums AS (SELECT part, filter_order, step, here, sum(n) FILTER (NOT bad AND NOT gone) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed, sum(n) FILTER (bad AND gone) AS redundant,
  sum(n) FILTER (bad AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails, sum(good) FILTER (bad AND NOT gone) AS good_lost, sum(toxic) FILTER (bad AND NOT gone) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  coalesce(sum(removed) OVER (PARTITION BY part, here), 0)::BIGINT AS shapley FROM sums"""
