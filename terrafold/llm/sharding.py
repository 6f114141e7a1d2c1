"""Sharding by longest processing time: groups of equal texts, largest first, go to the least-loaded shard of a heap.

The size of a document is the UTF-8 bytes of its text plus ``OVERHEAD``; a group is all documents of one text (128 bits of
its MD5), and stays together, whatever its size. All groups stand in one order, largest first; running sums over ranges of that order
cut it into pieces of total / (shards * parts) bytes. A group of at least so many bytes is a piece of its own and is scheduled
alone; smaller ones are scheduled with their neighbours of like size. So the heap sees at most shards * parts pieces,
however many groups there are, and the loads of two shards differ by less than two pieces, unless one group exceeds a shard's share.

Slots number the documents of a shard from 0: the pieces of a shard follow each other, in a piece its groups, in a group its
documents by ``SALTS`` classes of their id and then by id. No task numbers a whole group: a group is counted by class first.

Defined results: null text is an empty one; a null id is a value of its own; rows that repeat id and text are each placed, in
any order among themselves; empty tables give empty results. Columns other than those named in the call are not read, so
none can clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.shared import stored
from terrafold.llm.textcols import text_of

#: Bytes that a document takes beside its text.
OVERHEAD = 8
SHARDS = 24
#: Pieces in a shard's fair share; bounds the heap's input and the difference between shards.
PARTS = 1024
#: Classes of ids within a group, told by the first hexadecimal digits of the id's MD5.
SALT_DIGITS = 3
SALTS = 16**SALT_DIGITS


def group_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def salt(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, SALT_DIGITS)


def ranked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, salt, size, crc, rank``: each document with its place among those of its group and class."""
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), group_key(text).alias("key"), salt(F.col(id_col)).alias("salt"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id")) - 1)


def _ordered(groups: DataFrame) -> DataFrame:
    """``groups`` (key, bytes, n) with the bytes and documents of all groups before, largest first and then by key.

    Groups are dealt to ranges of that order; each range sums for itself, and the few sums of whole ranges are added.
    """
    ranged = stored(groups.repartitionByRange(F.desc("bytes"), "key").withColumn("range", F.spark_partition_id()), "shard-groups")
    sums = ranged.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range, as many as a shuffle has partitions
    sums = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_range") for c in ("b", "r")])
    within = Window.partitionBy("range").orderBy(F.desc("bytes"), "key").rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.withColumns({"b": F.coalesce(F.sum("bytes").over(within), F.lit(0)), "r": F.coalesce(F.sum("n").over(within), F.lit(0))}).join(F.broadcast(sums), "range")
    return both.select("key", "bytes", "n", (F.col("b") + F.col("b_range")).alias("bytes_before"), (F.col("r") + F.col("r_range")).alias("rows_before"))


def _heap(shards: int):
    """A function that schedules pieces (largest first) and numbers the documents of each shard."""
    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, rows = [(0, k) for k in range(shards)], [0] * shards
        for batch in batches:
            got = batch.to_pydict()
            to, first = [], []
            for size, n in zip(got["bytes"], got["n"]):
                load, k = loads[0]
                heapq.heapreplace(loads, (load + size, k))
                to.append(k)
                first.append(rows[k])
                rows[k] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(got["piece"], pa.int64()), pa.array(to, pa.int32()), pa.array(first, pa.int64()), pa.array(got["rows_before"], pa.int64())],
                names=["piece", "shard", "first_slot", "piece_rows_before"])

    return schedule


def longest_first(groups: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """``key, shard, first_slot`` of groups (key, bytes, n)."""
    placed = _ordered(groups)
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    share = F.greatest(F.ceil(F.col("total") / (shards * parts)), F.lit(1)).cast("long")
    placed = stored(placed.crossJoin(F.broadcast(total)).withColumn("share", share).selectExpr("key", "rows_before", "bytes", "n", "bytes_before div share AS piece"), "shard-pieces")  # total is one row
    pieces = placed.groupBy("piece").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("rows_before").alias("rows_before"))
    # At most shards * parts rows, so one task schedules them.
    dealt = stored(pieces.repartition(1).sortWithinPartitions(F.desc("bytes"), "piece").mapInArrow(_heap(shards), "piece long, shard int, first_slot long, piece_rows_before long"), "shard-schedule")
    return placed.join(F.broadcast(dealt), "piece").select("key", "shard", (F.col("first_slot") + F.col("rows_before") - F.col("piece_rows_before")).alias("first_slot"))


def _placed(ranked: DataFrame, shards: int, parts: int) -> DataFrame:
    """``key, salt, shard, first_slot`` of every class of every group."""
    classes = ranked.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    groups = classes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most SALTS rows a group
    numbered = classes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("key", "salt", "before")
    return numbered.join(longest_first(groups, shards, parts), "key").select("key", "salt", "shard", (F.col("first_slot") + F.col("before")).alias("first_slot"))


def assign(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, crc, shard, slot`` of every document."""
    ranked = stored(ranked_rows(docs, id_col, text_col), "shard-rows")
    placed = _placed(ranked, shards, parts)
    return ranked.join(placed, ["key", "salt"]).select("id", "size", "crc", "shard", (F.col("first_slot") + F.col("rank")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, in one folder a shard (``shard=0`` and so on). A column named ``shard`` is replaced.

    Texts travel once, by group and class of id, so that a group of many copies is written by many tasks.
    """
    placed = _placed(stored(ranked_rows(docs, id_col, text_col), "shard-rows"), shards, parts)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("doc"), group_key(text_of(text_col)).alias("key"), salt(F.col(id_col)).alias("salt"))
    keyed.join(placed.select("key", "salt", "shard"), ["key", "salt"]).select("doc.*", "shard").write.partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: One step of the table of CRC-32, and the whole sum over the bytes of a text.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"

OP11_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key, left(md5(coalesce(doc_id::VARCHAR, '')), {SALT_DIGITS}) AS salt, strlen(coalesce(text, '')) + {OVERHEAD} AS size FROM documents),
sums AS (SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT key, any_value(text) AS text, hex(encode(any_value(text))) AS hex FROM d GROUP BY key), crc),
g AS (SELECT key, sum(size)::BIGINT AS bytes, count(*) AS n FROM d GROUP BY key),
o AS (SELECT *, coalesce(sum(bytes) OVER w, 0)::BIGINT AS b, coalesce(sum(n) OVER w, 0)::BIGINT AS r FROM g WINDOW w AS (ORDER BY bytes DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS MATERIALIZED (SELECT *, b // (SELECT greatest(ceil(sum(bytes) / {SHARDS * PARTS}), 1)::BIGINT FROM g) AS piece FROM o),
q AS MATERIALIZED (SELECT piece, bytes, n, r, row_number() OVER (ORDER BY bytes DESC, piece) AS i FROM (SELECT piece, sum(bytes)::BIGINT AS bytes, sum(n)::BIGINT AS n, min(r) AS r FROM p GROUP BY piece)),
h(i, piece, shard, first_slot, r, loads, counts) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), list_transform(range({SHARDS}), lambda x: 0::BIGINT)
  UNION ALL SELECT q.i, q.piece, k, counts[k], q.r, list_transform(loads, lambda x, j: x + CASE WHEN j = k THEN q.bytes ELSE 0 END), list_transform(counts, lambda x, j: x + CASE WHEN j = k THEN q.n ELSE 0 END)
  FROM (SELECT *, list_position(loads, list_min(loads))::BIGINT AS k FROM h) x JOIN q ON q.i = x.i + 1)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, (shard - 1)::INTEGER AS shard, (first_slot + p.r - h.r + row_number() OVER (PARTITION BY d.key ORDER BY salt, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN sums USING (key) JOIN p USING (key) JOIN h USING (piece)"""
