"""Removal of repeated byte strings with a distributed suffix array.

Each byte that lies in a string of ``size`` bytes which also starts somewhere else, in any document or the same, is
removed. Suffixes are not sorted from every byte: content-defined anchors cut each text into phrases, and the suffix
array is built over phrases.

*Anchors.* The anchor of a window of ``size`` bytes is the 8-gram with the smallest hash among its first ``REACH``
(the last of equals). It depends on the window's bytes alone, so equal windows have anchors at equal offsets.

*Suffix array, by difference cover.* Suffixes start at anchors and at starts of texts. Those at positions 1 and 2
modulo 3 are the sample: their triples of phrases are sorted and named, the triples of names are sorted and named again
(nine phrases, which span the compared prefix; what still ties is ordered by the prefix's digest). Suffixes at position
0 follow from their first phrases and the rank of the sampled suffix behind, which merges them with either half of the
sample. Adjacent suffixes whose prefix (the phrases up to ``size`` bytes past the next suffix) is equal make all windows
that start in their first phrase repeats.

*What is left.* Windows at the edge of a repeat start in a phrase that is not repeated wholly. Where the bytes that all
windows of an anchor share are repeated, and the suffix array did not settle the anchor, its windows are compared by
their hashes, in blocks first and one by one where a block is undecided; so are, once for each distinct content, the
settled windows of the same class that they may be equal to. That exact step makes the result independent of where
anchors fall.

Suffixes whose shared bytes occur once in the corpus cannot be part of a repeat; a filter leaves nearly all of them out
before the sort.
Texts are shuffled only if they have something to remove.

Defined results: null is the empty text; texts shorter than ``size`` lose nothing; rows that repeat id and text are
repeats of each other; an empty table gives an empty result. Equality of strings is judged by 64-bit hashes.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.shared import forget, stored
from terrafold.llm.textcols import text_of
from terrafold.llm.words import mixed, parts, powers

REACH = 128
GRAM = 8
#: Bounds of a filter's size in bits, as a power of two: 128 KB to 128 MB, whatever the number of keys.
FILTER_BITS = (20, 30)
#: Bytes from an anchor that are looked up in other documents: a common passage of 285 bytes, some 50 words, is always found.
PASSAGE = 150
#: Windows of an anchor that are judged together, by their distance to it.
STEP = 16
_SPREAD, _LITTLE = np.uint64(0x9E3779B97F4A7C15), sys.byteorder == "little"
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class Hashes:
    """Hashes of any ranges of an array of bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_VALUES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor, and the first and last window start that has it. Windows end within their text by ``REACH + GRAM - 1``."""
    n, span = len(data), REACH + GRAM - 1
    if n < span:
        return (np.empty(0, np.int64),) * 3
    gram = data.astype(np.uint64)
    for step in (1, 2, 4):
        gram = gram[:-step] | gram[step:] << np.uint64(8 * step)
    low = np.uint64(0xFFFFFFFF)
    gram *= _SPREAD  # the upper half is the hash; the lower half becomes the place, counted down, so that the last of equals wins
    gram |= low
    gram -= np.arange(len(gram), dtype=np.uint64)
    key, step = gram, 1
    while step < REACH:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    at = ~key.view(np.uint32)[:: 2] if _LITTLE else ~key.astype(np.uint32)
    # Runs of window starts with one anchor, cut at the starts of texts and held within each text.
    begin, last = bounds[:-1], bounds[1:] - span
    long = last >= begin
    begin, last = begin[long], last[long]
    if not len(begin):
        return (np.empty(0, np.int64),) * 3
    first = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, begin)
    text = np.searchsorted(begin, first, "right") - 1
    end = np.minimum(np.append(first[1:] - 1, len(at) - 1), last[text])
    keep = (text >= 0) & (end >= first)
    first, end = first[keep], end[keep]
    return at[first].astype(np.int64), first, end


def passages(at: np.ndarray, bounds: np.ndarray, size: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the ``size`` bytes from each anchor that lie in its text.

    Two texts with a common string of ``size + REACH + GRAM - 1`` bytes have one of these in common at least.
    """
    at = np.unique(at)
    text = np.searchsorted(bounds, at, "right") - 1
    within = at + size <= bounds[text + 1]
    return text[within], hashes.of(at[within], at[within] + size)


def suffixes(data: np.ndarray, bounds: np.ndarray, size: int, hashes: Hashes | None = None, found: tuple | None = None) -> dict[str, np.ndarray]:
    """All suffix starts of texts of at least ``size`` bytes, with positions relative to their text.

    ``q`` is the hash of what all windows of the anchor share, as whole phrases; ``h`` that of the compared prefix, which
    settles the starts ``pos .. last``; ``lo .. hi`` are the windows of the anchor (hi < lo: none), ``w`` the hash of all of
    them together.
    """
    at, lo, hi = found or anchors(data, bounds)
    long = np.flatnonzero(np.diff(bounds) >= size)
    text = np.searchsorted(bounds, at, "right") - 1
    keep = np.diff(bounds)[text] >= size
    at, lo, hi, text = at[keep], lo[keep], np.minimum(hi[keep], bounds[text[keep] + 1] - size), text[keep]
    heads = bounds[:-1][long]
    pos = np.union1d(at, heads)
    place = np.searchsorted(pos, at)
    first, last = np.zeros(len(pos), np.int64), np.full(len(pos), -1, np.int64)
    first[place], last[place] = lo, hi
    doc = np.searchsorted(bounds, pos, "right") - 1
    end, begin = bounds[doc + 1], bounds[doc]
    after = np.append(pos[1:], -1)
    same = np.append(doc[1:] == doc[:-1], False)[: len(pos)]
    after = np.where(same, after, end)
    hashes = hashes or Hashes(data)
    sym = hashes.of(pos, after)
    chain = [sym]
    for k in (1, 2):
        chain.append(np.where(np.append(doc[k:], np.full(min(k, len(doc)), -1)) == doc, np.append(sym[k:], np.zeros(min(k, len(sym)), np.uint64)), np.uint64(0)))
    shared = pos[np.searchsorted(pos, pos + (size - 2 * REACH - GRAM + 1), "right") - 1]
    q = hashes.of(pos, np.maximum(pos, np.minimum(shared, end)))
    to = np.append(pos, len(data))[np.searchsorted(pos, after + size - 1)]
    to = np.minimum(to, end)
    has = last >= first
    w = hashes.of(np.where(has, first, 0), np.where(has, last + size, 0))
    out = {"j": np.arange(len(pos)) - np.searchsorted(pos, begin), "pos": pos - begin, "last": np.minimum(after - 1, to - size) - begin,
           "s0": chain[0], "s1": chain[1], "s2": chain[2], "q": q, "h": hashes.of(pos, to), "w": w, "lo": np.where(last < first, 0, first - begin), "hi": np.where(last < first, -1, last - begin), "doc": doc}
    used = pos <= end - (size - REACH + 1)
    return {k: v[used] for k, v in out.items()}


def bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """A bit for each value of the column ``key`` modulo a power of two, about 64 bits for each of n keys, within bounds.

    A filter only saves work: what passes it by chance is judged like all else.
    """
    bits = min(max(FILTER_BITS[0], (64 * n).bit_length()), FILTER_BITS[1])
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    blocks = keys.select(low.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks:
        # Bucket numbers begin at 1 for values from 1 on; position 0 of the first bucket is value 1.
        at = (row.block - 1) * 4096
        part = np.frombuffer(bytes(row.bits), np.uint8)
        if at >= 0:
            out[at : at + 4096] |= part[: len(out) - at]
        else:  # value 0
            out[-1] |= 0x80
    return out


def has_bits(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    v = keys.view(np.uint64) & np.uint64(len(filter_) * 8 - 1)
    v = np.where(v == 0, len(filter_) * 8, v).astype(np.int64) - 1
    return filter_[v >> 3] >> (v & 7).astype(np.uint8) & 1 == 1


def place_key(rid: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    key = rid.view(np.uint64)
    for x in numbers:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return key.view(np.int64)


def block_ranges(found: dict[str, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the kept suffixes with windows: suffix, block number, and first and last start of each block of windows."""
    at = np.flatnonzero(keep & (found["hi"] >= found["lo"]))
    near, far = (found["pos"] - found["hi"])[at], (found["pos"] - found["lo"])[at]
    n = far // STEP - near // STEP + 1
    k = np.repeat(at, n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(near // STEP, n)
    return k, b, found["pos"][k] - np.minimum(STEP * b + STEP - 1, np.repeat(far, n)), found["pos"][k] - np.maximum(STEP * b, np.repeat(near, n))


class RepeatSearch:
    """The steps over one table; ``starts`` is the result."""

    def __init__(self, rows: DataFrame, size: int, passage: int):
        """``rows`` has rid and text (not null)."""
        if size < 2 * REACH + GRAM + 1:
            raise ValueError(f"strings of fewer than {2 * REACH + GRAM + 1} bytes are not searched")
        self.rows, self.size, self.passage, self.spark = rows, size, passage, rows.sparkSession

    def _repeated(self) -> DataFrame:
        """Classes that occur more than once; ``shared`` gets the documents with strings of ``passage`` bytes that others have."""
        size, passage = self.size, self.passage

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column("rid").to_numpy()
                for first, data, bounds in parts(batch.column("text")):
                    hashes, found = Hashes(data), anchors(data, bounds)
                    q = suffixes(data, bounds, size, hashes, found)["q"]
                    yield pa.RecordBatch.from_pydict({"key": q.view(np.int64), "rid": pa.nulls(len(q), pa.int64())})
                    text, key = passages(found[0], bounds, passage, hashes)
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "rid": pa.array(rid[first + text], pa.int64())})

        keys = stored(self.rows.select("rid", "text").mapInArrow(scan, "key long, rid long"), "keys")
        places = keys.where("rid is not null")
        several = stored(places.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("key"), "shared-strings")
        self.shared = stored(places.join(several, "key", "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("n_shared")), "shared")
        repeated = stored(keys.where("rid is null").groupBy(F.col("key").alias("q")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("q"), "repeated-classes")
        forget(self.spark, keys)
        forget(self.spark, several)
        self._clean()
        return repeated

    def _suffixes(self, repeated: DataFrame) -> DataFrame:
        size, wanted = self.size, self.spark.sparkContext.broadcast(bitmap(repeated.select(F.col("q").alias("key")), repeated.count()))
        names = ("rid", "j", "pos", "last", "lo", "hi", "s0", "s1", "s2", "q", "h", "w")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column("rid").to_numpy()
                for first, data, bounds in parts(batch.column("text")):
                    found = suffixes(data, bounds, size)
                    keep = has_bits(wanted.value, found["q"])
                    columns = {k: v[keep].astype(np.int32) if k in ("j", "pos", "last", "lo", "hi") else v[keep].view(np.int64) for k, v in found.items() if k != "doc"}
                    columns["rid"] = rid[first + found["doc"][keep]]
                    yield pa.RecordBatch.from_pydict({k: columns[k] for k in names})

        found = self.rows.select("rid", "text").mapInArrow(scan, "rid long, j int, pos int, last int, lo int, hi int, s0 long, s1 long, s2 long, q long, h long, w long")
        return stored(found, "suffixes")

    def _named(self, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        """Sort the distinct triples and name each by its place; ``rows`` get the name of theirs."""
        order = rows.select(*columns).distinct().orderBy(*columns)
        names = stored(order.withColumn(name, F.monotonically_increasing_id() + 1), "names")
        return rows.join(names, columns)

    def _adjacent(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``rid, j`` of the suffixes whose prefix equals a neighbour's in the order of ``keys``.

        Place is the last key, so a prefix that very many texts share spreads over several ranges. A suffix whose only equal
        neighbour lies in another range is left to the exact step.
        """
        order = [*keys, "h", "rid", "j"]
        ranged = rows.select("rid", "j", "h", *keys).repartitionByRange(*order).sortWithinPartitions(*order)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = None  # (rid, j, h, settled) of the last row so far
            for batch in batches:
                if not batch.num_rows:
                    continue
                rid, j, h = (batch.column(c).to_numpy() for c in ("rid", "j", "h"))
                like = h[1:] == h[:-1]
                settled = np.append(like, False) | np.append(False, like)
                if before is not None and before[2] == h[0]:
                    settled[0] = True
                    if not before[3]:  # the last row of the batch before turns out to have an equal neighbour
                        rid, j, settled = np.insert(rid, 0, before[0]), np.insert(j, 0, before[1]), np.insert(settled, 0, True)
                before = (rid[-1], j[-1], h[-1], settled[-1])
                yield pa.RecordBatch.from_pydict({"rid": rid[settled], "j": j[settled]})

        return ranged.select("rid", "j", "h").mapInArrow(compare, "rid long, j int")

    def _settled(self, found: DataFrame) -> DataFrame:
        """``rid, j`` of the suffixes whose compared prefix repeats, from the suffix array."""
        narrow = found.select("rid", "j", "s0", "s1", "s2", "h")
        sample = self._named(narrow.where("j % 3 <> 0"), ["s0", "s1", "s2"], "name").select("rid", "j", "name")
        string = Window.partitionBy("rid", F.col("j") % 3).orderBy("j")
        triples = sample.withColumn("t1", F.lead(F.struct("j", "name"), 1).over(string)).withColumn("t2", F.lead(F.struct("j", "name"), 2).over(string))
        triples = triples.select("rid", "j", "name", *[
            F.coalesce(F.when(F.col(f"t{k}.j") == F.col("j") + 3 * k, F.col(f"t{k}.name")), F.lit(0)).alias(f"n{k}") for k in (1, 2)])
        ranks = self._named(triples, ["name", "n1", "n2"], "rank").select("rid", "j", "rank")
        placed = narrow.join(ranks, ["rid", "j"], "left")
        text = Window.partitionBy("rid").orderBy("j")
        for k in (1, 2):
            placed = placed.withColumn(f"r{k}", F.lead(F.struct("j", "rank"), k).over(text))
            placed = placed.withColumn(f"r{k}", F.coalesce(F.when(F.col(f"r{k}.j") == F.col("j") + k, F.col(f"r{k}.rank")), F.lit(0)))
        placed = stored(placed.select("rid", "j", "h", "s0", "s1", "rank", "r1", "r2"), "placed")
        lists = (("j % 3 <> 0", ["rank"]), ("j % 3 <> 2", ["s0", "r1"]), ("j % 3 <> 1", ["s0", "s1", "r2"]))
        near = [self._adjacent(placed.where(which), keys) for which, keys in lists]
        return stored(near[0].union(near[1]).union(near[2]).distinct(), "settled")

    def _marks(self, wanted: DataFrame, columns: list[str]):
        """A broadcast filter over places: suffixes (rid, j) or blocks (rid, j, b)."""

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"key": place_key(*(batch.column(c).to_numpy() for c in columns))})

        wanted = stored(wanted.select(*columns), "wanted")
        return self.spark.sparkContext.broadcast(bitmap(wanted.mapInArrow(number, "key long"), wanted.count()))

    def _blocks(self, marks) -> DataFrame:
        """The marked suffixes' windows in blocks of ``STEP`` distances to the anchor: ``rid, j, b, first, last``, with
        ``a``, the hash of what the block's windows share, and ``u``, that of all they cover (null in cut blocks)."""
        size = self.size

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column("rid").to_numpy()
                for first, data, bounds in parts(batch.column("text")):
                    hashes = Hashes(data)
                    found = suffixes(data, bounds, size, hashes)
                    own = rid[first + found["doc"]]
                    k, b, start, last = block_ranges(found, has_bits(marks.value, place_key(own, found["j"])))
                    if not len(k):
                        continue
                    base, x = bounds[found["doc"][k]], found["pos"][k] + bounds[found["doc"][k]]
                    a = mixed(hashes.of(x - STEP * b, x - STEP * b - STEP + 1 + size) + b.astype(np.uint64))
                    whole = last - start == STEP - 1
                    u = np.zeros(len(k), np.uint64)
                    u[whole] = mixed(hashes.of((start + base)[whole], (last + base)[whole] + size) + b[whole].astype(np.uint64))
                    yield pa.RecordBatch.from_pydict({"rid": own[k], "j": found["j"][k].astype(np.int32), "b": b.astype(np.int32), "first": start.astype(np.int32), "last": last.astype(np.int32),
                                                      "a": a.view(np.int64), "u": pa.array(u.view(np.int64), mask=~whole)})

        return stored(self.rows.select("rid", "text").mapInArrow(scan, "rid long, j int, b int, first int, last int, a long, u long"), "blocks")

    def _windows(self, marks, block_marks) -> DataFrame:
        """``a, rid, start``: the hash of every window of the marked blocks; others may come too."""
        size = self.size

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid = batch.column("rid").to_numpy()
                for first, data, bounds in parts(batch.column("text")):
                    hashes = Hashes(data)
                    found = suffixes(data, bounds, size, hashes)
                    own = rid[first + found["doc"]]
                    k, b, start, last = block_ranges(found, has_bits(marks.value, place_key(own, found["j"])))
                    keep = has_bits(block_marks.value, place_key(own[k], found["j"][k], b))
                    if not keep.any():
                        continue
                    k, n = k[keep], (last - start)[keep] + 1
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[keep], n)
                    from_ = at + np.repeat(bounds[found["doc"][k]], n)
                    yield pa.RecordBatch.from_pydict({"a": hashes.of(from_, from_ + size).view(np.int64), "rid": np.repeat(own[k], n), "start": at.astype(np.int32)})

        return stored(self.rows.select("rid", "text").mapInArrow(scan, "a long, rid long, start int"), "windows")

    def _compared(self, wanted: DataFrame) -> DataFrame:
        """``rid, first, last``: repeated starts among the windows of the wanted suffixes.

        What a block's windows share occurs once: none of them repeats. All that they cover occurs twice: all do. Only
        in between are windows compared one by one, with those of one block of each settled content they may equal.
        """
        marks = self._marks(wanted, ["rid", "j"])
        blocks = self._blocks(marks)
        self._clean()
        # Stored, so that a join with them is of two plain exchanges, whose hot keys Spark splits.
        several = lambda c: stored(blocks.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c), "several")
        likely = blocks.join(several("a"), "a", "left_semi").join(several("u").withColumn("all", F.lit(True)), "u", "left")
        likely = stored(likely.select("rid", "j", "b", "first", "last", "a", "u", F.coalesce("all", F.lit(False)).alias("all")), "likely-blocks")
        sure, open_ = likely.where("all"), likely.where("not all")
        partners = sure.join(stored(open_.select("a").distinct(), "open-blocks"), "a", "left_semi").groupBy("a", "u").agg(F.min(F.struct("rid", "j", "b")).alias("one")).select("one.*")
        windows = self._windows(marks, self._marks(open_.select("rid", "j", "b").union(partners), ["rid", "j", "b"]))
        self._clean()
        twice = stored(windows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "twice")
        single = windows.join(twice, "a", "left_semi").select("rid", F.col("start").alias("first")).distinct()
        run = Window.partitionBy("rid").orderBy("first")  # single starts become ranges before they travel on
        runs = single.withColumn("run", F.col("first") - F.row_number().over(run)).groupBy("rid", "run").agg(F.min("first").alias("first"), F.max("first").alias("last"))
        return sure.select("rid", "first", "last").union(runs.select("rid", "first", "last"))

    def starts(self) -> DataFrame:
        """``rid, first, last``: ranges of starts of repeated windows; ranges may overlap."""
        found = self._suffixes(self._repeated())
        settled = self._settled(found)
        self._clean()
        marked = found.join(settled.withColumn("sure", F.lit(True)), ["rid", "j"], "left").select("rid", "j", "pos", "last", "lo", "hi", "q", "w", F.coalesce("sure", F.lit(False)).alias("sure"))
        # The windows of an anchor start in the phrases before it, so the unbroken run of settled suffixes there settles them.
        text = Window.partitionBy("rid").orderBy("j")
        step = marked.withColumn("before", F.lag(F.struct("j", "last", "sure")).over(text))
        joined = F.col("before.sure") & (F.col("before.j") == F.col("j") - 1) & (F.col("before.last") >= F.least("hi", F.col("pos") - 1))
        step = step.withColumn("joined", F.coalesce(joined, F.lit(False)))
        step = step.withColumn("run", F.sum((~F.col("joined")).cast("int")).over(text))
        step = step.withColumn("since", F.min("pos").over(Window.partitionBy("rid", "run")))
        covered = F.col("joined") & (F.col("since") <= F.col("lo")) & ((F.col("hi") < F.col("pos")) | F.col("sure"))
        marked = stored(step.select("rid", "j", "pos", "last", "lo", "hi", "q", "w", "sure", covered.alias("covered")), "marked")
        open_ = marked.where("hi >= lo and not covered")
        # Settled windows that an open one may be equal to: one anchor for each content of all its windows.
        likely = marked.where("hi >= lo and covered").join(stored(open_.select("q").distinct(), "open-classes"), "q", "left_semi")
        chosen = likely.groupBy("w", F.col("hi") - F.col("pos"), F.col("lo") - F.col("pos")).agg(F.min(F.struct("rid", "j")).alias("one")).select("one.rid", "one.j")
        compared = self._compared(open_.select("rid", "j").union(chosen))
        return marked.where("sure and last >= pos").select("rid", F.col("pos").alias("first"), "last").union(compared)

    def _clean(self) -> None:
        """Let Spark delete shuffle files of steps that are over."""
        gc.collect()
        self.spark._jvm.System.gc()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, passage: int = PASSAGE) -> DataFrame:
    """``id, n_bytes, spans, kept, n_shared`` for every row: maximal removed byte ranges (start, end), the bytes that are
    left, and the number of anchored strings of ``passage`` bytes that another document has too. ``n_shared`` tells of
    passages that are shorter than ``size``, of which nothing is removed."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    search = RepeatSearch(rows.select("rid", "text"), size, passage)
    found = search.starts().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = stored(found.join(search.shared, "rid", "full"), "repeat-ranges")
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(ranges.select(F.col("rid").alias("key")), ranges.count()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(has_bits(touched.value, batch.column("rid").to_numpy()))], names=[*batch.schema.names, "touched"])

    id_type = rows.schema["id"].dataType.simpleString()
    routed = rows.mapInArrow(route, f"id {id_type}, text string, rid long, touched boolean")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                for r in ranges.as_py() or ():
                    edge[r["first"]] += 1
                    edge[r["last"] + size] -= 1
                inside = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
                n_bytes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in change.reshape(-1, 2).tolist()])
                kept.append(data[~inside].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), batch.column("n_shared")],
                                             names=["id", "n_bytes", "spans", "kept", "n_shared"])

    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = routed.where("not touched").select("id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("spans"), F.col("text").cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_shared"))
    joined = routed.where("touched").join(ranges, "rid", "left").select("id", "text", "ranges", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    return whole.union(joined.mapInArrow(cut, f"id {id_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, n_shared long"))


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
