"""Packing token sequences by minimum bin slack.

Each document's ids (with an end id) are cut at full windows; what remains is packed inside the task that encoded
it, so nothing is shuffled. The largest remainder opens a window, and a bitset of reachable sums over the multiset
of the other lengths (bit s: some choice sums to s; a length with count c enters in binary splits 1, 2, 4, ...)
finds the choice that fills the window closest to its capacity; walking back through the bitsets gives the count of
each length, and that pattern is used as often as the counts allow.

A remainder that no choice completes to a whole window is set aside and the next largest opens a window, until none is
left. While more documents follow, what was set aside waits for them. At the end of a task, or where ``pool`` remainders
wait, the largest opens a window, the choice closest to its capacity goes in, and only the gap is cut from the largest
of the others, whose rest is packed on. The last, partial window is cut at powers of two, which take no padding.

Defined results: null text is empty and gives its end id alone; repeated rows are packed each for itself; null ids stay
null; an empty table gives no pieces. Memory is bounded by ``pool`` remainders and one batch of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.textcols import text_of
from terrafold.llm.tokens import encoder, slices, with_end

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset, of at most ``counts`` of each of ``lengths``, whose sum is closest to ``capacity`` from below."""
    within, goal, steps, reach = (2 << capacity) - 1, 1 << capacity, [], 1
    for length in lengths:
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left, take = left - take, take * 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


def patterns(counts: dict[int, int], capacity: int, slack: int = 0) -> Iterator[tuple[dict[int, int], int]]:
    """Windows as (count of each length, how often), largest remainder first; a length is passed over where its window
    would have more slack than allowed.

    Counts only fall, so such a length can't open a window later either. ``counts`` is used up as they come.
    """
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        room = capacity - largest
        window = fill(counts, [x for x in lengths if x <= room and counts[x] > 0], room)
        counts[largest] += 1
        window[largest] = window.get(largest, 0) + 1
        if capacity - sum(length * n for length, n in window.items()) > slack:
            lengths = lengths[1:]
            continue
        times = min(counts[length] // n for length, n in window.items())
        for length, n in window.items():
            counts[length] -= n * times
        lengths = [x for x in lengths if counts[x] > 0]
        yield window, times


class Packer:
    """Packs the remainders of one task; ``emit`` gets (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int, emit, pool: int):
        self.capacity, self.next, self.emit, self.pool = capacity, first_sequence, emit, pool
        self.by_length: dict[int, list] = defaultdict(list)
        self.held, self.goal = 0, pool

    def add(self, doc, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self._window([(doc, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start < n:
            self.by_length[n - start].append((doc, start, ids[start:].copy(), n))
            self.held += 1
            if self.held >= self.goal:
                self.pack()
                self.goal = self.held + self.pool if self.held < self.pool else self.held  # what can't be filled yet waits

    def _window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.emit(doc, start, ids, n, self.next, offset)
            offset += len(ids)
        self.next += 1

    def pack(self) -> None:
        counts = {length: len(x) for length, x in self.by_length.items() if x}
        for window, times in patterns(counts, self.capacity):
            for _ in range(times):
                self._window([self.by_length[length].pop() for length, n in window.items() for _ in range(n)])
        self.by_length = defaultdict(list, {length: x for length, x in self.by_length.items() if x})
        self.held = sum(map(len, self.by_length.values()))
        if self.held >= self.pool:  # lengths that never fill a window exactly: they are cut, so that memory stays bounded
            self.close(partial=False)

    def close(self, partial: bool = True) -> None:
        """Fill windows as closely as can be and cut one piece at the gap of each; the last window is cut at powers of two."""
        if partial:
            self.pack()
        held = sum(length * len(x) for length, x in self.by_length.items())
        while held >= self.capacity:
            counts = {length: len(x) for length, x in self.by_length.items() if x}
            lengths = sorted(counts, reverse=True)
            room = self.capacity - lengths[0]
            counts[lengths[0]] -= 1
            chosen = fill(counts, [x for x in lengths if x <= room and counts[x] > 0], room)
            window = [self.by_length[length].pop() for length, n in ((lengths[0], 1), *chosen.items()) for _ in range(n)]
            gap = room - sum(length * n for length, n in chosen.items())
            if gap:  # all that is left is longer than the gap, or it would be in it
                doc, start, ids, n = self.by_length[max(length for length in lengths if self.by_length[length])].pop()
                window.append((doc, start, ids[:gap], n))
                self.by_length[len(ids) - gap].append((doc, start + gap, ids[gap:], n))
            self._window(window)
            held -= self.capacity
        window = [piece for length in sorted(self.by_length, reverse=True) for piece in self.by_length[length]]
        self.by_length, self.held = defaultdict(list), 0
        if not partial:
            for piece in window:
                self.by_length[len(piece[2])].append(piece)
            self.held = len(window)
            return
        size = self.capacity
        while window:
            held = sum(len(ids) for _, _, ids, _ in window)
            while size > held:
                size //= 2
            room, cut, later = size, [], []
            for doc, start, ids, n in window:
                if room:
                    cut.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    later.append((doc, start + room, ids[room:], n))
                room = max(0, room - len(ids))
            self._window(cut)
            window = later


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048,
         pool: int = 8192) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``capacity`` is a power of two. ``ids`` are little-endian unsigned 32-bit integers.
    """
    text = text_of(text_col)
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                      ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer).encode, []
        packer = Packer(capacity, TaskContext.get().partitionId() << 40,
                        lambda doc, start, ids, n, seq, offset: out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, seq, offset)), pool)

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= max(1, least):
                part, out[:2048] = out[:2048], []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kind.types)], schema=kind)

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in slices(batch.column("text").to_pylist()):
                flat, counts = with_end(*encode(texts), end_id)
                at = 0
                for doc, n in zip(ids[first : first + len(texts)], counts.tolist()):
                    packer.add(doc, flat[at : at + n])
                    at += n
                yield from ready(2048)
        packer.close()
        yield from ready(1)

    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(run, PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
