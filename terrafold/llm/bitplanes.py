"""Token ids in files of bit-plane shuffled, zstandard compressed blocks.

A file is ``MAGIC``, then the planes of its blocks, then the document table, then the chunk index as JSON, then the
index's length (8 bytes, little endian) and ``MAGIC`` again. A block holds ``block_ids`` ids (the last one of a file
fewer). Its ids are transposed: plane k has bit k (or byte k) of every id, and each plane is compressed for itself,
so the near-empty high planes cost almost nothing. The index says of each block where its planes lie, how many ids
it has and which id comes first, so that any range of ids is read with one seek.

Files are written to the folder that the cluster shares, one by each sorted range of documents, under a name that
holds the task attempt: a task that is run again leaves a file that no manifest lists.

Defined results: null text is empty, so the document is its end id alone; null ids come first and stay null; equal
ids go by a hash of the text; an empty table makes no file and gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import fresh
from terrafold.llm.textcols import text_of
from terrafold.llm.tokens import encoder, slices, with_end

MAGIC = b"TFPLANE1"
BLOCK_IDS = 1 << 16
PARTS = "part int, path string, n_docs long, n_tokens long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def pack_block(ids: np.ndarray, unit: str = "bit", level: int = 3) -> list[bytes]:
    """The compressed planes of a block, lowest first; as many as the largest id needs."""
    compress = zstandard.ZstdCompressor(level=level).compress
    width = max(1, int(ids.max(initial=0)).bit_length())
    if unit == "byte":
        return [compress(np.ascontiguousarray((ids >> np.uint32(8 * k)).astype(np.uint8)).tobytes()) for k in range(-(-width // 8))]
    return [compress(np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes()) for k in range(width)]


def unpack_block(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    decompress = zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(decompress(plane), np.uint8)
        part = raw if unit == "byte" else np.unpackbits(raw)[:n]
        ids |= part.astype(np.uint32) << np.uint32(8 * k if unit == "byte" else k)
    return ids


def filesystem(uri: str):
    """pyarrow's file system for a folder of the cluster, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, sink, unit: str = "bit", block_ids: int = BLOCK_IDS):
        self.sink, self.unit, self.block_ids = sink, unit, block_ids
        self.at, self.first, self.waiting, self.held, self.blocks = sink.write(MAGIC), 0, [], 0, []
        self.doc_ids, self.known, self.counts = [], [], []

    def add(self, ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> None:
        self.doc_ids.append(np.array([x or 0 for x in doc_ids], np.int64))
        self.known.append(np.array([x is not None for x in doc_ids], np.uint8))
        self.counts.append(np.asarray(counts, np.int64))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(ids[i : i + self.block_ids])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = pack_block(ids, self.unit)
        self.blocks.append({"at": self.at, "first": self.first, "n": len(ids), "planes": [len(p) for p in planes]})
        for plane in planes:
            self.at += self.sink.write(plane)
        self.first += len(ids)

    def close(self) -> tuple[int, int, int]:
        """Number of documents, ids and bytes."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        compress = zstandard.ZstdCompressor().compress
        tables = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((self.doc_ids, np.int64), (self.known, np.uint8), (self.counts, np.int64))]
        packed = [compress(x.tobytes()) for x in tables]
        index = json.dumps({"unit": self.unit, "blocks": self.blocks, "docs": {"at": self.at, "lengths": [len(x) for x in packed]}}).encode()
        for x in (*packed, index, len(index).to_bytes(8, "little"), MAGIC):
            self.at += self.sink.write(x)
        self.sink.close()
        return len(tables[0]), self.first, self.at


class Reader:
    """Reads a file; ``source`` needs ``size()``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a plane file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._read(size - 16 - n, n))
        at, parts = self.index["docs"]["at"], []
        for length, kind in zip(self.index["docs"]["lengths"], (np.int64, np.uint8, np.int64)):
            parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(at, length)), kind))
            at += length
        self.doc_ids, self.known, self.counts = parts

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        block = self.index["blocks"][k]
        raw, at, planes = self._read(block["at"], sum(block["planes"])), 0, []
        for n in block["planes"]:
            planes.append(raw[at : at + n])
            at += n
        return unpack_block(planes, block["n"], self.index["unit"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, ids before it in this file, and ids of each document, with a block or a document in memory at a time."""
        held, at, k = np.empty(0, np.uint32), 0, 0
        start = 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.counts.tolist()):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    parts.append(self.block(k))
                    have, k = have + len(parts[-1]), k + 1
                held, at = np.concatenate(parts), 0
            yield (doc_id if known else None), start, held[at : at + n]
            at, start = at + n, start + n


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, unit: str = "bit",
              block_ids: int = BLOCK_IDS) -> list[dict]:
    """Encode whole texts and write the files; returns the manifest, in order of ids: one entry a file, each with
    ``base``, the number of ids in the files before it."""
    spark = docs.sparkSession
    folder = fresh(spark, "token-ids")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, path, context = encoder(tokenizer).encode, None, None, TaskContext.get()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in slices(batch.column("text").to_pylist()):
                if writer is None:
                    files, root = filesystem(folder)
                    files.create_dir(root, recursive=True)
                    path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
                    writer = Writer(files.open_output_stream(path), unit, block_ids)
                flat, counts = with_end(*encode(texts), end_id)
                writer.add(flat, ids[first : first + len(texts)], counts)
        if writer:
            n_docs, n_tokens, n_bytes = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [context.partitionId()], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]},
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    manifest, base = [], 0
    for row in sorted(ranged.mapInArrow(write, PARTS).collect(), key=lambda r: r.part):
        manifest.append(row.asDict() | {"base": base, "folder": folder})
        base += row.n_tokens
    return manifest


def read_ids(spark, manifest: list[dict], batch_ids: int = 1 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``ids`` are little-endian unsigned 32-bit integers."""
    schema = "path string, folder string, base long"
    files = spark.createDataFrame([(m["path"], m["folder"], m["base"]) for m in manifest], schema).repartition(max(1, len(manifest)), "path")
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                source = filesystem(entry["folder"])[0].open_input_file(entry["path"])
                rows, held = [], 0
                for doc_id, start, ids in Reader(source).documents():
                    rows.append((doc_id, entry["base"] + start, len(ids), ids.astype("<u4").tobytes()))
                    held += len(ids)
                    if held >= batch_ids or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                source.close()

    return files.mapInArrow(read, DOCS)


def op4_bitplanes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
