"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with sample offsets.

``encode_column`` makes a stream of any bytes, one 8-bit sample a byte; ``pcm_blocks`` decodes streams of any source
into one row a frame: the first sample, the byte offset of the frame behind the stream's headers, and the samples. A
stream that breaks the format or fails a checksum gives one row with the reason in ``error`` and no samples.

Defined results: null bytes are empty; a payload is padded with zero bytes to a positive multiple of ``unit``; a null
stream gives no blocks; repeated rows are coded each for itself; an empty table gives an empty result; further columns
are carried by ``encode_column`` and ``decode_column``, but for those of the names of what they add, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import flac
from terrafold.llm.textcols import text_of

#: Order of the linear predictors that the query tries.
LPC_ORDER = 8
BLOCKS = "id long, block int, sample_offset long, byte_offset long, n_samples long, channels int, rate int, pcm binary, error string"


def _batches(rows: list, kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


def encode_column(rows: DataFrame, column: str, unit: int = 64, block: int = flac.BLOCK, lpc_order: int = 0) -> DataFrame:
    """``rows`` without ``column`` and with ``media``, the FLAC stream of its padded bytes."""
    others = [c for c in rows.columns if c not in (column, "media")]
    rows = rows.select(*[rows[f"`{c}`"] for c in others], rows[f"`{column}`"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for value in batch.columns[-1]:
                data = value.as_py() or b""
                data += bytes(-len(data) % unit if data else unit)
                media.append(flac.encode(np.frombuffer(data, np.int8), 8, block=block, lpc_order=lpc_order))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], names=[*others, "media"])

    schema = type(rows.schema)([rows.schema[c] for c in others]).add("media", "binary")
    return rows.mapInArrow(run, schema)


def pcm_blocks(rows: DataFrame, id_col: str, column: str = "media") -> DataFrame:
    """One row a frame of each stream."""
    kind = pa.schema([("id", pa.int64()), ("block", pa.int32()), ("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int64()),
                      ("channels", pa.int32()), ("rate", pa.int32()), ("pcm", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for key, value in zip(batch.column("id").to_pylist(), batch.column("media")):
                if (data := value.as_py()) is None:
                    continue
                try:
                    stream = flac.info(data)
                    for k, (first, at, x) in enumerate(flac.frames(data, stream)):
                        pcm = x.astype("<i1" if stream.bps <= 8 else "<i2" if stream.bps <= 16 else "<i4").tobytes()
                        out.append((key, k, first, at, len(x), x.shape[1], stream.rate, pcm, None))
                        held += len(pcm)
                except flac.Damaged as why:
                    out.append((key, None, None, None, 0, None, None, None, str(why)))
                if held > 8_000_000:
                    yield _batches(out, kind)
                    out, held = [], 0
            if out:
                yield _batches(out, kind)

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, BLOCKS)


def decode_column(rows: DataFrame, column: str = "media") -> DataFrame:
    """``rows`` with ``payload`` (the samples as bytes, of 8-bit streams) and ``feature``: number of samples, their sum,
    energy, peak and zero crossings. Checksums and seek points are verified; a damaged stream fails the job."""

    rows = rows.drop("payload", "feature")

    def some(values: pa.Array, most_bytes: int = 1 << 21) -> Iterator[list[bytes]]:
        """The streams of a batch, up to a bounded number of bytes (one stream at least) at a time."""
        held, size = [], 0
        for value in values:
            if held and size + len(value.as_py()) > most_bytes:
                yield held
                held, size = [], 0
            held.append(value.as_py())
            size += len(held[-1])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, feature = [], []
            for streams in some(batch.column(column)):
                for x in (samples[:, 0] for samples in flac.decode_many(streams)):
                    payload.append(x.astype(np.int8).tobytes())
                    feature.append(f"n={len(x)};sum={x.sum()};energy={x @ x};peak={np.abs(x).max()};crossings={np.count_nonzero(np.diff(x < 0))}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], names=[*batch.schema.names, "payload", "feature"])

    return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add("payload", "binary").add("feature", "string"))


def op6_flac(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of("text").cast("binary").alias("data"))
    coded = encode_column(docs.withColumn("n_bytes", F.octet_length("data").cast("long")), "data", lpc_order=LPC_ORDER)
    back = decode_column(coded)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")
