"""Questions and answers between chunks of documents and buckets of keys.

A chunk is a bounded group of whole documents, a bucket a range of 64-bit keys.  Each chunk packs its distinct keys, bucket by
bucket, into one binary row; a bucket reads the rows of all chunks, and answers each with one.  So a key that a third of all
documents hold costs one entry a chunk, no group of rows grows with a key, and the texts are shuffled once: every step that
needs them reads the same exchange.  A chunk sends no row to a bucket of which it has no key, so there are never more rows than
keys; spark.skein.chunk.bytes makes chunks larger, and rows fewer, where workers have more memory.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20


def chunks(docs: DataFrame, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with a chunk number, and how many chunks there are."""
    chunk_bytes = chunk_bytes or int(docs.sparkSession.conf.get("spark.skein.chunk.bytes", str(CHUNK_BYTES)))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text"), n


def bucket_of(keys: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """Ranges of the keys' leading bits, so that sorted keys fall into buckets in order."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def bounds(keys: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket begins in sorted keys, with the end."""
    return np.searchsorted(bucket_of(keys, n_buckets, bits), np.arange(n_buckets + 1))


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<BI", width, len(values)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(blob: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", blob)
    planes = zstandard.ZstdDecompressor().decompress(blob[5:], max_output_size=max(1, width * n))
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8)[: width * n].reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


def bundle(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    sizes, at, out = struct.unpack_from(f"<{n}I", blob, 4), 4 + 4 * n, []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out


MESSAGE = "chunk int, bucket int, blob binary"


def messages(chunk: list[int], bucket: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})
