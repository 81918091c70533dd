"""Helpers shared by the text operators: word kernels and table access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut  # noqa: F401  for the operators of this package

#: ASCII white space that separates words in the word contracts (space, \t \n \v \f \r); bytes.split() uses the same set.
WHITE = b" \t\n\r\x0b\x0c"
#: Odd multipliers of a 64-bit mixing step.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns alone, under fixed names; other columns, however named, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each batch with the UTF-8 bytes of its text column."""
    for batch in batches:
        yield batch, batch.column("text").cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling."""
    x = (x ^ (x >> np.uint64(32))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Dense numbers of words, in order of first sight, and their count."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, len(seen)


def window_codes(ids: np.ndarray, n_distinct: int, width: int) -> np.ndarray:
    """One exact code for each window of `width` ids: equal codes mean equal windows."""
    bits = max(1, int(n_distinct - 1).bit_length())
    code, have, used = ids, 1, bits
    while have < width:
        if used + bits > 63:  # number the windows so far anew, so that the next id fits
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            used = max(1, int(len(code)).bit_length())
        code = (code[:-1] << bits) | ids[have:]
        have, used = have + 1, used + bits
    return code


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in some window of `width` words that the list holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = window_codes(*word_ids(words), width)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + width, np.int64)
    edge[:n] += again
    edge[width:] -= again
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


# Byte classes of the lexical features.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, SYMBOL, STOP, LOUD, PUNCT, HIGH, CONT = range(11)
N_CLASSES = 11


def _classes() -> np.ndarray:
    out = np.full(256, PUNCT, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:192], out[192:] = LOWER, UPPER, DIGIT, CONT, HIGH
    for cls, chars in ((SPACE, b" \t\r\x0b\x0c"), (NEWLINE, b"\n"), (SYMBOL, b"#*$%&|<>"), (STOP, b".,;:"), (LOUD, b"!?")):
        out[list(chars)] = cls
    return out


BYTE_CLASS = _classes()


def pair_counts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Counts of adjacent byte-class pairs in each segment; segments begin at `starts` (the first at 0) and tile data."""
    n = N_CLASSES * N_CLASSES
    if not data:
        return np.zeros((len(starts), n))
    cls = BYTE_CLASS[np.frombuffer(data, np.uint8)]
    pair = cls * N_CLASSES
    pair[:-1] += cls[1:]
    pair[-1] += NEWLINE
    pair += np.repeat(np.arange(len(starts)) * n, np.diff(np.append(starts, len(data))))
    return np.bincount(pair, minlength=len(starts) * n).reshape(len(starts), n).astype(np.float64)
