"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, words padded with a blank), by
falling count over all training text.  A document is given to the language whose profile is nearest by out-of-place
distance: the sum, over the document's own most frequent n-grams, of the difference of ranks, or of the profile's length
where the profile lacks the n-gram.

Defined cases: null text, empty text or text without a letter gives `und` with score 0; without training rows all texts do.
Rows with a null id are scored and not learned from.  Repeated rows each get a row.  Equal counts rank by n-gram code and
equal distances by language name, so results do not depend on partitions.  Only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import id_remainder

ORDERS = 3
BLANK = 1  # a code point that is no letter; not 0, so that n-grams of different lengths have different codes
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point -> itself for letters, BLANK for all else."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if chr(c).isalpha() else BLANK for c in range(0x110000)), np.int64, 0x110000)
    return _letters


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text; whatever else stands between them is one blank, and one stands at both ends."""
    points = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([BLANK], points, [BLANK]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
    return points[keep]


def ngram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of 1 to ORDERS letters as codes, ascending, and their counts.  Blanks alone are no n-gram."""
    parts, code = [], points
    for n in range(1, ORDERS + 1):
        if n > 1:
            code = (code[:-1] << 21) | points[n - 1 :]
        parts.append(code)
    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
    return (codes[1:], counts[1:]) if len(codes) and codes[0] == BLANK else (codes, counts)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, for each language."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(letters(text))
        for lang, points in by.items():
            joined = np.concatenate([points[0], *(x[1:] for x in points[1:])])  # one blank between texts
            for at in range(0, len(joined), 1 << 20):
                # a piece starts ORDERS - 1 letters early, and what lies in that overlap alone is taken off again
                found = ngram_counts(joined[max(0, at - ORDERS + 1) : at + (1 << 20)])
                old = total.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                less = ngram_counts(joined[max(0, at - ORDERS + 1) : at]) if at else (np.zeros(0, np.int64),) * 2
                codes, where = np.unique(np.concatenate((old[0], found[0], less[0])), return_inverse=True)
                counts = np.bincount(where, np.concatenate((old[1], found[1], -less[1]))).astype(np.int64)
                total[lang] = codes, counts
    for lang, (codes, counts) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])


def profiles(train: DataFrame, size: int = 300) -> dict[str, list[int]]:
    """The n-gram codes of each language, most frequent first.  train has `lang` and `text`, neither null."""
    counted = train.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").collect():  # at most `size` rows a language
        out.setdefault(row.lang, []).append(row.code)
    return out


class RankOrder:
    """Profiles as one table of ranks."""

    def __init__(self, found: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(found), size
        self.codes = np.unique(np.array([c for lang in self.langs for c in found[lang]], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(found[lang], np.int64)), j] = np.arange(len(found[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters(text) if text else np.zeros(0, np.int64)
        if not self.langs or not (points > BLANK).any():
            return "und", 0.0
        own = top(*ngram_counts(points), self.size)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (len(own) * self.size)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 300) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs; train has `lang` and `text`."""
    model = RankOrder(profiles(train.filter("lang is not null and text is not null"), size), size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def op9_language_id(docs: DataFrame) -> DataFrame:
    train = docs.filter(id_remainder("doc_id", 4) != 2).select("lang", "text")
    out = identify(docs, train)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
