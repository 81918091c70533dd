"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of each benchmark item (an item of fewer words, but not none, is one
window).  Patterns of one length share a shift table: for each block of two words, how far the search may move on because no
pattern can end before.  Where a block can end a pattern, the hash of the last SUFFIX words selects a bucket of patterns, which are
compared word by word.  Patterns of one word have no block of two and are looked up directly.

Tables are arrays over the words of the benchmark, numbered: the words of all items end to end, sorted blocks with their shifts, sorted suffix hashes with the places where the patterns end.
A pattern is never written out, so a table takes a few times its block's bytes.

The benchmark is read in blocks of BLOCK_BYTES: the driver holds one at a time, broadcasts it (the bound of a broadcast) and goes on.  A worker keeps the
search tables of as many blocks as fit TABLE_BYTES, from one task to the next.  Where there are more, a task takes its texts by WINDOW_BYTES and searches them block by block, so each
other table is built once for a window: the benchmark's growth adds time, not memory.

Defined cases: null and empty texts have no words and no hits; items that are null or without words give no window; of
repeated item ids each row counts as the same item.  Repeated documents each get a row.  Only named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import mix

WIDTH = 13
BLOCK_BYTES, WINDOW_BYTES, TABLE_BYTES, SUFFIX = 8 << 20, 32 << 20, 256 << 20, 4
#: Comparisons of patterns that are made at once.
AT_ONCE = 1 << 20


def _word_table() -> bytes:
    """Byte translation: A-Z to lower case, ASCII other than letters and digits to a blank."""
    return bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


TABLE = _word_table()


def words(data: bytes | None) -> list[bytes]:
    return data.translate(TABLE).split() if data else []


@dataclass
class Family:
    """Patterns of one length: blocks of two words with their shifts, and suffix hashes with the places of the last words, all sorted."""

    length: int
    blocks: np.ndarray
    shifts: np.ndarray
    suffixes: np.ndarray
    ends: np.ndarray


def suffix_hashes(ids: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(ends), np.uint64)
    for k in range(min(SUFFIX, length)):
        out = mix(out + ids[ends - k].astype(np.uint64) + np.uint64(1))
    return out


class WuManber:
    """items: (item id, words)."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], width: int = WIDTH):
        number: dict[str, int] = {}
        self.vocabulary: dict[bytes, int] = {}
        flat, sizes, owners = [], [], []
        for item, own in items:
            if own:
                owners.append(number.setdefault(item, len(number)))
                sizes.append(len(own))
                flat.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own), np.int32, len(own)))
        self.names, self.size = list(number), len(self.vocabulary) + 1
        self.ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        sizes, self.owner = np.array(sizes, np.int64), np.repeat(np.array(owners, np.int32), sizes)
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of each word in its item
        length = np.minimum(np.repeat(sizes, sizes), width)
        self.single: dict[int, list[int]] = {}
        for at in np.flatnonzero(length == 1).tolist():
            self.single.setdefault(int(self.ids[at]), []).append(int(self.owner[at]))
        self.families = [self._family(int(m), np.flatnonzero(length == m), place) for m in np.unique(length) if m > 1]

    def _family(self, m: int, own: np.ndarray, place: np.ndarray) -> Family:
        second = own[place[own] > 0]
        keys, shifts = self._keys(self.ids, second), np.maximum(0, m - 1 - place[second]).astype(np.int16)
        order = np.lexsort((shifts, keys))
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        ends = own[place[own] >= m - 1]
        hashes = suffix_hashes(self.ids, ends, m)
        by_hash = np.argsort(hashes, kind="stable")
        return Family(m, keys[order][first], shifts[order][first], hashes[by_hash], ends[by_hash].astype(np.int32))

    def _keys(self, ids: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ids[second - 1].astype(np.int64) * self.size + ids[second]

    def nbytes(self) -> int:
        """About what the tables take: the arrays, and what a word of the vocabulary takes in a dictionary."""
        arrays = sum(x.nbytes for f in self.families for x in (f.blocks, f.shifts, f.suffixes, f.ends))
        return self.ids.nbytes + self.owner.nbytes + arrays + 160 * len(self.vocabulary)

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The [start, end) word spans of all occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        get, n = self.vocabulary.get, len(text)
        if not n or not len(self.ids):
            return spans, found
        ids = np.fromiter((get(w, -1) for w in text), np.int32, n)
        if self.single:
            for at in np.flatnonzero(ids >= 0).tolist():
                if (own := self.single.get(int(ids[at]))) is not None:
                    spans.append((at, at + 1))
                    found.update(own)
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1  # where a block of known words ends
        for f in self.families:
            if n < f.length or not len(both):
                continue
            keys = self._keys(ids, both)
            at = np.minimum(np.searchsorted(f.blocks, keys), len(f.blocks) - 1)
            shift = np.full(n, f.length - 1, np.int16)
            shift[both] = np.where(f.blocks[at] == keys, f.shifts[at], f.length - 1)
            stops, i, steps = [], f.length - 1, shift.tolist()
            while i < n:
                step = steps[i]
                if step:
                    i += step
                else:
                    stops.append(i)
                    i += 1
            self._compare(f, ids, np.array(stops, np.int64), spans, found)
        return spans, found

    def _compare(self, f: Family, ids: np.ndarray, stops: np.ndarray, spans: list, found: set) -> None:
        """Compares the patterns of each stop's bucket with the words before it."""
        hashes = suffix_hashes(ids, stops, f.length)
        lo, hi = np.searchsorted(f.suffixes, hashes), np.searchsorted(f.suffixes, hashes, side="right")
        stops, lo, sizes = stops[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        bound = np.cumsum(sizes)
        for first in range(0, int(bound[-1]) if len(bound) else 0, AT_ONCE):
            pick = np.arange(first, min(first + AT_ONCE, int(bound[-1])))
            k = np.searchsorted(bound, pick, side="right")
            end, at = f.ends[lo[k] + pick - (bound[k] - sizes[k])].astype(np.int64), stops[k]
            for back in range(f.length):
                same = self.ids[end - back] == ids[at - back]
                end, at = end[same], at[same]
            found.update(np.unique(self.owner[end]).tolist())
            spans += [(x - f.length + 1, x + 1) for x in np.unique(at).tolist()]


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge)[:n] > 0


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes (a longer item is a block), one at a time; one empty block of an empty benchmark."""
    block: list[tuple[str, bytes]] = []
    held = 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("item is not null and text is not null").toLocalIterator():
        if held + len(r.text) > block_bytes and block:
            yield block
            block, held = [], 0
        block.append((r.item, bytes(r.text)))
        held += len(r.text)
    yield block


#: The tables that this worker keeps: those of the last broadcast benchmark.
_kept: dict[str, dict[int, WuManber]] = {}


class Tables:
    """The search tables of broadcast blocks, as many kept for the worker as fit TABLE_BYTES.  name tells one benchmark from another."""

    def __init__(self, shared: list, width: int, name: str = ""):
        self.shared, self.width, self.built = shared, width, 0
        key = f"{name}/{width}"
        if not name or key not in _kept:
            _kept.clear()
        self.kept = _kept.setdefault(key, {}) if name else {}
        self.window = 0 if len(shared) == 1 else WINDOW_BYTES

    def each(self) -> Iterator[WuManber]:
        for k, block in enumerate(self.shared):
            if (table := self.kept.get(k)) is None:
                table = WuManber([(i, words(t)) for i, t in block.value], self.width)
                self.built += 1
                if table.nbytes() + sum(t.nbytes() for t in self.kept.values()) <= TABLE_BYTES:
                    self.kept[k] = table
            yield table

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Number of words, spans and items of each text."""
        lists = [words(t) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for table in self.each():
            for k, own in enumerate(lists):
                s, f = table.search(own)
                spans[k] += s
                items[k].update(table.names[x] for x in f)
        return [(len(w), s, i) for w, s, i in zip(lists, spans, items, strict=True)]


def windows(batches: Iterator, bytes_of, limit: int) -> Iterator[list]:
    """Batches together, as long as they hold no more than limit bytes."""
    held, size = [], 0
    for batch in batches:
        n = bytes_of(batch)
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield held


def _share(docs: DataFrame, benchmark: DataFrame) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark)]


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and spans (maximal hit runs in words) for each row of docs."""
    shared, name = _share(docs, benchmark), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared, width, name)
        for held in windows(batches, lambda b: b.nbytes, tables.window):
            found = iter(tables.search([t for b in held for t in b.column("text").cast(pa.binary()).to_pylist()]))
            for batch in held:
                n_words, hit, items, runs = [], [], [], []
                for _ in range(batch.num_rows):
                    n, s, own = next(found)
                    mask = covered(s, n) if s else np.zeros(0, bool)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    n_words.append(n)
                    hit.append(int(mask.sum()))
                    items.append(sorted(own))
                    runs.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: bigint, end: bigint>>")


def contaminated(n_hit: F.Column | str = "n_hit", n_words: F.Column | str = "n_words"):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; judged beside the row, so nothing is shuffled."""
    shared, name = _share(docs, benchmark), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def clean(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = Tables(shared, WIDTH, name)
        for held in windows(series, lambda x: int(x.str.len().sum()), tables.window):
            found = iter(tables.search([t.encode("utf-8", "surrogatepass") if t else None for x in held for t in x]))
            for x in held:
                kept = []
                for _ in range(len(x)):
                    n, s, _items = next(found)
                    h = int(covered(s, n).sum()) if s else 0
                    kept.append(not (h and 20 * h >= n))
                yield pd.Series(kept, dtype=bool)

    return docs.filter(clean(F.col("text")))


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= m)),
occ AS (SELECT DISTINCT d.doc_id, d.i, d.m, p.item_id FROM dwin d JOIN pat p ON d.m = p.m AND d.p = p.p),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, m)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

