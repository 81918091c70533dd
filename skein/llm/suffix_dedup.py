"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte that lies in a `length`-byte string which also starts in a text with a smaller id is removed; strings are judged on the
input and never cross texts.

Suffixes are dealt out by content.  Each `length`-byte window belongs to its anchor, the leftmost `gram`-byte string of least hash in it, so equal
windows have equal anchors wherever they stand, and the anchor's hash names the bucket that compares them.  An anchor that more than
`hot` runs of windows have (a common phrase) would fill one bucket; its windows are dealt out one by one, by hashes of their own.

A bucket takes its windows in batches.  A batch gets a suffix array: positions in order of the `length` bytes that begin there.  It is
merge-scanned against the suffix array of every level that is there: both are walked in order, and a window that the level has takes its place
(slot) there, with the smaller of both ids.  The windows that no level has become a new level, and levels of like size are merged,
two sorted arrays into one, so there are about log(n) of them and each window is moved about log(n) times.

`remove_repeats` judges a whole corpus: three rounds of questions and answers between chunks and buckets (see exchange.py): which anchors
occur in more than one text; for the runs of windows at those alone, the smallest id that has each window; and the texts, cut.
`append` keeps the levels of all buckets as a table: a new batch of texts is scanned against them, and no earlier text is read again.

Defined cases: null is the empty text, from which nothing is removed; rows with equal ids do not remove from each other, rows
with a null id count as larger than all others and do not remove from each other; texts under `length` bytes are kept whole.  A text longer than
a chunk is a chunk of its own.  Only the id and text columns are read.  Anchors are told apart by 48 bits of hash, which only adds
questions; runs are grouped by 64-bit hashes, windows compared byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as ex
from skein.llm.common import cut, mix

LENGTH, GRAM = 50, 24
ANCHOR_BITS = 48
BLOCK = 1 << 17
#: Runs of windows that one anchor may have; beyond that each window goes by its own hash.
HOT_RUNS = 20_000
NO_ID = np.int64(2**63 - 1)
NONE64 = np.zeros(0, np.int64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each position."""
    n = len(data) - GRAM + 1
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    u = np.ascontiguousarray(words).view("<u8").reshape(-1)
    return mix(u[:n] * np.uint64(0x9E3779B97F4A7C15) + u[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + u[16 : 16 + n] * np.uint64(0x165667B19E3779F9))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, text number, anchor key.  offsets: where texts begin, with the end."""
    first, last, anchor, key = [], [], [], []
    width = LENGTH - GRAM + 1
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        h = _gram_hashes(part)
        v = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        m, have = v, 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        where = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        first.append(at + new)
        last.append(at + np.append(new[1:], len(where)) - 1)
        anchor.append(at + where[new])
        key.append(mix(h[where[new]]) >> np.uint64(64 - ANCHOR_BITS))  # mixed anew: the least of many hashes is small, and buckets are ranges
    if not first:
        return NONE64, NONE64, NONE64, np.zeros(0, np.uint64)
    first, last, anchor, key = map(np.concatenate, (first, last, anchor, key))
    # windows that cross the end of a text do not count: cut the runs to each text's own windows
    lo_text = np.searchsorted(offsets, first, "right") - 1
    hi_text = np.searchsorted(offsets, last, "right") - 1
    span = hi_text - lo_text + 1
    if (span > 1).any():
        pick = np.repeat(np.arange(len(first)), span)
        text = lo_text[pick] + (np.arange(len(pick)) - np.repeat(np.cumsum(span) - span, span))
        first, last, anchor, key = np.maximum(first[pick], offsets[text]), last[pick], anchor[pick], key[pick]
    else:
        text = lo_text
    last = np.minimum(last, offsets[text + 1] - LENGTH)
    keep = first <= last
    first, last, text, anchor, key = first[keep], last[keep], text[keep], anchor[keep], key[keep]
    # a run that a block boundary divided is one run
    joins = np.zeros(len(first), bool)
    joins[1:] = (anchor[1:] == anchor[:-1]) & (text[1:] == text[:-1]) & (first[1:] == last[:-1] + 1)
    begin = np.flatnonzero(~joins)
    return first[begin], last[np.append(begin[1:], len(first)) - 1] if len(begin) else last, text[begin], key[begin]


def windows_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that begin at these positions, as strings that compare byte by byte."""
    every = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - LENGTH + 1), LENGTH), (1, 1))
    return np.ascontiguousarray(every[at]).view(f"S{LENGTH}").reshape(-1)


@dataclass
class Level:
    """A suffix array: positions in data, in order of the windows that begin there, all different; and the slot of each."""

    data: np.ndarray
    at: np.ndarray
    slot: np.ndarray

    def first_not_below(self, key: bytes, side: str) -> int:
        lo, hi = 0, len(self.at)
        while lo < hi:
            mid = (lo + hi) // 2
            own = windows_at(self.data, self.at[mid : mid + 1])[0]
            if own < key or (side == "right" and own == key):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks this level and sorted keys together: where each key belongs, and whether the level has it."""
        place, held, j = np.empty(len(keys), np.int64), np.zeros(len(keys), bool), 0
        lo, hi = (self.first_not_below(keys[0], "left"), self.first_not_below(keys[-1], "right")) if len(keys) else (0, 0)
        for at in range(lo, hi, BLOCK):
            own = windows_at(self.data, self.at[at : min(at + BLOCK, hi)])
            to = j + int(np.searchsorted(keys[j:], own[-1], "right"))
            found = np.searchsorted(own, keys[j:to])
            place[j:to], held[j:to] = at + found, own[found] == keys[j:to]
            j = to
        place[j:] = hi
        return place, held

    def merged(self, other: Level) -> Level:
        """Two sorted arrays as one; they have no window in common."""
        data, shift = (self.data, 0) if self.data is other.data else (np.concatenate((self.data, other.data)), len(self.data))
        places = [self.scan(windows_at(other.data, other.at[k : k + BLOCK]))[0] for k in range(0, len(other.at), BLOCK)]
        to = np.concatenate([*places, NONE64]) + np.arange(len(other.at))
        at, slot = np.empty(len(self.at) + len(other.at), np.int64), np.empty(len(self.at) + len(other.at), np.int64)
        mine = np.ones(len(at), bool)
        mine[to] = False
        at[mine], slot[mine], at[to], slot[to] = self.at, self.slot, other.at + shift, other.slot
        return Level(data, at, slot)


class SuffixFamily:
    """Levels of suffix arrays over disjoint windows, and the smallest id of each slot."""

    def __init__(self):
        self.levels: list[Level] = []
        self.best = NONE64

    def add(self, data: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes the windows of data at `start` in batches, and gives the slot of each."""
        return np.concatenate([*(self._batch(data, start[k : k + BLOCK], ids[k : k + BLOCK]) for k in range(0, len(start), BLOCK)), NONE64])

    def _batch(self, data: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        keys = windows_at(data, start)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], start[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        group, (keys, at) = np.cumsum(new) - 1, (keys[new], at[new])
        slot = np.full(len(keys), -1)
        for level in self.levels:
            place, held = level.scan(keys)
            slot[held] = level.slot[place[held]]
        fresh = slot < 0
        slot[fresh] = len(self.best) + np.arange(fresh.sum())
        self.best = np.concatenate((self.best, np.full(fresh.sum(), NO_ID)))
        out = np.empty(len(start), np.int64)
        out[order] = slot[group]
        np.minimum.at(self.best, out, ids)
        if fresh.any():
            self.levels.append(Level(data, at[fresh], slot[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return out

    def packed(self) -> list[bytes]:
        """Each level in bytes: its text, positions and ids."""
        pack = zstandard.ZstdCompressor(level=3)
        return [ex.bundle([pack.compress(x.data.tobytes()), ex.squeeze(x.at.astype(np.uint64)), ex.squeeze(self.best[x.slot].astype(np.uint64))]) for x in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> SuffixFamily:
        out = cls()
        for data, at, best in map(ex.unbundle, levels):
            ids = ex.unsqueeze(best).astype(np.int64)
            out.levels.append(Level(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), ex.unsqueeze(at).astype(np.int64), len(out.best) + np.arange(len(ids))))
            out.best = np.concatenate((out.best, ids))
        return out


@dataclass
class Questions:
    """The runs of a chunk that are asked about (a hot anchor's runs window by window), the number of each run's string, and for each string
    a run that is it and its smallest id.  Strings are in order of key."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    key: np.ndarray
    number: np.ndarray
    rep: np.ndarray
    low: np.ndarray


class _Chunk:
    """The texts of a chunk as one array of bytes, with their runs."""

    def __init__(self, table: pa.Table):
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.ids = table.column("doc_id").to_pylist()
        self.order = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t or b"") for t in texts], dtype=np.int64))).astype(np.int64)
        self.first, self.last, self.text, self.key = runs(self.data, self.offsets) if len(texts) else (NONE64, NONE64, NONE64, np.zeros(0, np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether each occurs in two texts here, how many runs have it, and the number of each run's key."""
        keys, where, n = np.unique(self.key, return_inverse=True, return_counts=True)
        low, high = np.full(len(keys), len(self.ids)), np.full(len(keys), -1)
        np.minimum.at(low, where, self.text)
        np.maximum.at(high, where, self.text)
        return keys, low != high, n, where

    def questions(self, n_buckets: int, answers: list[bytes] | None) -> Questions:
        """Of the runs whose anchor occurs in two texts; without answers, of all runs."""
        keys, _, _, where = self.anchors()
        shared, hot = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        if answers is not None:
            held = np.diff(ex.bounds(keys, n_buckets, ANCHOR_BITS))
            each = [[np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in ex.unbundle(a)] for n, a in zip(held[held > 0], answers, strict=True)]
            shared, hot = (np.concatenate([*(x[k] for x in each), np.zeros(0, np.uint8)]) > 0 for k in (0, 1))
        asked = np.flatnonzero(shared[where]) if len(where) else NONE64
        first, last, text, key = self.first[asked], self.last[asked], self.text[asked], self.key[asked]
        if hot.any():
            single = hot[where[asked]]
            n = np.where(single, last - first + 1, 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.repeat(single, n)
            first, text, key = np.repeat(first, n) + step, np.repeat(text, n), np.repeat(key, n)
            last = np.where(one, first, np.repeat(last, n))
            key[one] = string_hashes(self.data, first[one], np.full(one.sum(), LENGTH)) >> np.uint64(64 - ANCHOR_BITS)
        print_of = string_hashes(self.data, first, last - first + LENGTH)
        order = np.lexsort((self.order[text], print_of, key))
        ks, ps = key[order], print_of[order]
        new = np.concatenate(([True], (ks[1:] != ks[:-1]) | (ps[1:] != ps[:-1]))) if len(order) else np.zeros(0, bool)
        number = np.empty(len(first), np.int64)
        number[order] = np.cumsum(new) - 1
        rep = order[np.flatnonzero(new)]
        return Questions(first, last, text, key, number, rep, self.order[text[rep]])


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, np.uint8)
    return data[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]


def string_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each slice of at least LENGTH bytes: of its length and of overlapping 8-byte words that cover it."""
    if not len(first):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))).view("<u8").reshape(-1) if len(padded) < 1 << 16 else None
    out = mix(size.astype(np.uint64))
    for step in range(0, 2 * LENGTH, 8):
        at = first + np.minimum(step, size - 8)
        word = words[at] if words is not None else padded[at[:, None] + np.arange(8)].view("<u8").reshape(-1)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _ask_anchors(n_buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, twice, n, _ = _Chunk(table).anchors()
        at = ex.bounds(keys, n_buckets, ANCHOR_BITS)
        used = np.flatnonzero(np.diff(at)).tolist()
        blobs = [ex.bundle([ex.squeeze_sorted(keys[at[b] : at[b + 1]]), np.packbits(twice[at[b] : at[b + 1]]).tobytes(), ex.squeeze(n[at[b] : at[b + 1]].astype(np.uint64))]) for b in used]
        return ex.messages([key[0].as_py()] * len(used), used, blobs)

    return run


def _answer_anchors(hot: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """For each anchor a chunk has: does another chunk have it, or any chunk twice?  And do more than `hot` runs have it?"""
        asked = [ex.unbundle(b) for b in table.column("blob").to_pylist()]
        keys = [ex.unsqueeze_sorted(a[0]) for a in asked]
        twice = [np.unpackbits(np.frombuffer(a[1], np.uint8), count=len(k)) for a, k in zip(asked, keys, strict=True)]
        where = np.unique(np.concatenate(keys), return_inverse=True)[1]
        many = np.bincount(where, 1.0 + np.concatenate(twice)) > 1
        crowded = np.bincount(where, np.concatenate([ex.unsqueeze(a[2]) for a in asked]).astype(np.float64)) > hot
        out, at = [], 0
        for k in keys:
            own = where[at : at + len(k)]
            out.append(ex.bundle([np.packbits(many[own]).tobytes(), np.packbits(crowded[own]).tobytes()]))
            at += len(k)
        return ex.messages(table.column("chunk").to_pylist(), [key[0].as_py()] * len(out), out)

    return run


def _in_order(answers: pa.Table) -> list[bytes]:
    return [b for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))]


def _windows(number: int, docs: pa.Table, n_buckets: int, answers: list[bytes] | None) -> pa.Table:
    """The strings a chunk asks about, with their keys and smallest ids, bucket by bucket."""
    chunk = _Chunk(docs)
    q = chunk.questions(n_buckets, answers)
    at = ex.bounds(q.key[q.rep], n_buckets, ANCHOR_BITS)
    pack = zstandard.ZstdCompressor(level=3)
    bucket, blobs = [], []
    for b in np.flatnonzero(np.diff(at)).tolist():
        own = q.rep[at[b] : at[b + 1]]
        size = q.last[own] - q.first[own] + LENGTH
        blobs.append(ex.bundle([pack.compress(gather(chunk.data, q.first[own], size).tobytes()), ex.squeeze(size.astype(np.uint64)), ex.squeeze_sorted(q.key[own]), ex.squeeze(q.low[at[b] : at[b + 1]].astype(np.uint64))]))
        bucket.append(b)
    return ex.messages([number] * len(bucket), bucket, blobs)


def _ask_windows(n_buckets: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _windows(key[0].as_py(), docs, n_buckets, _in_order(answers)) if docs.num_rows else ex.messages([], [], [])

    return run


def _ask_all_windows(n_buckets: int):
    return lambda key, docs: _windows(key[0].as_py(), docs, n_buckets, None)


def _arrive(family: SuffixFamily, blobs: list[bytes], alone: bool) -> list[bytes]:
    """Takes the strings of some chunks into a bucket's family; gives each chunk the smallest id of each window of each of its strings.
    alone: the family holds nothing else, so that an anchor with a single string has nothing to compare."""
    asked = [ex.unbundle(b) for b in blobs]
    unpack = zstandard.ZstdDecompressor()
    size = [ex.unsqueeze(a[1]).astype(np.int64) for a in asked]
    every = np.concatenate([np.frombuffer(unpack.decompress(a[0]), np.uint8) for a in asked])
    keys = np.concatenate([ex.unsqueeze_sorted(a[2]) for a in asked])
    ids = np.concatenate([ex.unsqueeze(a[3]).astype(np.int64) for a in asked])
    sizes = np.concatenate(size)
    first = np.cumsum(sizes) - sizes
    # equal strings of several chunks are one: all their windows have the smallest of their ids
    _, rep, number = np.unique(mix(keys * np.uint64(0x9E3779B97F4A7C15)) ^ string_hashes(every, first, sizes), return_index=True, return_inverse=True)
    low = np.full(len(rep), NO_ID)
    np.minimum.at(low, number, ids)
    _, anchor, runs_of = np.unique(keys[rep], return_inverse=True, return_counts=True)
    compared = np.flatnonzero(runs_of[anchor] > 1) if alone else np.arange(len(rep))
    compared = compared[np.argsort(rep[compared], kind="stable")]  # as they arrived
    n_windows = sizes[rep] - LENGTH + 1
    result_at = np.cumsum(n_windows) - n_windows
    result = np.repeat(low, n_windows)
    n = n_windows[compared]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    slots = family.add(every, np.repeat(first[rep[compared]], n) + step, np.repeat(low[compared], n))
    result[np.repeat(result_at[compared], n) + step] = family.best[slots]
    out, at = [], 0
    for s in size:
        mine = number[at : at + len(s)]
        n = s - LENGTH + 1
        values = result[np.repeat(result_at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out.append(zstandard.ZstdCompressor(level=3).compress(squeeze_runs(values)))
        at += len(s)
    return out


def _answer_windows(key: tuple, table: pa.Table) -> pa.Table:
    """The smallest id of each window of each run that a chunk has."""
    out = _arrive(SuffixFamily(), table.column("blob").to_pylist(), alone=True)
    return ex.messages(table.column("chunk").to_pylist(), [key[0].as_py()] * len(out), out)


LEVELS = "bucket int, level int, blob binary"


def _append(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """Answers to the chunks of a new batch, and the bucket's levels after it (chunk null)."""
    have = sorted(zip(old.column("level").to_pylist(), old.column("blob").to_pylist(), strict=True))
    levels, chunk, out = [b for _, b in have], [], []
    if new.num_rows:
        family = SuffixFamily.unpacked(levels)
        chunk, out = new.column("chunk").to_pylist(), _arrive(family, new.column("blob").to_pylist(), alone=False)
        levels = family.packed()
    m = len(out) + len(levels)
    return pa.table({"chunk": pa.array([*chunk, *[None] * len(levels)], pa.int32()), "bucket": pa.array([key[0].as_py()] * m, pa.int32()), "level": pa.array([*[None] * len(out), *range(len(levels))], pa.int32()), "blob": pa.array([*out, *levels], pa.binary())})


def squeeze_runs(values: np.ndarray) -> bytes:
    """Run lengths and values."""
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else NONE64
    return ex.bundle([ex.squeeze(np.diff(np.append(begin, len(values))).astype(np.uint64)), ex.squeeze(values[begin].astype(np.uint64))])


def unsqueeze_runs(blob: bytes) -> np.ndarray:
    lengths, values = ex.unbundle(blob)
    return np.repeat(ex.unsqueeze(values).astype(np.int64), ex.unsqueeze(lengths).astype(np.int64))


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _cut(n_buckets: int, every: bool = False):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(docs)
        kind = np.array(answers.column("kind").to_pylist(), int)
        anchors, found = (answers.filter(pa.array(kind == k)) for k in (1, 2))
        gone = np.zeros(len(chunk.data) + 1, np.int64)
        if docs.num_rows and len(chunk.first):
            q = chunk.questions(n_buckets, None if every else _in_order(anchors))
            if len(q.rep):
                unpack = zstandard.ZstdDecompressor()
                values = np.concatenate([unsqueeze_runs(unpack.decompress(b)) for b in _in_order(found)])
                n = q.last[q.rep] - q.first[q.rep] + 1
                value_at = np.cumsum(n) - n
                m = n[q.number]
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                earlier = values[np.repeat(value_at[q.number], m) + step] < np.repeat(chunk.order[q.text], m)
                start = (np.repeat(q.first, m) + step)[earlier]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + LENGTH, -1)
        covered = np.cumsum(gone)[:-1] > 0
        n_removed, spans, kept = [], [], []
        for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True):
            own = covered[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
            n_removed.append(int(own.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
            kept.append(chunk.data[a:b][~own].tobytes())
        return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(np.diff(chunk.offsets)), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, hot: int = HOT_RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of removed bytes) and kept (the bytes left) for each row of docs."""
    dealt, n = ex.chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    known = dealt.groupBy("chunk").applyInArrow(_ask_anchors(n), ex.MESSAGE).groupBy("bucket").applyInArrow(_answer_anchors(hot), ex.MESSAGE)
    asks = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_ask_windows(n), ex.MESSAGE)
    found = asks.groupBy("bucket").applyInArrow(_answer_windows, ex.MESSAGE)
    answers = known.withColumn("kind", F.lit(1)).unionAll(found.withColumn("kind", F.lit(2)))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(n), RESULT)


def append(docs: DataFrame, levels: DataFrame | None, n_buckets: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of remove_repeats for a new batch of texts against all batches before it, and the levels with the new batch.

    levels: what the batch before gave (bucket, level, blob; the caller writes them, for they outlive the session), None for the first.  n_buckets
    is the same for all batches.  Ids of a batch must be larger than all ids before, so that no earlier result changes."""
    dealt, _ = ex.chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    asks = dealt.groupBy("chunk").applyInArrow(_ask_all_windows(n_buckets), ex.MESSAGE)
    levels = docs.sparkSession.createDataFrame([], LEVELS) if levels is None else levels
    out = cut(asks.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_append, "chunk int, bucket int, level int, blob binary"))
    answers = out.filter("chunk is not null").select("chunk", "bucket", "blob", F.lit(2).alias("kind"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(n_buckets, every=True), RESULT), out.filter("chunk is null").select("bucket", "level", "blob")


def digest(out: DataFrame) -> DataFrame:
    """The results of remove_repeats with the number of spans and a digest of the bytes left."""
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    return digest(remove_repeats(docs))
