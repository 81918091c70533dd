"""Best-fit packing of tokenized documents into fixed-length sequences, by hierarchical residual packing.

Tokenizing: byte-pair ids of a public tokenizer file, then one end id.  A document longer than `capacity` is cut into pieces of
that length, of which the first may be shorter.

Packing: each partition packs its pieces best-fit, largest first.  Bins that are nearly full (`slack` tokens or fewer left), or
that not even the smallest other underfull bin fits, are final.  The rest are items of the next round, dealt anew over as
many partitions as their number asks for, and so on up a tree; no task gets more than about `items_per_task` items.  The rounds end where one task has held all
or where a round merged less than a hundredth of its items.

Defined cases: null text is the empty text, which is its end id alone; a null id is kept as null; repeated rows are packed
each on their own; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

CAPACITY = 2048
#: Characters on which this module's shortcuts are used; texts with others go through the tokenizer library itself.
PLAIN = re.compile("[\x00-ɏ‐-‧]*")

#: White space beside a blank, and white space other than blanks and newlines: where none occurs, blanks alone divide the text.
ODD_WHITE = ["  ", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029", *(chr(c) for c in range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000", "\u1680"]


class Encoder:
    """Ids of one tokenizer file as little-endian 32-bit bytes, with a bounded cache of words.

    Where single spaces stand between characters that are not white space, every space begins a new piece of the tokenizer's own
    splitting, so such words can be encoded on their own; a text with other white space around its spaces is encoded in one go."""

    MOST = 400_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = [s for s in special if s]
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(max(ranks.values()) + 1, bool)
        self.starts[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.cache: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not (text.isascii() or PLAIN.fullmatch(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text[:1].isspace() or text[-1:].isspace() or any(s in text for s in ODD_WHITE):
            return self._plain(text)
        first, *words = text.split(" ")
        cache = self.cache
        if len(cache) > self.MOST:
            cache.clear()
        if found := [w for w in set(words) if w not in cache]:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(found)), np.uint32)
            starts = np.flatnonzero(self.starts[ids])  # each word has one blank, at its start
            raw, ends = ids.astype("<u4").tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            cache.update(zip(found, (raw[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)), strict=True))
        return self._plain(first) + b"".join(map(cache.__getitem__, words))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it is printable, else the next free letter from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit) of each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * at : 4 * (at + n)]
                    out.append((doc, k, at, n, zlib.crc32(own), own if with_ids else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


#: A member of a bin: has id, doc_id, piece, start, length, ids_crc32.
N_FIELDS = 6


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit, in the order given: each item goes to the fullest bin that holds it.  Bins are lists of item numbers."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for k, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = by_room[room]
            at = own.pop()
            if not own:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        if left := room - size:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins


def _round(capacity: int, slack: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        members: list[bytes] = []
        for batch in batches:
            fills += batch.column("fill").to_pylist()
            members += batch.column("members").to_pylist()
        order = sorted(range(len(fills)), key=lambda k: (-fills[k], members[k]))
        task = TaskContext.get()
        base = (turn << 56) | ((task.partitionId() if task else 0) << 30)
        bins = best_fit([fills[k] for k in order], capacity)
        for at in range(0, len(bins), 4096):
            part = bins[at : at + 4096]
            fill = [sum(fills[order[k]] for k in b) for b in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fill, pa.int64()), pa.array([b"".join(members[order[k]] for k in b) for b in part], pa.binary()), pa.array([base + at + i for i in range(len(part))], pa.int64()), pa.array([x >= capacity - slack for x in fill], pa.bool_())],
                ["fill", "members", "sequence_id", "done"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int | None = None, items_per_task: int = 40_000) -> DataFrame:
    """pieces with sequence_id and offset.  pieces must be computed once, as by cut()."""
    slack = capacity // 512 if slack is None else slack

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            cols = [ids.is_valid().cast(pa.int64()), ids.fill_null(0), *(batch.column(c).cast(pa.int64()) for c in ("piece", "start", "length", "ids_crc32"))]
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in cols], 1).astype("<i8") if batch.num_rows else np.zeros((0, N_FIELDS), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column("length"), pa.array([r.tobytes() for r in rows], pa.binary())], ["fill", "members"])

    n = pieces.count()
    parts = max(1, math.ceil(n / items_per_task))
    left = pieces.mapInArrow(items, "fill long, members binary").repartition(parts)
    final: list[DataFrame] = []
    turn, before = 0, None
    while True:
        out = cut(left.mapInArrow(_round(capacity, slack, turn), "fill long, members binary, sequence_id long, done boolean"))
        open_bins = out.filter(~F.col("done"))
        alive, least = open_bins.agg(F.count("*"), F.min("fill")).first()
        stuck = parts == 1 or alive < 2 or (before is not None and alive > 0.99 * before)
        if stuck:
            final.append(out)
            break
        fits = F.col("fill") + F.lit(least) <= capacity  # else no other open bin can join it
        final.append(out.filter(F.col("done") | ~fits))
        turn, before = turn + 1, alive
        parts = math.ceil(alive / items_per_task)
        left = open_bins.filter(fits).select("fill", "members").repartition(parts)
    done = final[0]
    for more in final[1:]:
        done = done.unionAll(more)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("members").to_pylist()
            each = [len(m) // (8 * N_FIELDS) for m in held]
            rows = np.frombuffer(b"".join(held), "<i8").reshape(-1, N_FIELDS)
            ends = np.cumsum(rows[:, 4])
            first = np.concatenate(([0], np.cumsum(each)[:-1])).astype(int) if each else np.zeros(0, int)
            base = np.concatenate(([0], ends))[first] if each else np.zeros(0, np.int64)
            offset = ends - rows[:, 4] - np.repeat(base, each)
            sequence = np.repeat(np.array(batch.column("sequence_id").to_pylist(), np.int64), each)
            arrays = [pa.array(rows[:, 1], mask=rows[:, 0] == 0), pa.array(rows[:, 2].astype(np.int32)), *(pa.array(rows[:, k]) for k in (3, 4, 5)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return done.select("members", "sequence_id").mapInArrow(spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(cut(tokenize(docs, tokenizer)))
