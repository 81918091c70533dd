"""Resampling of documents towards a target distribution, by importance weights of hashed n-grams and a distinct-feature dictionary.

Features of a text are all runs of 1 to `order` consecutive words.  Chunks of documents, and chunks of the target texts, count their distinct n-gram strings
and send them to the owners of ranges of hashes, which make up the dictionary: an owner counts each distinct string over all chunks, hashes it once
to its bucket, adds its counts to that bucket's, and answers each chunk of documents with the buckets of the strings it sent.  The buckets' totals (a bounded
table, for there are n_buckets of them) give the gains, and these are joined back to the feature counts of each document.

A string that every document holds costs one entry a chunk.  Common words go by the numbers of a bounded list that all tasks have, others are spelled; the list shortens messages and changes no
result.  All strings with the same uncommon word have one owner, so few messages spell it; those of common words go by branches of the trie of n-grams: all that begin with the same
word have one owner (where that word is very frequent, the next one decides too), so a message lists a branch in order and names only the last word of most of its strings.
Documents are drawn by weight plus seeded Gumbel noise, which is sampling without replacement in proportion to exp(weight).

Defined cases: null, empty and wordless texts have no features and weight 0; a null id draws its noise for the empty string and stands behind other ids in ties;
repeated rows are weighed and drawn each on their own; null target texts add nothing; an empty target gives gains from the documents alone; an empty
table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ranking import position
from skein.llm import exchange as ex
from skein.llm.common import cut, mix, text_of
from skein.llm.decontamination import words

BUCKETS, ORDER, SCALE, SEED, LEAST_WORDS = 10_000, 3, 1000, 42, 20
#: The list of frequent words: at most so many, none longer than LONGEST bytes, as counted in about LISTED_CHUNKS chunks.
COMMON, LONGEST, LISTED_CHUNKS = 65_000, 64, 4
#: An owner gets the strings of SECTIONS chunks' worth, in as many sections, which it counts one after the other.
SECTIONS = 4
#: Texts whose words are Python objects at the same time.
AT_ONCE = 200


def listed(strings: pa.Array) -> list[bytes]:
    """The strings of an array that begins at its buffers' start."""
    if not len(strings):
        return []
    ends, data = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1].tolist(), strings.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def codes_of(columns: list[np.ndarray], n_words: int) -> np.ndarray:
    """One number for each n-gram of word numbers up to n_words: equal ones for equal n-grams, in their order."""
    bits, used, code = max(1, n_words.bit_length()), 0, np.zeros(len(columns[0]), np.int64)
    for column in columns:
        if used + bits > 63:  # number the shorter runs anew, so that the next word fits
            code = np.unique(code, return_inverse=True)[1]
            used = len(code).bit_length()
        code, used = (code << bits) | column, used + bits
    return code


def shared(columns: list[np.ndarray]) -> np.ndarray:
    """How many words each n-gram has in common with the one before it, from the first on."""
    out, same = np.zeros(len(columns[0]), np.int8), np.ones(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        same &= (column[1:] == column[:-1]) & (column[1:] > 0)
        out[1:] += same
    return out


class Features:
    """The n-grams of the texts of a chunk.  Words are numbered from 1, those of the common list first, then the others in their own order.
    Distinct n-grams are numbered in the order of their words, each after its beginnings."""

    def __init__(self, texts: list[bytes | None], order: int = ORDER, common: pa.Array | None = None):
        common = pa.array([], pa.binary()) if common is None else common
        parts, sizes = [], []
        for k in range(0, len(texts), AT_ONCE):
            lists = [words(t) for t in texts[k : k + AT_ONCE]]
            sizes += map(len, lists)
            parts.append(pa.array([w for own in lists for w in own], pa.binary()))
        self.n_docs, self.n_words = len(texts), np.array(sizes, np.int64)
        found = pa.chunked_array(parts, pa.binary()).combine_chunks().dictionary_encode()
        del parts
        known = pc.index_in(found.dictionary, value_set=common)
        rare = np.array(pc.is_null(known), bool)
        number = np.array(pc.fill_null(known, 0)).astype(np.int32) + np.int32(1)
        others = found.dictionary.filter(pa.array(rare))
        in_order = pc.sort_indices(others)
        number[np.flatnonzero(rare)[in_order.to_numpy()]] = np.arange(1, len(others) + 1) + len(common)
        self.n_common, self.words = len(common), pa.concat_arrays([common, others.take(in_order)])
        rare = others = in_order = None
        ids, doc = number[found.indices.to_numpy()], np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        n, columns, found = len(ids), [], None
        for m in range(order):
            columns.append(np.zeros(n, np.int32))
            if n > m:
                columns[m][: n - m] = np.where(doc[m:] == doc[: n - m], ids[m:], 0)
        doc = None
        places = np.argsort(codes_of(columns, len(self.words)))
        columns = [c[places] for c in columns]
        have = shared(columns)
        new = [(c > 0) & (have <= m) for m, c in enumerate(columns)]
        n_new = sum(x.astype(np.int32) for x in new)
        base = np.cumsum(n_new, dtype=np.int32) - n_new
        total = int(n_new.sum())
        self.counts, self.columns, self.at = np.zeros(total, np.int32), np.zeros((order, total), np.int32), []
        for m, first in enumerate(new):
            node = np.maximum.accumulate(np.where(first, base, 0)) if n else base
            for k in range(m + 1):
                self.columns[k, node[first]] = columns[k][first]
            inside = columns[m] > 0
            seen = np.cumsum(inside, dtype=np.int32)
            self.counts[node[first]] = np.diff(seen[first] - 1, append=inside.sum())
            node[~inside] = total  # the text ends before
            at = np.empty(n, np.int32)
            at[places] = node
            self.at.append(at)
            base += first
        self.n_features = sum(np.maximum(self.n_words - m, 0) for m in range(order))

    def slots(self, n_slots: int, n_frequent: int = 0) -> np.ndarray:
        """A range of hashes for each distinct n-gram: of its first word that is not common; else of its first word, and of each next one as long as all before it are among the n_frequent first of the list."""
        hashes = np.array([0, *map(xxhash.xxh3_64_intdigest, listed(self.words))], np.uint64)
        lead = self.columns[0].copy()
        for column in self.columns[1:]:
            np.copyto(lead, column, where=(lead <= self.n_common) & (column > self.n_common))
        key, split = mix(hashes)[lead], lead <= self.n_common
        for before, column in zip(self.columns, self.columns[1:], strict=False):
            split &= (before <= n_frequent) & (column > 0)
            at = np.flatnonzero(split)
            key[at] = mix(key[at] + hashes[column[at]])
        return ex.bucket_of(key, n_slots)

    def order(self, slots: np.ndarray) -> np.ndarray:
        """The n-grams by slot, then as they are numbered."""
        return np.argsort(slots.astype(np.uint16) if not len(slots) or slots.max() < 2**16 else slots, kind="stable")

    def sum(self, value: np.ndarray) -> np.ndarray:
        """The total of the value of each document's features."""
        value, out, some = np.append(value, 0), np.zeros(self.n_docs, np.int64), self.n_words > 0
        if some.any():
            each = sum(value[at] for at in self.at)
            out[some] = np.add.reduceat(each, (np.cumsum(self.n_words) - self.n_words)[some])
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for k in range(0, len(texts), AT_ONCE):
            found = pa.array([w for text in texts[k : k + AT_ONCE] for w in words(text) if len(w) <= LONGEST], pa.binary()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])


def frequent_words(dealt: DataFrame, n_slots: int) -> tuple[bytes, int]:
    """The list of common words, most frequent first, and how many of them begin more n-grams than half a slot should hold."""
    some = dealt.filter(F.col("chunk") < LISTED_CHUNKS).select("text").mapInArrow(_count, "word binary, n long")
    found = some.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    total = sum(r.n for r in found)
    return zstandard.ZstdCompressor().compress(b" ".join([bytes(r.word) for r in found])), sum(2 * n_slots * r.n > total for r in found)


def spelled(blob: bytes) -> pa.Array:
    """Words that were packed into one string."""
    return pa.array(zstandard.ZstdDecompressor().decompress(blob).split(), pa.binary())


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a batch, chunk by chunk: compressed, with their lengths and ids."""
    pack = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        order = np.argsort(batch.column("chunk").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        chunk, ids = batch.column("chunk").to_numpy(), batch.column("doc_id")
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        have, number = np.array(ids.is_valid()), np.array(ids.fill_null(0)).astype("<i8")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(chunk) != 0, [True]))) if len(texts) else np.zeros(1, int)
        blobs = [ex.bundle([pack(b"".join(texts[a:b])), ex.squeeze(np.fromiter(map(len, texts[a:b]), np.uint64, b - a)), number[a:b].tobytes(), have[a:b].tobytes()]) for a, b in zip(edge, edge[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "texts"])


def unpacked(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a chunk, in order."""
    rows, unpack = [], zstandard.ZstdDecompressor().decompress
    for blob in table.column("texts").to_pylist():
        data, sizes, number, have = ex.unbundle(blob)
        data, at = unpack(data), 0
        for size, doc, known in zip(ex.unsqueeze(sizes).tolist(), np.frombuffer(number, "<i8").tolist(), have, strict=True):
            rows.append((known, doc, data[at : at + size]))
            at += size
    rows.sort()
    return [doc if known else None for known, doc, _ in rows], [text for _, _, text in rows]


def n_owners_of(n_chunks: int) -> int:
    return max(1, n_chunks // SECTIONS)


def _ask(n_owners: int, order: int, common: bytes, n_frequent: int):
    """Messages of a chunk, one for each owner that has strings of it: its words that are not on the list, then section by section the lengths of the strings and
    how many words each has in common with the one before, their counts, and the numbers of their other words, place by place."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        f = Features(unpacked(table)[1], order, spelled(common))
        slots = f.slots(n_owners * SECTIONS, n_frequent)
        by_slot = f.order(slots)
        bounds = np.searchsorted(slots[by_slot], np.arange(n_owners * SECTIONS + 1))
        columns, counts = [c[by_slot] for c in f.columns], f.counts[by_slot] - 1
        vocabulary, local = listed(f.words), np.arange(len(f.words) + 1, dtype=np.int32)
        n_common = f.n_common
        del f, by_slot, slots
        have, length = shared(columns), sum((c > 0).astype(np.int8) for c in columns)
        have[bounds[:-1][bounds[:-1] < len(have)]] = 0
        shape, told, ends = have + np.int16(order + 1) * length, [], []
        for m, column in enumerate(columns):
            new = (column > 0) & (have <= m)
            told.append(column[new])
            ends.append(np.concatenate(([0], np.cumsum(new)))[bounds])
        pack, owners, blobs = zstandard.ZstdCompressor(level=9).compress, [], []
        for k in range(n_owners):
            own = range(k * SECTIONS, (k + 1) * SECTIONS)
            if bounds[own.start] == bounds[own.stop] and k:  # the first owner hears of every chunk, for its answer brings the gains
                continue
            rare = np.unique(np.concatenate([x[x > n_common] for x in (numbers[end[own.start] : end[own.stop]] for numbers, end in zip(told, ends, strict=True))]))
            local[rare] = np.arange(1, len(rare) + 1, dtype=np.int32) + n_common
            parts = [pack(b" ".join([vocabulary[x - 1] for x in rare.tolist()]))]
            for x in own:
                a, b = bounds[x], bounds[x + 1]
                parts.append(ex.bundle([ex.squeeze(shape[a:b]), ex.squeeze(counts[a:b]), *(ex.squeeze(local[numbers[end[x] : end[x + 1]]]) for numbers, end in zip(told, ends, strict=True))]))
            owners.append(k)
            blobs.append(ex.bundle(parts))
        return ex.messages([key[0].as_py()] * len(owners), owners, blobs)

    return run


def strings_told(section: bytes, n_common: int, number: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The word numbers of the strings of a section of a message, those above n_common translated, and the strings' counts, less 1."""
    shape, counts, *told = (ex.unsqueeze(p).astype(np.int32) for p in ex.unbundle(section))
    length, have = np.divmod(shape, len(told) + 1)
    columns = []
    for m, own in enumerate(told):
        new, rare = (length > m) & (have <= m), own > n_common
        own[rare] = number[own[rare] - n_common - 1]
        columns.append(np.where(length > m, np.append(own, np.int32(0))[np.cumsum(new, dtype=np.int32) - 1], np.int32(0)))
    return columns, counts


def _steps() -> list[np.ndarray]:
    """Tables that carry a crc32 past 2**k bytes more, one for each byte of it."""
    value = np.arange(256, dtype=np.uint32)
    first = value
    for _ in range(8):
        first = (first >> np.uint32(1)) ^ np.where(first & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    steps = [np.array([first, value, value << np.uint32(8), value << np.uint32(16)])]
    while len(steps) < 31:
        steps.append(_carried(steps[-1], steps[-1]))
    return steps


def _carried(crc: np.ndarray, step: np.ndarray) -> np.ndarray:
    return step[0][crc & np.uint32(255)] ^ step[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ step[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ step[3][crc >> np.uint32(24)]


STEPS = _steps()


def appended(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of strings (given by crc) followed by others (given by tail and length)."""
    crc = crc.copy()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero(length & (1 << k))
        crc[at] = _carried(crc[at], STEPS[k])
    return crc ^ tail


def hashes_of(vocabulary: pa.Array):
    """A function that gives crc32 of the n-grams of word numbers, as strings with a space between words, put together from those of the words."""
    word = np.fromiter(map(zlib.crc32, listed(vocabulary)), np.uint32, len(vocabulary))
    length = np.array(pc.binary_length(vocabulary), np.int32) + 1
    tail = appended(np.full(len(word), zlib.crc32(b" "), np.uint32), word, length - 1)

    def run(columns: list[np.ndarray]) -> np.ndarray:
        out = word[columns[0] - 1]
        for column in columns[1:]:
            at = np.flatnonzero(column)
            own = column[at] - 1
            out[at] = appended(out[at], tail[own], length[own])
        return out

    return run


def _answer(n_buckets: int, common: bytes):
    """The dictionary of an owner: counts each distinct string of all chunks, hashes it once, adds up its buckets, and answers each chunk of documents.
    Its bucket totals go under a negative chunk number of its own."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks, frequent = table.column("chunk").to_pylist(), spelled(common)
        parts = [ex.unbundle(b) for b in table.column("blob").to_pylist()]
        rare = [spelled(p[0]) for p in parts]
        others = pa.concat_arrays(rare).dictionary_encode()
        vocabulary, others = pa.concat_arrays([frequent, others.dictionary]), others.indices.to_numpy()
        numbers = np.split(others + np.int32(len(frequent) + 1), np.cumsum([len(own) for own in rare])[:-1])
        hashes, totals = hashes_of(vocabulary), np.zeros((2, n_buckets), np.int64)
        replies: list[list[bytes]] = [[] for _ in parts]
        for section in range(1, SECTIONS + 1):
            told = [strings_told(p[section], len(frequent), number) for p, number in zip(parts, numbers, strict=True)]
            counts, columns = [c for _, c in told], [np.concatenate(own) for own in zip(*(t for t, _ in told), strict=True)]
            del told
            _, first, same = np.unique(codes_of(columns, len(vocabulary)), return_index=True, return_inverse=True)
            bucket = (hashes([c[first] for c in columns]) % np.uint32(n_buckets)).astype(np.min_scalar_type(n_buckets))[same]
            del columns, first, same
            at = 0
            for k, (chunk, hits) in enumerate(zip(chunks, counts, strict=True)):
                answer = bucket[at : at + len(hits)]
                at += len(hits)
                totals[int(chunk < 0)] += np.bincount(answer, weights=hits + 1.0, minlength=n_buckets).astype(np.int64)
                if chunk >= 0:
                    replies[k].append(ex.squeeze(answer))
        owner = key[0].as_py()
        out = [(-1 - owner, totals.astype("<i8").tobytes()), *((c, ex.bundle(r)) for c, r in zip(chunks, replies, strict=True) if c >= 0)]
        return ex.messages([c for c, _ in out], [owner] * len(out), [b for _, b in out])

    return run


def _totals(n_buckets: int):
    def run(batches):
        for batch in batches:
            held = np.zeros((2, n_buckets), np.int64)
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if chunk < 0:
                    held += np.frombuffer(blob, "<i8").reshape(2, n_buckets)
            own = np.flatnonzero(held.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[0, own]), pa.array(held[1, own])], ["bucket", "s", "t"])

    return run


def gains_of(bucket: np.ndarray, s: np.ndarray, t: np.ndarray, n_buckets: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * log ratio) of the smoothed shares of each bucket among target and documents."""
    every_s, every_t = int(s.sum()), int(t.sum())
    out = np.zeros(n_buckets, np.int64)
    for k, a, b in zip(bucket.tolist(), s.tolist(), t.tolist(), strict=True):
        out[k] = math.floor(scale * math.log((b + 1) * (every_s + n_buckets) / ((a + 1) * (every_t + n_buckets))))
    return out


def _gains(n_buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        gains = gains_of(*(table.column(c).to_numpy() for c in ("bucket", "s", "t")), n_buckets)
        return pa.table({"first": pa.array([0], pa.int32()), "gains": pa.array([gains.astype("<i8").tobytes()], pa.binary())})

    return run


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _weigh(n_owners: int, order: int, common: bytes, n_frequent: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = unpacked(docs)
        f = Features(texts, order, spelled(common))
        by_slot = f.order(f.slots(n_owners * SECTIONS, n_frequent))
        answers = answers.sort_by("bucket")
        gain, blobs = np.zeros(len(by_slot), np.int64), answers.column("blob").to_pylist()
        if texts and blobs:
            buckets = np.concatenate([ex.unsqueeze(p) for b in blobs for p in ex.unbundle(b)]).astype(np.int64)
            gain[by_slot] = np.frombuffer(answers.column("gains")[0].as_py(), "<i8")[buckets]
        return pa.table([pa.array(ids, pa.int64()), pa.array(f.n_words), pa.array(f.n_features), pa.array(f.sum(gain))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS, order: int = ORDER, target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs: the log ratio of target to documents, summed over its features."""
    dealt, n_chunks = ex.chunks(text_of(docs, id_col, text_col))
    aims, n_aims = ex.chunks(target.select(F.xxhash64(target_text).alias("doc_id"), F.col(target_text).cast("string").alias("text")))
    n_owners = n_owners_of(n_chunks + n_aims)
    common, n_frequent = frequent_words(dealt, n_owners * SECTIONS)
    chunk = "chunk int, texts binary"
    dealt, aims = dealt.mapInArrow(packed, chunk), aims.withColumn("chunk", -1 - F.col("chunk")).mapInArrow(packed, chunk)
    ask = lambda texts: texts.groupBy("chunk").applyInArrow(_ask(n_owners, order, common, n_frequent), ex.MESSAGE)
    asked = ask(dealt).unionAll(ask(aims))  # apart, so that the exchange of the documents is the one that weighing them reads
    # One exchange of the answers serves both the totals and the documents, so both read it as it is: totals are picked out in tasks, not by a filter.
    answers = asked.groupBy("bucket").applyInArrow(_answer(n_buckets, common), ex.MESSAGE).repartition("chunk")
    totals = answers.mapInArrow(_totals(n_buckets), "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    gains = totals.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_gains(n_buckets), "first int, gains binary")  # at most n_buckets rows
    told = answers.withColumn("first", F.col("bucket")).join(F.broadcast(gains), "first", "left").select("chunk", "bucket", "blob", "gains")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_weigh(n_owners, order, common, n_frequent), WEIGHTS)


def draw(weights: DataFrame, percent: int = 5, seed: int = SEED, least_words: int = LEAST_WORDS, scale: int = SCALE) -> DataFrame:
    """weights with score, and the rank of the drawn rows: the percent (of the rows with least_words words or more, rounded down) of highest score, ties to smaller ids."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scored = cut(weights.withColumn("score", F.col("weight") + F.floor(-scale * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")))
    able = F.col("n_words") >= least_words
    most = percent * scored.filter(able).count() // 100
    ranked = position(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")])
    rank = F.when(F.col("rank") <= most, F.col("rank").cast("long"))
    return ranked.withColumn("rank", rank).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, whose id is drawn."""
    drawn = draw(weigh(docs, target), percent, seed).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long") == drawn["_drawn"], "left_semi")


def op12_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return draw(weigh(docs, benchmark)).select("doc_id", "n_features", "weight", "score", "rank")
