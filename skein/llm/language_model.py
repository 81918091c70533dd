"""Language-model scores by deleted interpolation of word n-grams.

Counts of tokens, of pairs and of triples of tokens are taken over all training texts.  A token's probability mixes the uniform one, the
token's share of all, its share after the token before it, and its share after the two before it:

    p(w | u v) = l0(b) / (V + 1) + l1(b) c(w) / N + l2(b) c(v w) / c(v) + l3(b) c(u v w) / c(u v)

b is the bucket of context frequency: the power of two of c(u v) where that context occurs at least twice, else that of c(v), and one
bucket for contexts never seen.  The weights l of each bucket are learned by expectation-maximisation on held-out counts: each training
token is left out of the counts that predict it.  (So a context u v that occurs once predicts nothing, and has no third part.)  Left-out
counts are told apart on a grid of STEPS steps a doubling, which bounds the table of their frequencies; weights learned from it
differ from those learned token by token by less than 0.02 (tests).  A text's first token follows the end of the text before.

The counts are gathered by questions and answers between chunks and buckets (see exchange.py): a chunk states its distinct
keys with their counts, and gets the corpus counts of just those back: tokens and pairs first, then the triples after contexts that
occur twice.  Frequencies of left-out counts are summed over all chunks, and the weights go to each chunk with its answers.

Tokens: A-Z lower-cased, words between ASCII white space, then one end.  Tokens are told apart by 64-bit hashes, pairs and triples by 56 bits.

Defined cases: null is the empty text, whose only token is the end; without training rows N and V are 0 and every
probability is the uniform 1.  Rows with a null id are scored and not learned from; repeated rows count each time.  A text longer than a chunk is a
chunk of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as ex
from skein.llm.common import WHITE, id_remainder, mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KEY_BITS = 56
#: Context buckets: 0 never seen; then by c(v); then by c(u v).  Cells of the grid of left-out counts.
POWERS, GRID, STEPS, OWN_STEPS = 40, 128, 3, 1
N_BUCKETS = 2 * POWERS
ODD = np.uint64(0x9E3779B97F4A7C15)


END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))

#: Words of up to LONG bytes have polynomial hashes, taken from sums over PIECE bytes at a time; longer ones are hashed one by one.
LONG, PIECE = 64, 1 << 20
BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of ODD and of its inverse, modulo 2**64."""
    if not _powers:
        for base in (int(ODD), pow(int(ODD), -1, 1 << 64)):
            out = np.ones(PIECE, np.uint64)
            have = 1
            while have < PIECE:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _powers.append(out)
    return _powers


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word data[start:end]; words are in order."""
    power, inverse = _power_tables()
    flat, out, at = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + PIECE - LONG, "right")))
        part = flat[base : min(int(ends[to - 1]), int(base) + PIECE)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * power[: len(part)], dtype=np.uint64)))
        first = starts[at:to] - base
        out[at:to] = (sums[np.minimum(ends[at:to] - base, len(part))] - sums[first]) * inverse[first]
        at = to
    size = ends - starts
    out = mix(out + size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a batch, chunk by chunk: lower-cased and compressed, with their lengths, ids and whether they are learned from."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).take(pa.array(order)).to_pylist()]
        ids = batch.column("doc_id").take(pa.array(order))
        have, number, train = np.array(ids.is_valid()), np.array(ids.fill_null(0)), np.array(batch.column("train").take(pa.array(order)))
        edge = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0, [True]))) if len(order) else np.zeros(1, int)
        out = []
        for a, b in zip(edge, edge[1:], strict=False):
            sizes = np.fromiter(map(len, texts[a:b]), np.uint64, b - a)
            flags = have[a:b].astype(np.uint8) + 2 * train[a:b].astype(np.uint8)
            out.append(ex.bundle([pack.compress(b"".join(texts[a:b]).translate(LOWER)), ex.squeeze(sizes), number[a:b].astype("<i8").tobytes(), flags.tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[order][edge[:-1]], pa.int32()), pa.array(out, pa.binary())], ["chunk", "texts"])


class Tokens:
    """The tokens of some packed texts, one text after the other.  Of each text: its size in tokens, its first token, its id and whether it is learned from."""

    def __init__(self, texts: list[bytes]):
        parts = [ex.unbundle(b) for b in texts]
        data = b"".join(zstandard.ZstdDecompressor().decompress(p[0]) for p in parts)
        bytes_of = np.concatenate([*(ex.unsqueeze(p[1]) for p in parts), np.zeros(0, np.uint64)]).astype(np.int64)
        flags = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        self.ids, self.train = pa.array(np.frombuffer(b"".join(p[2] for p in parts), "<i8"), mask=flags & 1 == 0), flags & 2 > 0
        offsets = np.concatenate(([0], np.cumsum(bytes_of)))
        inside = ~IS_WHITE[np.frombuffer(data, np.uint8)]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        self.size = np.diff(np.searchsorted(starts, offsets)) + 1
        last = np.cumsum(self.size)
        self.first = last - self.size
        self.w = np.full(self.size.sum(), END)
        words = np.ones(len(self.w), bool)
        words[last - 1] = False
        self.w[words] = word_hashes(data, starts, ends)
        self.v = np.concatenate(([END], self.w[:-1])) if len(self.w) else self.w

    def trained(self) -> np.ndarray:
        """Of each token: is it learned from?"""
        return np.repeat(self.train, self.size)

    def pairs(self) -> np.ndarray:
        """The key of each token with the one before it."""
        return mix(self.v * ODD + self.w) >> np.uint64(64 - KEY_BITS)

    def triples(self) -> np.ndarray:
        """The key of each token with the two before it; two ends stand before a text."""
        u = np.concatenate(([END], self.v[:-1])) if len(self.v) else self.v
        u[self.first] = END
        return mix((mix(u) * ODD + self.v) * ODD + self.w) >> np.uint64(64 - KEY_BITS)


def _question(keys: np.ndarray, train: np.ndarray, n_buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often training tokens have each, and where each bucket begins."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, train, len(distinct)).astype(np.uint64), ex.bounds(distinct, n_buckets, bits)


def _asked(chunk: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    used = np.flatnonzero(sum(np.diff(at) for _, _, at in parts)).tolist()
    blobs = [ex.bundle([x for keys, counts, at in parts for x in (ex.squeeze_sorted(keys[at[b] : at[b + 1]]), ex.squeeze(counts[at[b] : at[b + 1]]))]) for b in used]
    return ex.messages([chunk] * len(used), used, blobs)


def _ask_pairs(n_buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        t = Tokens(docs.column("texts").to_pylist())
        train = t.trained()
        return _asked(key[0].as_py(), [_question(t.w, train, n_buckets, 64), _question(t.pairs(), train, n_buckets, KEY_BITS)])

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of the counts of a bucket, back to each chunk that asked.  The first chunk also hears how many of the bucket's tokens (first part) occur at all."""
    asked = [ex.unbundle(b) for b in table.column("blob").to_pylist()]
    answers: list[list[bytes]] = [[] for _ in asked]
    for kind in range(0, len(asked[0]), 2):
        keys = [ex.unsqueeze_sorted(a[kind]) for a in asked]
        counts = np.concatenate([ex.unsqueeze(a[kind + 1]) for a in asked])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts.astype(np.float64), len(distinct)).astype(np.uint64)
        at = 0
        for k, (answer, own) in enumerate(zip(answers, keys, strict=True)):
            answer.append(ex.squeeze(total[where[at : at + len(own)]]))
            if kind == 0:
                answer.append(struct.pack("<q", 0 if k else int((total > 0).sum())))
            at += len(own)
    return ex.messages(table.column("chunk").to_pylist(), [key[0].as_py()] * len(answers), [*map(ex.bundle, answers)])


class Counts:
    """The corpus counts of each token of a chunk: c_w, c_v, c_vw, c_uv and, where contexts occur twice, c_uvw; known: distinct tokens told to this chunk."""

    def __init__(self, t: Tokens, pairs: list[bytes]):
        got = [ex.unbundle(b) for b in pairs]
        self.known = sum(struct.unpack("<q", g[1])[0] for g in got)
        self.c_w, self.c_vw = (self._spread(keys, [g[k] for g in got]) for keys, k in ((t.w, 0), (t.pairs(), 2)))
        ends = self.c_w[t.first + t.size - 1]  # of the end, which stands before each text
        self.c_v, self.c_uv = (np.concatenate(([0], c[:-1])) for c in (self.c_w, self.c_vw))
        self.c_v[t.first] = ends
        self.c_uv[t.first] = ends
        self.twice = self.c_uv >= 2
        self.c_uvw = np.zeros(len(self.c_w), np.int64)

    @staticmethod
    def _spread(keys: np.ndarray, answers: list[bytes]) -> np.ndarray:
        where = np.unique(keys, return_inverse=True)[1]
        return np.concatenate([*map(ex.unsqueeze, answers), np.zeros(0, np.uint64)])[where].astype(np.int64)

    def add_triples(self, t: Tokens, answers: list[bytes]) -> None:
        self.c_uvw[self.twice] = self._spread(t.triples()[self.twice], [ex.unbundle(b)[0] for b in answers])

    def bucket(self) -> np.ndarray:
        power = lambda c: np.minimum(np.floor(np.log2(np.maximum(c, 1))), POWERS - 2).astype(np.int64)
        return np.where(self.twice, POWERS + power(self.c_uv), np.where(self.c_v > 0, 1 + power(self.c_v), 0))


def _ask_triples(n_buckets: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ex.messages([], [], [])
        t = Tokens(docs.column("texts").to_pylist())
        twice = Counts(t, _of_kind(answers, 1)).twice
        return _asked(key[0].as_py(), [_question(t.triples()[twice], t.trained()[twice], n_buckets, KEY_BITS)])

    return run


def _of_kind(answers: pa.Table, kind: int) -> list[bytes]:
    """The answers of one kind, bucket by bucket."""
    rows = zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)
    return [b for _, _, b in sorted(r for r in rows if r[0] == kind)]


def _counted(docs: pa.Table, answers: pa.Table) -> tuple[Tokens, Counts]:
    t = Tokens(docs.column("texts").to_pylist())
    c = Counts(t, _of_kind(answers, 1))
    c.add_triples(t, _of_kind(answers, 2))
    return t, c


def _steps(x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Numbers from 2**-31 to 1 on a logarithmic grid of so many steps a doubling; 0 for 0."""
    return np.where(x > 0, np.clip(1 - np.rint(steps * np.log2(np.maximum(x, 2.0**-60))), 1, GRID - 1), 0).astype(np.int64)


def _of_step(k: np.ndarray, steps: int = STEPS) -> np.ndarray:
    return np.where(k > 0, 2.0 ** ((1 - k) / steps), 0.0)


def cells_of(bucket: np.ndarray, own: np.ndarray, after: np.ndarray, after_two: np.ndarray) -> np.ndarray:
    """The cell of each token's left-out counts; its own count, of least weight, on OWN_STEPS steps a doubling."""
    return ((bucket * GRID + _steps(own * 2.0**-31, OWN_STEPS)) * GRID + _steps(after)) * GRID + _steps(after_two)


def left_out(c: Counts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each training token: its bucket, and its share in the counts of its two contexts and its count, all without itself."""
    less = lambda x, y: np.where(y[train] > 1, (x[train] - 1) / np.maximum(1, y[train] - 1), 0.0)
    return c.bucket()[train], c.c_w[train] - 1, less(c.c_vw, c.c_v), np.where(c.twice[train], less(c.c_uvw, c.c_uv), 0.0)


TOKENS, WORDS = -1, -2


def _count_left_out(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """How often which left-out counts occur in a chunk, and its parts of N and V."""
    if not docs.num_rows:
        return pa.table({"cell": pa.array([], pa.int64()), "hits": pa.array([], pa.int64())})
    t, c = _counted(docs, answers)
    train = t.trained()
    bucket, own, after, after_two = left_out(c, train)
    cells, hits = np.unique(cells_of(bucket, own, after, after_two), return_counts=True)
    return pa.table({"cell": pa.array([TOKENS, WORDS, *cells.tolist()], pa.int64()), "hits": pa.array([int(train.sum()), c.known, *hits.tolist()], pa.int64())})


def em(p: np.ndarray, hits: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights of the columns of p by expectation-maximisation; columns that are 0 throughout get none."""
    w = (p > 0).any(0) / max(1, (p > 0).any(0).sum())
    for _ in range(rounds):
        part = p * w
        w = (hits[:, None] * part / part.sum(1, keepdims=True)).sum(0) / hits.sum()
    return w


def parts_of(bucket: int) -> np.ndarray:
    """Which of the four parts a bucket's contexts have."""
    return np.array([True, True, bucket > 0, bucket >= POWERS])


def learn_weights(bucket: int, cells: np.ndarray, hits: np.ndarray, n: int, v: int) -> np.ndarray:
    """The weights of a bucket; none (zeros) where no left-out token falls into it."""
    if not len(cells):
        return np.zeros(4)
    own, after, after_two = _of_step(cells // GRID // GRID % GRID, OWN_STEPS) * 2.0**31, _of_step(cells // GRID % GRID), _of_step(cells % GRID)
    p = np.stack([np.full(len(cells), 1 / (v + 1)), own / max(1, n - 1), np.minimum(1, after), np.minimum(1, after_two)], 1)
    out = np.where(parts_of(bucket), np.maximum(em(p, hits), 1e-6), 0)
    return out / out.sum()


WEIGHTS = "<6d"


def _learn(key: tuple, table: pa.Table) -> pa.Table:
    """Weights of one bucket, with N and V.  A bucket has at most GRID**3 cells."""
    cells, hits = table.column("cell").to_numpy(), table.column("hits").to_numpy()
    n, v = (int(hits[cells == k].sum()) for k in (TOKENS, WORDS))
    own = cells >= 0
    w = learn_weights(key[0].as_py(), cells[own], hits[own].astype(np.float64), n, v)
    return pa.table({"one": pa.array([0], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([struct.pack(WEIGHTS, *w, n, v)], pa.binary())})


def _together(key: tuple, table: pa.Table) -> pa.Table:
    """The weights of all N_BUCKETS buckets in one row; a bucket without any takes those of the next lower one that has the same parts, else equal ones."""
    found = dict(zip(table.column("bucket").to_pylist(), (struct.unpack(WEIGHTS, b) for b in table.column("blob").to_pylist()), strict=True))
    n, v = next(iter(found.values()))[4:]
    out: list[np.ndarray] = []
    for b in range(N_BUCKETS):
        w = np.array(found[b][:4]) if b in found else np.zeros(4)
        if not w.sum():
            parts = parts_of(b)
            w = out[-1] if out and (parts_of(b - 1) == parts).all() else parts / parts.sum()
        out.append(w)
    return pa.table({"blob": pa.array([struct.pack("<qq", int(n), int(v)) + np.array(out, "<f8").tobytes()], pa.binary())})


def probabilities(c: Counts, weights: np.ndarray, n: int, v: int) -> np.ndarray:
    w = weights[c.bucket()]
    if not n:
        return np.ones(len(w))
    return w[:, 0] / (v + 1) + w[:, 1] * c.c_w / n + w[:, 2] * c.c_vw / np.maximum(1, c.c_v) + w[:, 3] * c.c_uvw / np.maximum(1, c.c_uv)


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64(), pa.float64())], names)
    t, c = _counted(docs, answers)
    model = _of_kind(answers, 3)[0]
    n, v = struct.unpack("<qq", model[:16])
    p = probabilities(c, np.frombuffer(model[16:], "<f8").reshape(-1, 4), n, v)
    each = lambda x: pa.array(np.add.reduceat(x, t.first))
    base = np.add.reduceat(np.log10(c.c_w + 1.0), t.first) - t.size * np.log10(n + v + 1.0)
    return pa.table([t.ids, pa.array(t.size), each((c.c_w > 0).astype(np.int64)), pa.array(np.full(len(t.size), n, np.int64)), pa.array(base), each(np.log10(p))], names)


def score(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs; train says which rows are learned from."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt, n_chunks = ex.chunks(own)
    dealt = dealt.withColumn("train", F.coalesce(train, F.lit(False))).mapInArrow(packed, "chunk int, texts binary")
    by_chunk = lambda answers: dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    pairs = dealt.groupBy("chunk").applyInArrow(_ask_pairs(n_chunks), ex.MESSAGE).groupBy("bucket").applyInArrow(_answer, ex.MESSAGE).withColumn("kind", F.lit(1))
    triples = by_chunk(pairs).applyInArrow(_ask_triples(n_chunks), ex.MESSAGE).groupBy("bucket").applyInArrow(_answer, ex.MESSAGE).withColumn("kind", F.lit(2))
    answers = pairs.unionAll(triples)
    cells = by_chunk(answers).applyInArrow(_count_left_out, "cell long, hits long").groupBy("cell").agg(F.sum("hits").alias("hits"))
    of_cell = F.when(F.col("cell") < 0, F.sequence(F.lit(0), F.lit(N_BUCKETS - 1))).otherwise(F.array((F.col("cell") / GRID**3).cast("int")))
    weights = cells.select(F.explode(of_cell).alias("context"), "cell", "hits").groupBy("context").applyInArrow(_learn, "one int, bucket int, blob binary")
    model = weights.groupBy("one").applyInArrow(_together, "blob binary")
    chunk_ids = docs.sparkSession.range(n_chunks).select(F.col("id").cast("int").alias("chunk"), F.lit(0).alias("one"))
    told = chunk_ids.join(F.broadcast(model.withColumn("one", F.lit(0))), "one").select("chunk", F.lit(0).alias("bucket"), "blob", F.lit(3).alias("kind"))  # one row of N_BUCKETS weights, beside each chunk
    return by_chunk(answers.unionAll(told)).applyInArrow(_score, SCORES)


def op10_language_model(docs: DataFrame) -> DataFrame:
    out = score(docs, id_remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
