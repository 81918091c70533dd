"""Alignment of the tokens of two tokenizers over the bytes they share, by byte-owner arrays.

A is a byte-level tokenizer file, B a sentence-piece model that puts a blank before its text; so A gets the text behind one blank.  Over the bytes of that
string, np.repeat gives each byte its owning token of A and of B.  Each run of bytes with one pair of owners is one overlap (a link); where both
owners change, both tokenizers end a token, and the string is cut into groups.

Link statistics: how many documents hold a pair of ids linked.  Documents are encoded once, in packs of about PACK_BYTES whole documents, and kept as
packs of numbers of links; each pack asks the owners of hash ranges of pairs for the counts of its distinct pairs, so a pair that all documents hold costs an entry a pack.
The highest count of each id of A is a table as long as A's vocabulary at most, which is broadcast.

Defined cases: null and empty texts, and texts whose joined tokens of either side are not the text behind a blank, have no tokens and no groups;
a null id is kept; of repeated rows each is a document of its own; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as ex
from skein.llm.common import cut, mix, text_of
from skein.llm.packing import Encoder, _byte_letters

PACK_BYTES = 4 << 20


class Pair:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = Encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.slow.encode_special_tokens = True  # their strings in a text are plain text
        letters = {c: bytes([k]) for k, c in _byte_letters().items()}
        vocabulary = self.a.slow.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = token.encode() if token in self.a.special else b"".join(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in own], np.int32) for own in (self.a_bytes, self.b_bytes)]
        #: Each id of A, then of B, in decimal behind which stands a comma, a bar or a semicolon.
        self.written = [f"{k}{mark}" for own in (self.a_bytes, self.b_bytes) for k in range(len(own)) for mark in ",|;"]

    def encode(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Ids of A and of B over the text behind a blank, as 32-bit numbers; none of an empty text or one that either does not give back."""
        if not text:
            return None
        a, b = self.a.encode(" " + text), self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, memoryview(a).cast("I"))) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return a, np.array(b, "<u4").tobytes()


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


class Alignment:
    """The tokens of some texts, laid end to end, and what the byte-owner arrays say of them."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        both = [pair.encode(t) for t in texts]
        a, b = (np.frombuffer(b"".join(x[k] for x in both if x), "<u4").astype(np.int32) for k in (0, 1))
        self.a, self.b, self.n, self.pair = a, b, len(texts), pair
        self.n_a, self.n_b = (np.array([len(x[k]) // 4 if x else 0 for x in both], np.int64) for k in (0, 1))
        owner_a, owner_b = np.repeat(np.arange(len(a), dtype=np.int32), pair.sizes[0][a]), np.repeat(np.arange(len(b), dtype=np.int32), pair.sizes[1][b])
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        run = np.flatnonzero(new_a | new_b)
        #: The links: an overlapping token of each side, in order.
        self.link_a, self.link_b = owner_a[run], owner_b[run]
        begins = np.flatnonzero(new_a & new_b)
        #: The first token of each group on each side.
        self.group_a, self.group_b, self.begins = owner_a[begins], owner_b[begins], begins
        self.doc_a = np.repeat(np.arange(self.n), self.n_a)
        self.link_doc, self.group_doc = self.doc_a[self.link_a], self.doc_a[self.group_a]
        self.n_links, self.n_groups = (np.bincount(d, minlength=self.n) for d in (self.link_doc, self.group_doc))

    def group_texts(self) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        a, b, groups = len(self.a), len(self.b), len(self.group_a)
        group = [np.repeat(np.arange(groups), np.diff(np.append(first, n))) for first, n in ((self.group_a, a), (self.group_b, b))]
        at_a, at_b = np.arange(a) + self.group_b[group[0]], np.arange(b) + np.append(self.group_a[1:], a)[group[1]]
        ids, mark = np.empty(a + b, np.int64), np.zeros(a + b, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b + np.int64(len(self.pair.a_bytes))
        mark[at_a[np.append(self.group_a[1:], a) - 1]] = 1
        mark[at_b[np.append(self.group_b[1:], b) - 1]] = 2
        parts, out, at = list(map(self.pair.written.__getitem__, (ids * 3 + mark).tolist())), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(parts[at : at + n])[:-1])
            at += n
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids, in order, and of each text's distinct pairs: the text, the pair's place, and how often it is linked."""
        keys, back = np.unique((self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b], return_inverse=True)
        own, times = np.unique(self.link_doc * max(1, len(keys)) + back, return_counts=True)
        return keys, own // max(1, len(keys)), own % max(1, len(keys)), times


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups of each row: the byte range in the text behind a blank, and the ids of A and of B that fill it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in batches:
            found = Alignment(pair, batch.column("text").to_pylist())
            size = pair.sizes[0][found.a]
            total = int(size.sum())
            base = np.concatenate(([0], np.cumsum(np.bincount(found.doc_a, weights=size, minlength=found.n)).astype(np.int64)))
            ends, own = np.append(found.begins[1:], total), base[found.group_doc]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids, pa.int32())) for first, ids in ((found.group_a, found.a), (found.group_b, found.b))]
            groups = pa.StructArray.from_arrays([pa.array(found.begins - own), pa.array(ends - own), *lists], ["start", "end", "a", "b"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(found.n_groups))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, groups)], ["doc_id", "groups"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>")


#: Owner of a pack's own row; the owners of pairs are numbered from 0.
OWN = -1
#: An owner counts the pairs of about this many packs.
PACKS_OF_OWNER = 4
PACK_ROW = "pack long, owner int, blob binary"


def packs_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of whole documents, about limit characters together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and size + len(text or "") > limit:
                yield pa.array(ids, pa.int64()), texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
    if texts:
        yield pa.array(ids, pa.int64()), texts


def owners_of(keys: np.ndarray, n_owners: int) -> np.ndarray:
    return ex.bucket_of(mix(keys.astype(np.uint64)), n_owners)


def _rows(pack: list[int], owner: list[int], blob: list[bytes]) -> list[pa.Array]:
    return [pa.array(pack, pa.int64()), pa.array(owner, pa.int32()), pa.array(blob, pa.binary())]


def _encode(a_path: str, b_path: str, limit: int, n_owners: int):
    """For each pack its own row, and a question for each owner of some of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, base = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(packs_of(batches, limit)):
            found = Alignment(pair, texts)
            keys, doc, place, times = found.links()
            digests = b"".join(hashlib.sha256(g.encode()).digest() for g in found.group_texts())
            number = np.array(ids.fill_null(0)).astype("<i8").tobytes()
            facts = [found.n_a, found.n_b, found.n_groups, found.n_links, np.bincount(doc, minlength=found.n), place, times - 1]
            own = ex.bundle([number, np.array(ids.is_valid()).tobytes(), digests, ex.squeeze_sorted(keys.astype(np.uint64)), *map(ex.squeeze, facts)])
            documents, owner = np.bincount(place, minlength=len(keys)), owners_of(keys, n_owners)
            order = np.argsort(owner, kind="stable")
            bound = np.searchsorted(owner[order], np.arange(n_owners + 1))
            asked = np.flatnonzero(np.diff(bound)).tolist()
            parts = [order[bound[o] : bound[o + 1]] for o in asked]
            blobs = [ex.bundle([ex.squeeze_sorted(keys[x].astype(np.uint64)), ex.squeeze(documents[x] - 1)]) for x in parts]
            yield pa.RecordBatch.from_arrays(_rows([base + k] * (len(asked) + 1), [OWN, *asked], [own, *blobs]), ["pack", "owner", "blob"])

    return run


def packed(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The packs of docs, encoded once, and the number of owners."""
    own = text_of(docs, id_col, text_col)
    limit = int(docs.sparkSession.conf.get("spark.skein.chunk.bytes", str(PACK_BYTES)))
    n_owners = 1 + (own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // (limit * PACKS_OF_OWNER)
    return cut(own.mapInArrow(_encode(a_path, b_path, limit, n_owners), PACK_ROW)), n_owners


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct pairs of all questions and their documents, each asked pair's place among them, and how many each question asks."""
    parts = [ex.unbundle(b) for b in table.column("blob").to_pylist()]
    asked = [ex.unsqueeze_sorted(p[0]) for p in parts]
    keys, back = np.unique(np.concatenate(asked), return_inverse=True)
    documents = np.bincount(back, weights=np.concatenate([ex.unsqueeze(p[1]) for p in parts]).astype(np.int64) + 1).astype(np.int64)
    return keys, documents, back, [len(x) for x in asked]


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Each question answered with the documents of its pairs; under a negative pack number, the highest count of each id of A here."""
    keys, documents, back, sizes = _counted(table)
    told = np.split(documents[back], np.cumsum(sizes)[:-1])
    first = np.flatnonzero(np.diff((keys >> np.uint64(32)).astype(np.int64), prepend=-1))
    best = ex.bundle([ex.squeeze_sorted(keys[first] >> np.uint64(32)), ex.squeeze(np.maximum.reduceat(documents, first))])
    owner = key[0].as_py()
    return pa.Table.from_arrays(_rows([OWN, *table.column("pack").to_pylist()], [owner] * (len(told) + 1), [best, *map(ex.squeeze, told)]), ["pack", "owner", "blob"])


def _pairs_table(key: tuple, table: pa.Table) -> pa.Table:
    keys, documents, _, _ = _counted(table)
    return pa.table({"a": pa.array((keys >> np.uint64(32)).astype(np.int32)), "b": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int32)), "documents": pa.array(documents)})


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, documents: in how many documents the two ids are linked."""
    return packed(docs, a_path, b_path)[0].filter(F.col("owner") != OWN).groupBy("owner").applyInArrow(_pairs_table, "a int, b int, documents long")


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            a, n = ex.unbundle(blob)
            a, n = ex.unsqueeze_sorted(a), ex.unsqueeze(n)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "documents"])


SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(n_owners: int, shared):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for blob in table.column("blob").to_pylist():
            number, valid, digests, keys, *facts = ex.unbundle(blob)
            keys = ex.unsqueeze_sorted(keys)
            n_a, n_b, n_groups, n_links, n_own, place, times = (ex.unsqueeze(x).astype(np.int64) for x in facts)
            count = np.zeros(len(keys), np.int64)
            if len(keys):
                count[np.argsort(owners_of(keys, n_owners), kind="stable")] = np.concatenate([ex.unsqueeze(b) for b in answers.sort_by("owner").column("blob").to_pylist()])
            best = count == shared.value[(keys >> np.uint64(32)).astype(np.int64)]
            doc = np.repeat(np.arange(len(n_own)), n_own)
            n_best, total = np.zeros(len(n_own), np.int64), np.zeros(len(n_own), np.int64)
            np.add.at(n_best, doc, (times + 1) * best[place])
            np.add.at(total, doc, (times + 1) * count[place])
            hashes = [digests[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(n_a.tolist())]
            ids = pa.array(np.frombuffer(number, "<i8"), mask=~np.frombuffer(valid, bool))
            out.append(pa.table([ids, *map(pa.array, (n_a, n_b, n_groups, n_links, n_best, total)), pa.array(hashes, pa.string())], [c.split()[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    made, n_owners = packed(docs, a_path, b_path, id_col, text_col)
    answers = cut(made.filter(F.col("owner") != OWN).groupBy("owner").applyInArrow(_answer, PACK_ROW))
    rows = answers.filter(F.col("pack") == OWN).mapInArrow(_best, "a int, documents long").groupBy("a").agg(F.max("documents").alias("n")).collect()  # ids of A's vocabulary
    best = np.zeros(1 + max((r.a for r in rows), default=0), np.int64)
    best[[r.a for r in rows]] = [r.n for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(best)
    return made.filter(F.col("owner") == OWN).groupBy("pack").cogroup(answers.filter(F.col("pack") != OWN).groupBy("pack")).applyInArrow(_score(n_owners, shared), SCORES)


def op13_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return score(docs, a_path or str(public_tokenizers.path("byte_bpe_50k.json")), b_path or str(public_tokenizers.path("piece_bpe_32k.model")))
