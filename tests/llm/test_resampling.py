"""Resampling against its definition, on the tables and on odd inputs."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from skein.llm import exchange as ex
from skein.llm import resampling
from skein.llm.common import table
from tests.llm.test_operators import ODD, docs_of


def grams(text, order=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[k : k + m]) for m in range(1, order + 1) for k in range(len(words) - m + 1)]


def brute(docs, target, buckets=10_000, percent=5):
    where = lambda g: zlib.crc32(g.encode()) % buckets
    own = [grams(t) for _, t in docs]
    s, t = collections.Counter(where(g) for _, gs in own for g in gs), collections.Counter(where(g) for x in target for g in grams(x)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (every_s + buckets) / ((s[b] + 1) * (every_t + buckets)))) for b in s}
    rows = []
    for (doc, _), (n, gs) in zip(docs, own, strict=True):
        weight = sum(gain[where(g)] for g in gs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = collections.Counter((r[0], r[2], r[3], r[4], k) for k, r in enumerate(able[: percent * len(able) // 100], 1))
    return rows, drawn


def same(got, docs, target):
    rows, drawn = brute(docs, target)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter((d, n, w, s) for d, _, n, w, s in rows)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got if r["rank"] is not None) == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, sum(drawn.values()) + 1))


@pytest.mark.parametrize("chunk_bytes", ["40000", "8388608"])
def test_whole_tables_and_odd_rows(spark, sf, chunk_bytes):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + ODD
    bench = table(spark, sf, "benchmark")
    spark.conf.set("spark.skein.chunk.bytes", chunk_bytes)  # many chunks and owners, then one
    try:
        got = resampling.op12_resampling(docs_of(spark, docs), bench).collect()
    finally:
        spark.conf.unset("spark.skein.chunk.bytes")
    same(got, docs, [r.text for r in bench.collect()])


def test_empty_tables_and_targets(spark):
    none, some = docs_of(spark, []), [(k, f"word{k} and more words " * 6) for k in range(40)]
    target = spark.createDataFrame([("a", None), ("b", "")], "item_id string, text string")
    assert resampling.op12_resampling(none, target).collect() == []
    for aims in (target, target.limit(0)):
        same(resampling.op12_resampling(docs_of(spark, some), aims).collect(), some, [])


def test_ties_go_to_the_smaller_id(spark):
    got = resampling.draw(spark.createDataFrame([(None, 30, 1, 5)] + [(k, 30, 1, 10**6 * (k % 2)) for k in range(100)], "doc_id long, n_words long, n_features long, weight long"), percent=30).collect()
    drawn = sorted((r["rank"], r.doc_id) for r in got if r["rank"] is not None)
    assert len(drawn) == 30 and all(d % 2 for _, d in drawn)
    twice = spark.createDataFrame([(7, 30, k, 5) for k in (3, 2, 1)], "doc_id long, n_words long, n_features long, weight long")
    assert [r.n_features for r in resampling.draw(twice, percent=100).orderBy("rank").collect()] == [1, 2, 3]


def test_words_beyond_the_bits_are_numbered_anew():
    texts = [" ".join(f"w{(k * j) % 70_001}" for k in range(3_000)).encode() for j in range(1, 40)]
    f = resampling.Features(texts, 5)
    vocabulary = f.words.to_pylist()
    got = collections.Counter()
    for row, n in zip(f.columns.T.tolist(), f.counts.tolist(), strict=True):
        got[b" ".join(vocabulary[k - 1] for k in row if k).decode()] += n
    assert got == collections.Counter(g for t in texts for g in grams(t.decode(), 5)[1])
    assert f.sum(np.ones(len(f.counts), np.int64)).tolist() == f.n_features.tolist()


def test_resample_keeps_whole_rows_near_the_target(spark):
    docs = docs_of(spark, [(k, ("alpha beta gamma delta " if k % 10 == 0 else "one two three four ") * 10) for k in range(200)])
    target = spark.createDataFrame([("t", "alpha beta gamma delta alpha beta")], "item_id string, text string")
    kept = resampling.resample(docs, target).collect()
    assert len(kept) == 10 and all(r.doc_id % 10 == 0 and r.lang == "en" for r in kept)


def shuffled(spark):
    """Bytes that the session has written to exchanges."""
    sc = spark.sparkContext._jsc.sc()
    time.sleep(0.3)
    spark.range(1).count()  # an event after the pause brings the totals up to date
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_exchanges_take_less_than_five_halves_of_the_text(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 11))) for _ in range(30_000)]
    texts = [" ".join(vocabulary[k] for k in (30_000 * rng.random(500) ** 3).astype(int)) for _ in range(2_000)]
    docs = docs_of(spark, list(enumerate(texts)))
    spark.conf.set("spark.skein.chunk.bytes", "200000")
    try:
        before = shuffled(spark)
        resampling.weigh(docs, docs.limit(3)).write.format("noop").mode("overwrite").save()
        took = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.skein.chunk.bytes")
    assert 0 < took < 2.5 * sum(map(len, texts)), took / sum(map(len, texts))


def test_hashes_are_those_of_the_strings():
    vocabulary = pa.array([b"a", "éè".encode(), b"0123456789" * 7, b"word"])
    columns = [np.array(c, np.int32) for c in ([1, 2, 3, 4, 1, 3], [0, 0, 3, 1, 2, 4], [0, 0, 0, 2, 3, 3])]
    names = [b" ".join(vocabulary[k - 1].as_py() for k in row if k) for row in zip(*columns, strict=True)]
    assert resampling.hashes_of(vocabulary)(columns).tolist() == [zlib.crc32(x) for x in names]


def test_messages_bring_back_their_strings():
    texts = ["the cat and the dog and the cat", "a rare bird and the cat", "", "the the the the"]
    common = zstandard.compress(b"the and cat")
    packs = list(resampling.packed(iter([pa.RecordBatch.from_pydict({"chunk": pa.array([0] * 4, pa.int32()), "doc_id": pa.array(range(4)), "text": texts})])))
    answers = resampling._ask(3, 3, common, 1)((pa.scalar(0),), pa.Table.from_batches(packs))
    got = collections.Counter()
    for blob in answers.column("blob").to_pylist():
        words, *sections = ex.unbundle(blob)
        rare = zstandard.decompress(words).split()
        names = [b"the", b"and", b"cat", *rare]
        for section in sections:
            columns, counts = resampling.strings_told(section, 3, np.arange(4, 4 + len(rare), dtype=np.int32))
            for *row, n in zip(*columns, counts, strict=True):
                got[b" ".join(names[k - 1] for k in row if k).decode()] += int(n) + 1
    assert got == collections.Counter(g for t in texts for g in grams(t)[1])
