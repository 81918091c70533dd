"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from its pairs of adjacent byte classes and its words; a gated
attention layer, learned from document labels alone, weighs the encodings, and the weighted sum is scored:

    h_k = tanh(W x_k + b),  a = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))),  score = sigmoid(c . sum_k a_k h_k + d)

The fit takes a bounded sample (`max_train` labelled rows, in the order of a hash of the id); every document is scored whole.

Defined cases: null and empty texts are one passage without bytes and get the model's score for it; with no labels, or of
one kind only, every score is the smoothed share of label 1.  A document with several labels counts with the largest; null
labels are left out.  Repeated rows each get a row; of those of one
labelled id, one is learned from.  Only the named columns are read, so others may clash freely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import N_CLASSES, id_remainder, pair_counts, rows

PASSAGE = 512
N_FEATURES = N_CLASSES * N_CLASSES + 4


def passage_starts(data: bytes) -> np.ndarray:
    """Passages of about PASSAGE bytes, cut after white space; they tile the text."""
    if len(data) <= PASSAGE:
        return np.zeros(1, np.int64)
    blanks = np.flatnonzero(np.isin(np.frombuffer(data, np.uint8), (32, 10, 9, 13)))
    after = np.searchsorted(blanks, np.arange(PASSAGE, len(data), PASSAGE))
    starts = blanks[after[after < len(blanks)]] + 1
    return np.unique(np.concatenate(([0], starts[starts < len(data)])))


def encode(data: bytes | None) -> np.ndarray:
    """One row of features for each passage."""
    data = data or b""
    starts = passage_starts(data)
    counts = pair_counts(data, starts)
    out = np.empty((len(starts), N_FEATURES))
    length = np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, :-4] = np.sqrt(counts / length)
    ends = np.append(starts[1:], len(data))
    words = [data[a:b].split() for a, b in zip(starts, ends, strict=True)]
    seen: set[bytes] = set()
    for k, own in enumerate(words):
        distinct = set(own)
        out[k, -4] = len(distinct) / max(1, len(own))
        out[k, -3] = len(distinct - seen) / max(1, len(distinct))
        out[k, -2] = np.log1p(len(own)) / 6
        out[k, -1] = len(data[starts[k] : ends[k]]) / max(1, len(own)) / 20
        seen |= distinct
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """The model.  Bags are ragged: rows of all bags together, and the first row of each."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.mean, self.scale, self.prior = np.zeros(N_FEATURES), np.ones(N_FEATURES), None
        self.p = {
            "W": draw.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": draw.normal(0, hidden**-0.5, (hidden, gate)),
            "U": draw.normal(0, hidden**-0.5, (hidden, gate)), "w": draw.normal(0, gate**-0.5, gate), "c": draw.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> GatedAttention:
        if len(set(labels.tolist())) < 2:
            self.prior = float((labels.sum() + 1) / (len(labels) + 2))
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        del every
        draw, p = np.random.default_rng(1), self.p
        m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = (np.concatenate([bags[i] for i in pick]) - self.mean) / self.scale
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])[:-1]))
                f = self._forward(x, first)
                dy = (f["y"] - labels[pick]) / len(pick)
                dz = dy[:, None] * p["c"]
                da = (dz[f["bag"]] * f["h"]).sum(1)
                de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
                dv, du = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
                dh = (f["a"][:, None] * dz[f["bag"]] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
                grad = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
                t += 1
                for k, g in grad.items():
                    g = g + decay * p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None or not bags:
            return np.full(len(bags), self.prior)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(x, np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])))["y"]


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in rows(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([encode(t).astype(np.float32).tobytes() for t in texts], pa.binary())], ["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 2000) -> GatedAttention:
    """Fits on at most max_train labelled rows; the sample is chosen from the small label table, by a hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # so few rows may be broadcast
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = own.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label").mapInArrow(_encode_rows, "doc_id long, label int, bag binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.bag))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in found]
    return GatedAttention().fit(bags, np.array([r.label for r in found], np.float64))


def score(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches):
            out: list[np.ndarray] = []
            bags, held = [], 0
            for t in texts:
                bags.append(encode(t))
                held += len(bags[-1])
                if held > 4096:  # passages scored together; a longer text alone
                    out.append(model.predict(bags))
                    bags, held = [], 0
            out.append(model.predict(bags) if bags else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = fit(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
