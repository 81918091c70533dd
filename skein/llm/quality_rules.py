"""Quality rules with line labels: a linear-chain conditional random field marks each line content or boilerplate.

Per text: counts of words, symbols, repeated lines and repeated 5-word windows, a base rule over them, and the content share,
the part of the words that stand in lines which Viterbi decoding marks as content.  A text is kept if the base rule does not
fail it and the share reaches `min_share`.

The field is fitted on a bounded sample (`max_train` labelled documents).  Line labels come from document labels: lines of good documents
are content; lines of bad ones begin as boilerplate and are decoded anew by the fitted field, `rounds` times.

Defined cases: null is treated as the empty text, which has no words, fails the base rule and has a content share of 1;
lines without a word take the state of their neighbours and carry no weight.  Without labels of both kinds all lines are
content.  Repeated rows each get a row.  A text of very many lines is held with 11 numbers a line.  Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import DIGIT, HIGH, LOUD, LOWER, N_CLASSES, PUNCT, STOP, SYMBOL, UPPER, WHITE, pair_counts, repeated_window_words, rows

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 11


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text or "") - (len(data) - len(data.translate(None, WHITE)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words)


def _features(lines: list[bytes], seen: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])[:-1])).astype(np.int64)
    counts = pair_counts(b"\n".join(lines) + b"\n", starts).reshape(len(lines), N_CLASSES, N_CLASSES).sum(2)
    size = np.maximum(1.0, np.array([len(x) for x in lines], float))
    words = np.array([len(x.split()) for x in lines], float)
    again = np.zeros(len(lines))
    for i, x in enumerate(lines):
        again[i] = x in seen
        seen.add(x)
    letters = np.maximum(1.0, counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH])
    out = np.stack([
        np.ones(len(lines)), counts[:, SYMBOL] / size, counts[:, UPPER] / letters, counts[:, DIGIT] / size, counts[:, LOUD] / np.maximum(1, words), counts[:, STOP] / np.maximum(1, words),
        counts[:, PUNCT] / size, counts[:, SYMBOL] / np.maximum(1, words), again, np.log1p(words) / 4, size / np.maximum(1, words) / 20,
    ], 1)
    return np.minimum(out, 3.0), words


def line_features(data: bytes, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Features of each \\n-split line, and its number of words; counted for `block` lines at a time, so that many short lines stay small."""
    lines, seen = data.split(b"\n"), set()
    parts = [_features(lines[at : at + block], seen) for at in range(0, len(lines), block)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([w for _, w in parts])


class Chains:
    """Sequences of lines side by side, longest first: at each place, the lines of all sequences that are that long."""

    def __init__(self, seqs: list[np.ndarray]):
        size = np.array([len(x) for x in seqs])
        order = np.argsort(-size, kind="stable")
        self.x = np.concatenate([seqs[k] for k in order])
        first = np.concatenate(([0], np.cumsum(size[order])[:-1])).astype(np.int64)
        live = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), "right")
        self.at = [first[:n] + place for place, n in enumerate(live.tolist())]
        self.size, self.order = size[order], order

    def sums(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State marginals of each line, and the expected transitions of all, by scaled forward and backward sums."""
        emit = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], 1)
        move = np.exp(trans)
        fwd, bwd = np.empty((len(score), 2)), np.ones((len(score), 2))
        for place, at in enumerate(self.at):
            f = emit[at] if not place else fwd[self.at[place - 1][: len(at)]] @ move * emit[at]
            fwd[at] = f / f.sum(1, keepdims=True)
        pair = np.zeros((2, 2))
        for place in range(len(self.at) - 1, 0, -1):
            at = self.at[place]
            before = self.at[place - 1][: len(at)]
            ahead = emit[at] * bwd[at]
            b = ahead @ move.T
            p = fwd[before][:, :, None] * move * ahead[:, None, :]
            pair += (p / p.sum((1, 2), keepdims=True)).sum(0)
            bwd[before] = b / b.sum(1, keepdims=True)
        state = fwd * bwd
        return state / state.sum(1, keepdims=True), pair


class LineField:
    """A linear-chain field of two states, content (0) and boilerplate (1): w scores boilerplate, trans the neighbours."""

    def __init__(self):
        self.w, self.trans, self.trivial = np.zeros(N_FEATURES), np.zeros((2, 2)), True

    def fit(self, seqs: list[np.ndarray], bad: list[bool], rounds: int = 2, steps: int = 40, rate: float = 0.2, decay: float = 1e-3) -> LineField:
        if not seqs or len(set(bad)) < 2:
            return self
        self.trivial = False
        chains = Chains(seqs)
        weight = 1.0 / len(chains.x)
        for turn in range(rounds):
            ys = [np.full(len(seqs[k]), int(bad[k])) if not turn or not bad[k] else self.decode(seqs[k]) for k in chains.order]
            y = np.concatenate(ys)
            real = sum(np.bincount(own[:-1] * 2 + own[1:], minlength=4) for own in ys).reshape(2, 2)
            m, s = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
            for step in range(1, steps + 1):
                state, pair = chains.sums(chains.x @ self.w, self.trans)
                grad = decay * self.w + weight * (chains.x.T @ (state[:, 1] - y))
                edge = decay * self.trans + weight * (pair - real)
                g = np.concatenate((grad, edge.ravel()))
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                self.w -= move[:N_FEATURES]
                self.trans -= move[N_FEATURES:].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of each line.  Equal scores go to content."""
        if self.trivial:
            return np.zeros(len(x), np.int64)
        (t00, t01), (t10, t11) = self.trans.tolist()
        a, b, back = 0.0, 0.0, []
        for i, e in enumerate((x @ self.w).tolist()):
            if i == 0:
                b = e
                continue
            to0, to1 = a + t00 < b + t10, a + t01 < b + t11
            a, b = (b + t10 if to0 else a + t00), (b + t11 if to1 else a + t01) + e
            back.append((to0, to1))
        state, out = int(b > a), [int(b > a)]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return np.array(out[::-1], np.int64)

    def content(self, text: str | None) -> tuple[float, int, np.ndarray]:
        """Content share, number of lines, and the state of each line."""
        x, words = line_features((text or "").encode("utf-8", "surrogatepass"))
        states = self.decode(x)
        return (float(words[states == 0].sum() / words.sum()) if words.sum() else 1.0), len(x), states


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 600) -> LineField:
    """Fits on the whole line sequences of at most max_train labelled documents, half of each label where there are enough; of repeated rows of one id, on one."""

    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    part = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2) for k in (0, 1)]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([line_features(t or b"")[0].tobytes() for t in texts], pa.binary())], ["doc_id", "label", "x"])

    sample = own.join(F.broadcast(part[0].unionByName(part[1])), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
    got = sample.mapInArrow(features, "doc_id long, label int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return LineField().fit([np.frombuffer(r.x, np.float64).reshape(-1, N_FEATURES) for r in got], [r.label == 0 for r in got])


def judge(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, n_lines, n_content_lines, content_share and kept for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            lines = [model.content(t) for t in texts]
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            share = np.array([x for x, _, _ in lines], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array([n for _, n, _ in lines], pa.int64()), pa.array([int((s == 0).sum()) for _, _, s in lines], pa.int64()), pa.array(share), pa.array(~failed & (share >= min_share))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_content_lines", "content_share", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is kept: the same verdict as judge(), taken beside the row."""
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        out = []
        for t in texts:
            base = base_counts(t)
            out.append(base[0] >= 10 and 100 * base[4] <= 20 * base[0] and model.content(t)[0] >= 0.5)
        return pd.Series(out, dtype=bool)

    return docs.filter(kept(F.col("text")))


def op1_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
