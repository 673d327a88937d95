"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: runs of ``PASSAGE`` words, the last one shorter.  A passage is encoded by what its
characters and words look like; a gated attention layer, learned from document labels only, weighs the passages, and the
weighted representation is scored.  Every passage of every document counts, however long the document is.

The network is fitted in numpy on at most ``most`` labelled documents per class, weighted to the classes' true shares,
so the score is an estimate of the probability of label 1.  Scoring is row by row; no text is shuffled.

Null and empty texts are one passage without words.  Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import text_batches
from muster.llm.linear import labelled_sample, sigmoid

PASSAGE = 64
HIDDEN = 16
ATTENTION = 8

#: Byte classes: lower, upper, digit, blank, line end, sentence marks, other ASCII, above 127.
CLASS = np.full(256, 6, np.uint8)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
CLASS[[9, 11, 12, 13, 32]], CLASS[10], CLASS[[ord(c) for c in ".,;:?'-\""]], CLASS[128:] = 3, 4, 5, 7
N_FEATURES = 16


def encode(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the document each belongs to; passages are in order and every text has one."""
    tokens = [v.split() for v in values]
    sizes = np.array([len(t) for t in tokens])
    flat = [w for t in tokens for w in t]
    per_doc = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(len(values)), per_doc)
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    n = len(doc)
    x = np.zeros((n, N_FEATURES), np.float32)
    if not flat:
        return x, doc
    in_doc = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + in_doc // PASSAGE
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    # what a word looks like, once per distinct word
    length = np.array([len(w) for w in words])
    joined = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(length) - length
    kinds = CLASS[joined]
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(8)], 1)
    last, ahead = kinds[starts + length - 1], kinds[starts]
    look = np.column_stack([
        length, counts[:, 0], counts[:, 1], counts[:, 2], counts[:, 5], counts[:, 6], counts[:, 7],
        (counts[:, 1] == length) & (length > 1), (counts[:, 0] == 0) & (counts[:, 1] > 0), last == 6, ahead == 6,
        (counts[:, 0] + counts[:, 1] + counts[:, 7]) == 0,
    ]).astype(np.float32)
    each = np.stack([np.bincount(passage, look[index, k], n) for k in range(look.shape[1])], 1)
    many = np.bincount(passage, minlength=n).astype(np.float32)
    key, times = np.unique(passage * np.int64(len(words)) + index, return_counts=True)
    of = key // len(words)
    distinct = np.bincount(of, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    again = np.bincount(passage[1:], (index[1:] == index[:-1]) & (passage[1:] == passage[:-1]), n)
    words_there, bytes_there = np.maximum(many, 1), np.maximum(each[:, 0], 1)
    x[:, 0] = each[:, 0] / words_there / 10
    x[:, 1:7] = each[:, 1:7] / bytes_there[:, None]
    x[:, 7:12] = each[:, 7:12] / words_there[:, None]
    x[:, 12] = distinct / words_there
    x[:, 13] = most / words_there
    x[:, 14] = again / words_there
    x[:, 15] = np.log1p(many) / 4
    return x, doc


class Attention:
    """Encoder, gated attention and score, with their gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {
            "w": start(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": start(HIDDEN, ATTENTION),
            "u": start(HIDDEN, ATTENTION), "a": start(ATTENTION, 1)[:, 0], "c": start(HIDDEN, 1)[:, 0],
            "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        weight = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return x, h, t, g, weight, z, sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """One score per document; ``doc`` counts up from 0 without gaps."""
        starts = np.searchsorted(doc, np.arange(doc[-1] + 1))
        return self.forward(x, starts, doc)[-1]

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, rate: float = 0.02):
        """Adam on the weighted log loss with a little weight decay, over all bags at once."""
        p, share = self.p, (weight / weight.sum()).astype(np.float32)
        starts = np.searchsorted(doc, np.arange(doc[-1] + 1))
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            xs, h, t, g, attention, z, out = self.forward(x, starts, doc)
            error = share * (out - y)
            dz = (error[:, None] * p["c"])[doc]
            dh = attention[:, None] * dz
            along = (dz * h).sum(1)
            de = attention * (along - np.add.reduceat(attention * along, starts)[doc])
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            dh += dt @ p["v"].T + dg @ p["u"].T
            ds = dh * (1 - h * h)
            grads = {"w": xs.T @ ds, "b": ds.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de,
                     "c": z.T @ error, "d": error.sum(keepdims=True)}
            for k, grad in grads.items():
                grad = grad + 1e-5 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                even = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                p[k] = (p[k] - rate * first[k] / (1 - 0.9**step) / even).astype(np.float32)
        return self


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = 3000, rounds: int = 300,
) -> Attention | None:
    """The fitted network, or None without labels of both classes.

    What comes to the driver are the passages' features of at most ``2 * most`` documents.
    """
    sample, share = labelled_sample(docs, labels, id_col, text_col, label_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_of, done = batch.column(2), 0
            for ids, values in text_batches(iter([batch])):
                x, doc = encode(values)
                bags = np.split(x, np.nonzero(np.diff(doc))[0] + 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, labels_of.slice(done, len(values)), pa.array([b.tobytes() for b in bags], pa.binary())],
                    names=["doc_id", "label", "bag"],
                )
                done += len(values)

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, bag binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x, doc = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    weight = np.array([share[int(label)] for label in y], np.float32)
    return Attention(x.mean(0), x.std(0) + 1e-3).fit(x, doc, y, weight, rounds)


def score(
    df: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in text_batches(batches):
            out = np.full(len(values), 0.5) if model is None else model.score(*encode(values)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out)], names=["doc_id", "score"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
