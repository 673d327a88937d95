"""Toxicity by classifier chains.

Categories are predicted one after the other; each linear model also gets the probabilities of the categories before
it.  For training these are out-of-fold: a document's earlier probabilities come from models that did not see it.  The
last category is the label itself; the ones before it are the label restricted to documents that hold a word of a family
(``FAMILIES``).

Features are words and their beginnings of three to seven letters, hashed; a feature's value is
``log(1 + 1000 * count / words)``.  From a sample of at most ``most`` labelled documents per class, documents per feature
and class are counted in Spark, the features that tell the classes apart best are chosen, and the chain is fitted in
numpy on those.  Scoring then looks at the chosen features only, row by row; no text is shuffled.

The rejection threshold is the probability at which the out-of-fold predictions, weighted to the classes' true shares,
have the best F score; a ``beta`` of 0.5 counts precision twice as much as recall, so clean documents stay.

Null and empty texts have no features and get the model's base rate.  Without labels of both classes every probability
is 0 and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import text_batches
from muster.llm.decontaminate import WORDS
from muster.llm.linear import labelled_sample, logistic, sigmoid

#: Word families that make categories of their own.
FAMILIES = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "pathetic"),
    "contempt": ("trash", "scum", "worthless", "disgusting"),
}
BUCKETS = 1 << 18
FOLDS = 4


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(WORDS).split()


def buckets(word: str) -> set[int]:
    import xxhash

    parts = {word, *("^" + word[:n] for n in range(3, 8) if len(word) >= n)}
    return {xxhash.xxh3_64_intdigest(p, 4) % BUCKETS for p in parts}


def doc_features(
    values: list[bytes], chosen: dict[int, int] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) triples and the number of words of each document; all buckets if none are chosen."""
    tokens = [words_of(v) for v in values]
    sizes = np.array([len(t) for t in tokens])
    coded = pa.array([w for t in tokens for w in t], pa.binary()).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    of_word, starts = [], [0]
    for word in coded.dictionary.to_pylist():
        found = buckets(word.decode())
        of_word.extend(found if chosen is None else (chosen[b] for b in found if b in chosen))
        starts.append(len(of_word))
    starts, of_word = np.array(starts), np.array(of_word, np.int64)
    many = np.diff(starts)[index] if len(index) else np.zeros(0, int)
    doc = np.repeat(np.arange(len(values)), sizes)
    some = many > 0
    index, many, doc = index[some], many[some], doc[some]
    first = np.repeat(starts[index] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(index) else index, many)
    feature = of_word[first + np.arange(len(first))] if len(first) else np.zeros(0, np.int64)
    pairs, count = np.unique(np.repeat(doc, many) * BUCKETS + feature, return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, count, sizes


def values_of(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(1000 * count / np.maximum(words, 1)).astype(np.float32)


@dataclass
class Chain:
    names: list[str]
    chosen: dict[int, int]
    weights: list[np.ndarray]  # per category: the chosen features, then the earlier categories
    biases: list[float]
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category."""
        out = np.zeros((len(x), len(self.names)), np.float32)
        for at, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[:, at] = sigmoid(x @ w[: x.shape[1]] + out[:, :at] @ w[x.shape[1] :] + b)
        return out


def choose(sample: DataFrame, n_features: int) -> dict[int, int]:
    """The buckets whose share of documents differs most between the classes (chi square); at most ``n_features``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for label, values in text_batches(batches):
            doc, feature, _, _ = doc_features(values, None)
            of = label.to_numpy(zero_copy_only=False)[doc]
            for c in (0, 1):
                total[c] += np.bincount(feature[of == c], minlength=BUCKETS)
        seen = np.nonzero(total.sum(0))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], names=["bucket", "n0", "n1"]
        )

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    tally = sample.select("label", "text").mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint")
    tally = tally.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = F.lit(float(sizes[0])), F.lit(float(sizes[1]))
    a, b = F.col("n1"), F.col("n0")
    rest = all0 + all1 - a - b + 1
    chi = (all0 + all1) * F.pow(a * (all0 - b) - b * (all1 - a), F.lit(2)) / ((a + b) * rest * all0 * all1)
    best = tally.where("n0 + n1 >= 3").select("bucket", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(n_features)
    return {r["bucket"]: at for at, r in enumerate(best.collect())}


def vectors(sample: DataFrame, chosen: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels with the families' categories, and features of the sample; its size is bounded by the sample's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            done = 0
            for ids, values in text_batches(iter([batch])):
                doc, feature, count, sizes = doc_features(values, chosen)
                value = values_of(count, sizes[doc])
                ends = np.searchsorted(doc, np.arange(len(values) + 1))
                rows = {"doc_id": ids, "label": labels[done : done + len(values)], "families": [], "x": [], "v": []}
                done += len(values)
                for at, text in enumerate(values):
                    words = set(words_of(text))
                    rows["families"].append([not words.isdisjoint(w.encode() for w in f) for f in FAMILIES.values()])
                    rows["x"].append(feature[ends[at] : ends[at + 1]])
                    rows["v"].append(value[ends[at] : ends[at + 1]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows["doc_id"], "label": pa.array(rows["label"], pa.int32()),
                    "families": pa.array(rows["families"], pa.list_(pa.bool_())),
                    "x": pa.array(rows["x"], pa.list_(pa.int64())), "v": pa.array(rows["v"], pa.list_(pa.float32())),
                })

    schema = "doc_id bigint, label int, families array<boolean>, x array<bigint>, v array<float>"
    rows = sample.select("doc_id", "text", "label").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for at, r in enumerate(rows):
        x[at, r["x"]] = r["v"]
    y = np.array([[r["label"] and f for f in r["families"]] + [r["label"]] for r in rows], np.float32)
    return np.array([r["doc_id"] for r in rows]), y, x


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most: int = 4000, n_features: int = 2048, beta: float = 0.5, penalty: float = 3e-4,
) -> Chain | None:
    """The fitted chain, or None without labels of both classes."""
    sample, share = labelled_sample(docs, labels, id_col, text_col, label_col, most)
    chosen = choose(sample, n_features)
    if not chosen:
        return None
    ids, y, x = vectors(sample, chosen)
    weight = np.array([share[int(label)] for label in y[:, -1]], np.float32)
    fold = np.random.default_rng(3).integers(0, FOLDS, len(ids))
    earlier = np.zeros((len(ids), 0), np.float32)
    weights, biases = [], []
    for category in y.T:
        both = np.hstack([x, earlier])
        out = np.zeros(len(ids), np.float32)
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            w, b = logistic(both[train], category[train], weight[train], penalty)
            out[test] = sigmoid(both[test] @ w + b)
        w, b = logistic(both, category, weight, penalty)
        weights.append(w)
        biases.append(b)
        earlier = np.hstack([earlier, out[:, None]])
    order = np.argsort(-earlier[:, -1], kind="stable")
    caught, taken = np.cumsum((y[:, -1] * weight)[order]), np.cumsum(weight[order])
    best = int(np.argmax((1 + beta**2) * caught / (beta**2 * caught[-1] + taken)))
    ranked = earlier[order, -1]
    threshold = float(ranked[best] + ranked[min(best + 1, len(ranked) - 1)]) / 2
    return Chain([*FAMILIES, label_col], chosen, weights, biases, threshold)


def score(
    df: DataFrame, chain: Chain | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns of every row, the text among them if named, with ``p_<category>`` and ``rejected``."""
    names = chain.names if chain else [*FAMILIES, "toxic"]
    outputs = [f"p_{n}" for n in names]
    others = [k for k in keep if k != text_col]
    rows = df.select(F.lit(0).alias("_none"), F.col(text_col).cast("string").alias("_text"), *[F.col(k) for k in others])
    place = {k: 1 if k == text_col else 2 + others.index(k) for k in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, values in text_batches(iter([batch])):
                if chain is None:
                    p = np.zeros((len(values), len(names)), np.float32)
                else:
                    doc, feature, count, sizes = doc_features(values, chain.chosen)
                    x = np.zeros((len(values), len(chain.chosen)), np.float32)
                    x[doc, feature] = values_of(count, sizes[doc])
                    p = chain.probabilities(x)
                kept = [batch.column(place[k]).slice(done, len(values)) for k in keep]
                done += len(values)
                out = chain is not None and p[:, -1] >= chain.threshold
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(p[:, at].astype(np.float64)) for at in range(len(names))],
                     pa.array(np.broadcast_to(out, len(values)))],
                    names=[*keep, *outputs, "rejected"],
                )

    fields = [f"`{k}` {rows.schema.fields[place[k]].dataType.simpleString()}" for k in keep]
    return rows.mapInArrow(run, ", ".join([*fields, *[f"`{o}` double" for o in outputs], "rejected boolean"]))
