"""Language-model scoring by masked pseudo-likelihood.

A window network predicts every token from the ``SIDE`` tokens on either side of it: their embeddings, one table per
place, are added up, squashed and mapped to the vocabulary in two steps, first to one of ``GROUPS`` groups of tokens and
then to a token of the group, so that a token costs two short softmaxes instead of a long one.  A document's score is the sum of
the log-probabilities of its words, each given its window; ``mean`` is the score per word.

The tokens of the network are the ``VOCABULARY - 1 - CLASSES`` most frequent words and ``CLASSES`` classes, to which every
other word belongs by its length and its first and last byte.  The probability of such a word is that of its class in the
window times its share of the class, ``(n + 1) / (N + D + 1)``: n counts the word in all documents, N the words of the
class, D the different ones, and the last 1 is left for a word that no document holds.  So every word of the corpus has a
probability of its own, and the table of counts grows with the corpus.  It stays distributed: ``HELD`` words travel with
the network, the others are joined by word.

Counting reads all documents.  Training is data-parallel in numpy: in each round every partition starts from the same
weights, learns from its own documents and hands on its weights, which Spark averages by the number of tokens.  The rounds
share the documents out by hash of the text, so that each is learned from once.  What comes to the driver are the held
words, the totals per class and one set of weights, whatever the corpus holds; what the partitions hand on grows with it.

Null and empty texts have no tokens, score 0 and a null mean.  An empty table gives an empty result.  Rows that repeat,
in id, text or both, are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import LOWER, text_batches, texts
from muster.session import materialise

SIDE = 2
HIDDEN = 32
#: Token 0 stands beyond either end of a text; then come the classes of other words and the vocabulary.
CLASSES = 31
VOCABULARY = 256
#: Words whose counts travel with the network; the counts of all others are joined.
HELD = 100_000
GROUPS = 16
MEMBERS = VOCABULARY // GROUPS
#: Tokens scored at once, and learned from in one step.
STEP = 2048
#: Logits up to this size are exponentiated as they are.
LARGE = 30.0
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def count_words(docs: DataFrame) -> DataFrame:
    """``word, kind, n``: every word of all documents, the class it would belong to, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            words = pa.array(seen.keys(), pa.large_binary())
            return pa.RecordBatch.from_arrays(
                [words.cast(pa.binary()), pa.array(shape_class(words), pa.int32()), pa.array(seen.values(), pa.int64())],
                names=["word", "kind", "n"],
            )

        total: Counter[bytes] = Counter()
        for _, values in text_batches(batches):
            for text in values:
                total.update(words_of(text))
            if len(total) > 200_000:
                yield rows(total)
                total = Counter()
        yield rows(total)

    return docs.mapInArrow(run, "word binary, kind int, n bigint").groupBy("word", "kind").agg(F.sum("n").alias("n"))


def shape_class(words: pa.Array) -> np.ndarray:
    """A class from a word's length and its first and last byte, for words outside the vocabulary."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and ends[-1] else np.zeros(1, np.uint8)
    first, last = raw[np.minimum(ends[:-1], len(raw) - 1)], raw[np.maximum(ends[1:] - 1, 0)]
    return 1 + (np.diff(ends) * 13 + first.astype(np.int64) * 7 + last.astype(np.int64) * 5) % CLASSES


@dataclass
class Network:
    words: list[bytes]
    near: np.ndarray  # place in the window, token, hidden
    bias: np.ndarray
    group: np.ndarray  # hidden and a constant, group
    member: np.ndarray  # group, hidden and a constant, token of the group

    @classmethod
    def start(cls, words: list[bytes], seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        return cls(words, small(2 * SIDE, VOCABULARY, HIDDEN), np.zeros(HIDDEN, np.float32),
                   small(HIDDEN + 1, GROUPS), small(GROUPS, HIDDEN + 1, MEMBERS))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.near, self.bias, self.group, self.member]

    def pack(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def unpacked(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for w in self.weights:
            parts.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return Network(self.words, *parts)

    def tokens(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """All tokens with SIDE empty places around each text; the positions of the tokens, their text and their word;
        and the different words."""
        lowered = pa.array([v.translate(LOWER) for v in values], pa.large_binary()).view(pa.large_string())
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.view(pa.large_binary())
        token = shape_class(words)
        known = pc.index_in(words, value_set=pa.array(self.words, pa.large_binary()))
        known = known.fill_null(-1).to_numpy(zero_copy_only=False)
        token[known >= 0] = known[known >= 0] + 1 + CLASSES
        index = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(values)), np.diff(lists.offsets.to_numpy()))
        there = np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1])[index] > 0
        index, doc = index[there], doc[there]
        at = np.arange(len(doc)) + SIDE * (doc + 1)
        flat = np.zeros(len(doc) + SIDE * (len(values) + 1), np.uint8)
        flat[at] = token[index]
        return flat, at, doc, index, words

    def hidden(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The squashed sums of embeddings, and a constant 1 as the last column."""
        total = self.near[0].take(flat[at + OFFSETS[0]], axis=0)
        for place, offset in enumerate(OFFSETS[1:], 1):
            total += self.near[place].take(flat[at + offset], axis=0)
        total += self.bias
        both = np.ones((len(at), HIDDEN + 1), np.float32)
        np.tanh(total, out=both[:, :HIDDEN])
        return both

    def by_group(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the positions by the group of their token, and (group, start, end) of each group there."""
        group = flat[at] // MEMBERS
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]

    def member_logits(self, hidden: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
        out = np.empty((len(hidden), MEMBERS), np.float32)
        for g, a, b in groups:
            np.matmul(hidden[a:b], self.member[g], out=out[a:b])
        return out

    def score(self, flat: np.ndarray, at: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        """The sum of the log-probabilities of each text's tokens."""
        total = np.zeros(texts)
        for start in range(0, len(at), STEP):
            order, groups = self.by_group(flat, at[start : start + STEP])
            part, of = at[start : start + STEP][order], doc[start : start + STEP][order]
            hidden, token, row = self.hidden(flat, part), flat[part], np.arange(len(part))
            log_p = 0.0
            for logits, target in (
                (hidden @ self.group, token // MEMBERS), (self.member_logits(hidden, groups), token % MEMBERS)
            ):
                bounded(logits)
                log_p = log_p + logits[row, target] - np.log(row_sums(np.exp(logits)))
            first = doc[start]
            sums = np.bincount(of - first, log_p)
            total[first : first + len(sums)] += sums
        return total


def bounded(logits: np.ndarray) -> None:
    """Shift rows by their maximum, which no softmax notices, where an exponential could leave the range of floats."""
    if logits.max(initial=0) > LARGE or logits.min(initial=0) < -LARGE:
        logits -= logits.max(axis=1, keepdims=True)


def row_sums(values: np.ndarray) -> np.ndarray:
    """A product with ones: far faster than a sum along short rows."""
    return values @ np.ones(values.shape[1], values.dtype)


def softmax_error(logits: np.ndarray, target: np.ndarray, scale: np.float32) -> np.ndarray:
    """The scaled gradient of the log loss by the logits, in their place."""
    bounded(logits)
    np.exp(logits, out=logits)
    logits *= (scale / row_sums(logits))[:, None]
    logits[np.arange(len(target)), target] -= scale
    return logits


class Trainer:
    """Adagrad steps on windows of shuffled tokens."""

    def __init__(self, network: Network, rate: float):
        self.net, self.rate, self.rng = network, rate, np.random.default_rng(1)
        self.seen = [np.full(w.shape, 1e-4, np.float32) for w in network.weights]
        self.n = 0

    def learn(self, values: list[bytes]) -> None:
        flat, at, *_ = self.net.tokens(values)
        at = self.rng.permutation(at)
        self.n += len(at)
        for start in range(0, len(at), STEP):
            self.step(flat, at[start : start + STEP])

    def step(self, flat: np.ndarray, at: np.ndarray) -> None:
        net, scale = self.net, np.float32(1 / len(at))
        order, groups = net.by_group(flat, at)
        at = at[order]
        hidden, token = net.hidden(flat, at), flat[at]
        of_group = softmax_error(hidden @ net.group, token // MEMBERS, scale)
        of_member = softmax_error(net.member_logits(hidden, groups), token % MEMBERS, scale)
        d_hidden = of_group @ net.group[:HIDDEN].T
        d_member = np.zeros_like(net.member)
        for g, a, b in groups:
            d_hidden[a:b] += of_member[a:b] @ net.member[g, :HIDDEN].T
            d_member[g] = hidden[a:b].T @ of_member[a:b]
        squashed = hidden[:, :HIDDEN]
        d_hidden *= 1 - squashed * squashed
        d_near = np.zeros_like(net.near)
        for place, offset in enumerate(OFFSETS):
            near = flat[at + offset]
            order = np.argsort(near, kind="stable")
            near = near[order]
            first = np.concatenate([[0], np.nonzero(np.diff(near))[0] + 1])
            d_near[place, near[first]] = np.add.reduceat(d_hidden.take(order, axis=0), first, axis=0)
        grads = [d_near, d_hidden.sum(0), hidden.T @ of_group, d_member]
        for w, seen, grad in zip(net.weights, self.seen, grads, strict=True):
            seen += grad * grad
            w -= self.rate * grad / np.sqrt(seen)


@dataclass
class Model:
    network: Network
    held: list[bytes]  # the most frequent words that are no tokens of the network, and how often each occurs
    held_n: np.ndarray
    sizes: np.ndarray  # by class: occurrences, different words and 1 for a word not seen
    counts: DataFrame  # word, n of all other words


def train(docs: DataFrame, network: Network, part: int, parts: int, rate: float) -> Network:
    """One round: every partition learns from its documents of the part, and the weights are averaged."""
    mine = docs if parts == 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part % parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(network.unpacked(network.pack()), rate)
        for _, values in text_batches(batches):
            trainer.learn(values)
        if trainer.n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([trainer.n], pa.int64()), pa.array([trainer.net.pack()], pa.list_(pa.float32()))],
                names=["n", "weights"],
            )

    learned = mine.mapInArrow(run, "n bigint, weights array<float>")
    each = learned.select("n", F.posexplode("weights").alias("at", "w"))
    mean = each.groupBy("at").agg((F.sum(F.col("n") * F.col("w").cast("double")) / F.sum("n")).alias("w"))
    rows = mean.collect()  # as many as the network has weights
    if not rows:
        return network
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["at"]] = r["w"]
    return network.unpacked(flat)


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rounds: tuple[tuple[int, float], ...] = ((2, 0.1), (2, 0.05)), held: int = HELD,
) -> Model:
    """The model after the rounds, each given as (parts, rate): round i learns from part i of so many, by hash."""
    docs = texts(df, id_col, text_col)
    counts = materialise(count_words(docs), "words")
    tokens = VOCABULARY - 1 - CLASSES
    top = counts.orderBy(F.desc("n"), "word").limit(tokens + held).collect()
    network = Network.start([bytes(r["word"]) for r in top[:tokens]])
    sizes = np.ones(CLASSES + 1)
    for r in counts.groupBy("kind").agg((F.sum("n") + F.count("n")).alias("size")).collect():  # a row per class
        sizes[r["kind"]] += r["size"]
    for r in top[:tokens]:
        sizes[r["kind"]] -= r["n"] + 1
    for part, (parts, rate) in enumerate(rounds):
        network = train(docs, network, part, parts, rate)
    rest = counts
    if top:  # the words after the last one held, in the same order
        last = top[-1]
        after = (F.col("n") == last["n"]) & (F.col("word") > F.lit(bytearray(last["word"])))
        rest = counts.where((F.col("n") < last["n"]) | after)
    kept = top[tokens:]
    return Model(network, [bytes(r["word"]) for r in kept], np.array([r["n"] for r in kept], np.float64), sizes,
                 rest.select("word", "n"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean`` of every row.

    A worker adds up all but the counts of words that are not held; these words go into a written table, whose row
    numbers bring a row's parts together after the join by word.
    """
    network, held, sizes = model.network, model.held, np.log(model.sizes)
    held_logs = np.append(np.log(model.held_n + 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(held, pa.large_binary())
        for ids, values in text_batches(batches):
            flat, at, doc, index, words = network.tokens(values)
            total = network.score(flat, at, doc, len(values))
            token = flat[at]
            other = (token > 0) & (token <= CLASSES)
            doc_of, word = doc[other], index[other]
            place = pc.index_in(words, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False)[word]
            share = held_logs[place] - sizes[token[other]]
            total += np.bincount(doc_of, share, minlength=len(values))
            rare = place < 0
            pair, times = np.unique(doc_of[rare].astype(np.int64) * max(len(words), 1) + word[rare], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(values) + 1, dtype=np.int64) * max(len(words), 1))
            items = pa.StructArray.from_arrays(
                [words.take(pa.array(pair % max(len(words), 1))).cast(pa.binary()), pa.array(times, pa.int32())],
                names=["word", "times"],
            )
            n = np.bincount(doc, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                names=["doc_id", "n_tokens", "known", "rare"],
            )

    schema = "doc_id bigint, n_tokens bigint, known double, rare array<struct<word:binary,times:int>>"
    rows = texts(df, id_col, text_col).mapInArrow(run, schema)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = rows.select("row", F.inline("rare"))
    more = words.join(model.counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log1p("n")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0.0))
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_tokens", total.alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean"),
    )
