"""Ranked lexical search by bag deduplication.

The text of a document is cut down to the terms that occur in some item: its *bag* is the sorted list of (term, times).
Documents with one bag and one length penalty ``m`` score alike for every item, so they form a class: rows are hashed by bag
and ``m``, rows of one hash are held against each other in full, a class is scored once and its members follow by
ascending id.

A term is a run of letters, digits and characters beyond ASCII after A-Z became a-z.  With N documents that have a term, L
terms in them, n in one of them, and df documents that hold a term, the term weighs ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``,
a document's ``m`` is ``100 - 25 + (25 * n * N) div L``, and its score the sum over the item's terms, repeats included, of
``w * ((10**9 * tf) div (1000 * tf + 12 * m))``.

Items come in blocks whose terms fit into ``block_bytes``; only a block's terms are handed to all tasks, and a larger
benchmark means more blocks (more passes over the documents), never a larger block; an item above that size has a block of
its own.  A class keeps its k smallest ids per task before anything is shuffled and k in all: a further member cannot be among an
item's k best.  A task hands on k documents per item.

Null texts have no term.  Rows without an id count in N, L and df, but cannot be returned.  Repeated rows are documents of
their own.  Items that share an id are one item with the terms of all their different texts; an item without an id is
ranked under null.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import text_batches, texts
from muster.session import materialise

BEST = 20
BLOCK_BYTES = 16 << 20
#: Scores and term hits a task holds at once.
CELLS = 1 << 22

_KEPT = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b in _KEPT else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in order."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term, times``: how often each item holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in text_batches(batches):
            for item, value in zip(ids.to_pylist(), values, strict=True):
                counts = Counter(terms(value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                     pa.array(list(counts.values()), pa.int64())],
                    names=["item_id", "term", "times"],
                )

    counted = texts(items, id_col, text_col).distinct().mapInArrow(run, "item_id bigint, term string, times bigint")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Block:
    """Items whose terms are handed to every task: the vocabulary, and who holds each term how often."""

    def __init__(self, rows: pa.Table):
        ids = rows["item_id"].to_pylist()
        self.items = list(dict.fromkeys(ids))
        number = {item: at for at, item in enumerate(self.items)}
        coded = rows["term"].combine_chunks().cast(pa.binary()).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words = coded.dictionary.to_pylist()
        self.vocabulary = {word: at for at, word in enumerate(words)}
        of = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        self.starts = np.searchsorted(of[order], np.arange(len(words) + 1))
        self.holders = np.array([number[i] for i in ids], np.int64)[order]
        self.times = rows["times"].to_numpy().astype(np.int64)[order]


def blocks(postings: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of at most ``block_bytes``, unless one item alone is larger."""
    size = F.octet_length("term") + 24
    parts, total, largest = 1, *postings.groupBy("item_id").agg(F.sum(size).alias("s")).agg(F.sum("s"), F.max("s")).first()
    while total and total > max(block_bytes, largest):
        part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        if postings.groupBy(part).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] <= max(block_bytes, largest):
            break
        parts *= 2
    for at in range(parts if total else 0):
        rows = postings if parts == 1 else postings.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == at)
        block = Block(rows.toArrow())
        if block.items:
            yield block


def bags(docs: DataFrame, block: Block) -> DataFrame:
    """``doc_id, n, bag`` of every row: all its terms counted, those of the block listed as sorted (term, times) pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for ids, values in text_batches(batches):
            sizes, found = [], []
            for value in values:
                words = terms(value)
                pairs = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                sizes.append(len(words))
                found.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n", "bag"]
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch of bags, and how many each bag has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u4").reshape(-1, 2).astype(np.int64), np.array([len(v) // 8 for v in values], np.int64)


def holding(counted: DataFrame, block: Block) -> np.ndarray:
    """Of each term of the block, how many documents hold it: a task adds up its own, one row a term reaches the driver."""
    size = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(_pairs(batch.column(0))[0][:, 0], minlength=size)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in counted.select("bag").mapInArrow(run, "term bigint, n bigint").groupBy("term").sum("n").collect():
        out[term] = n
    return out


def classes(counted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``bag, m, members``: one row per class of documents that score alike, with its k smallest ids in order.

    The hash leads the key, so that most comparisons end at it; the rest of the key settles what it cannot.
    """
    m = F.expr(f"75 + (cast({25 * n_docs} as decimal(19, 0)) * cast(n as decimal(19, 0))) div cast({n_terms} as decimal(19, 0))")
    named = counted.where("doc_id is not null and octet_length(bag) > 0").select("doc_id", "bag", m.alias("m"))
    key = ["hash", "bag", "m"]
    ordered = Window.partitionBy(*key).orderBy("doc_id")
    first = named.withColumn("hash", F.xxhash64("bag", "m")).withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= k)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).select("bag", "m", "members")


class Scorer:
    """Scores classes for all items of a block and keeps each item's k best documents."""

    def __init__(self, block: Block, weights: np.ndarray, k: int):
        self.block, self.weights, self.k = block, weights, k
        self.best = [[] for _ in block.items]

    def pieces(self, pairs: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of classes that keep scores and hits within ``CELLS``."""
        hits = np.diff(self.block.starts)[pairs[:, 0]]
        ends = np.cumsum(sizes)
        done = np.concatenate([[0], np.cumsum(hits)])[np.concatenate([[0], ends])]
        start, most = 0, max(1, CELLS // len(self.block.items))
        while start < len(sizes):
            stop = int(np.searchsorted(done, done[start] + CELLS, "right")) - 1
            stop = min(max(stop, start + 1), start + most, len(sizes))
            yield start, stop
            start = stop

    def scores(self, pairs: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Classes by items, exact in 64-bit integers."""
        block = self.block
        of = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = pairs[:, 0], pairs[:, 1]
        each = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
        count = np.diff(block.starts)[term]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(block.starts[term], count) + within
        out = np.zeros(len(sizes) * len(block.items), np.int64)
        np.add.at(out, np.repeat(of, count) * len(block.items) + block.holders[at], np.repeat(each, count) * block.times[at])
        return out.reshape(len(sizes), -1)

    def add(self, batch: pa.RecordBatch) -> None:
        pairs, sizes = _pairs(batch.column(0))
        m = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        members = batch.column(2)
        starts = members.offsets.to_numpy()
        ids = members.values.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for start, stop in self.pieces(pairs, sizes):
            found = self.scores(pairs[ends[start] : ends[stop]], sizes[start:stop], m[start:stop])
            least = np.array([b[-1][0] if len(b) == self.k else 1 for b in self.best], np.int64)
            if len(found) > self.k:
                least = np.maximum(least, np.partition(found, -self.k, axis=0)[-self.k])
            at, item = np.nonzero(found >= least)
            score, first = found[at, item], ids[starts[start + at]]
            # of classes in this order only the first k can hold one of the k best documents
            order = np.lexsort((first, -score, item))
            item = item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            for chosen, i in zip(order[place < self.k], item[place < self.k], strict=True):
                row = start + at[chosen]
                self.best[i].extend((int(score[chosen]), int(d)) for d in ids[starts[row] : starts[row + 1]])
            for i in np.unique(item):
                self.best[i] = sorted(self.best[i], key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> pa.RecordBatch:
        found = [(self.block.items[i], d, s) for i, best in enumerate(self.best) for s, d in best]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[at] for f in found], pa.int64()) for at in range(3)], names=["item_id", "doc_id", "score"]
        )


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0, ties by ascending id."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    postings = materialise(item_terms(items, item_id, item_text), "postings")
    found = []
    for block in blocks(postings, block_bytes):
        counted = materialise(bags(rows, block), "bags")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding(counted, block)], np.int64)
        shared = spark.sparkContext.broadcast((block, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value, k)
            for batch in batches:
                scorer.add(batch)
            yield scorer.rows()

        found.append(classes(counted, n_docs, n_terms, k).mapInArrow(run, "item_id bigint, doc_id bigint, score bigint"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
