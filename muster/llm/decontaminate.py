"""Benchmark decontamination by spaced-seed hashing.

A word is a run of ASCII letters and digits (A-Z as a-z) and of bytes above 127.  A mask is a pattern over ``SPAN``
neighbouring words that looks at some of them and ignores the others, so that a substituted word spoils only the
windows that look at it.  Every window of every text is hashed under every mask; windows of documents whose hash
stands in a bit table made of all benchmark windows are kept with the words around them, joined to the benchmark
windows by mask and hash, and verified: along the diagonal of a hit the segment with the best sum is taken, a matching
word counting 1 and a substituted one -3.  It is an overlap if it holds at least ``min_words`` matching words, or all
words of a shorter item.

The bit table has a fixed size whatever the benchmark holds: with more windows it lets more through, and the join
stays exact.  Only the windows that pass are shuffled, never the documents.

The masks lose no overlap.  Of the segment with the best sum every beginning has a positive sum, so before its k-th
substituted word there are more than 3k matching ones: its first eight words hold at most one substituted word, which
is none of the first four.  The masks are these four cases.

An item of fewer than ``SPAN`` words is hashed whole, by a mask of its own length that looks at every word, and must stand
in a document word for word.  Null and empty texts have no windows.  Overlaps are followed up to
``AROUND`` words beyond the outermost hits.  Items with equal texts are each reported.  Rows that share an id are one
document; documents and items without an id are reported under the null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import hash_words, text_batches, texts
from muster.session import materialise

#: Which of SPAN neighbouring words a mask looks at.
MASKS = ("11110111", "11111011", "11111101", "11111110")
SPAN = 8
#: Every mask by number: those of SPAN words, then a full one for each length below.
ALL_MASKS = (*MASKS, *("1" * n for n in range(1, SPAN)))
AROUND = 64
TABLE_BITS = 25
#: Odd factors, one per place in the span.
FACTORS = np.random.default_rng(5).integers(1, 2**62, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Letters to lower case; ASCII that is neither a letter nor a digit becomes a blank.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window's looked-at words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at, look in enumerate(mask):
        if look == "1":
            total += words[at : at + n] * FACTORS[at]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    total ^= total >> np.uint64(29)
    return total


def bit_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit table for each hash."""
    low = np.uint64(64 - TABLE_BITS)
    return hashes >> low, (hashes * np.uint64(0xD6E8FEB86659FD93)) >> low


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, at, mask, hash`` of every window of every item; an item below ``SPAN`` words has one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in text_batches(batches):
            for item, text in zip(ids.to_pylist(), values, strict=True):
                words = hash_words(words_of(text), 1)
                for mask, pattern in enumerate(ALL_MASKS):
                    if len(pattern) < SPAN and len(pattern) != len(words):
                        continue
                    found = window_hashes(words, pattern)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.full(n, mask)),
                            pa.array(found.view(np.int64)),
                        ],
                        names=["item_id", "at", "mask", "hash"],
                    )

    return texts(items, id_col, text_col).mapInArrow(run, "item_id bigint, at bigint, mask bigint, hash bigint")


def bit_table(windows: DataFrame) -> np.ndarray:
    """The benchmark's bits as bytes; 2**TABLE_BITS bits come to the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask_places in bit_places(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(mask_places.astype(np.int64))], names=["place"])

    places = windows.select("hash").mapInArrow(run, "place bigint")
    cells = places.groupBy(F.shiftright("place", 5).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits")
    ).collect()
    table = np.zeros(1 << (TABLE_BITS - 5), "<u4")
    for cell in cells:
        table[cell["cell"]] = cell["bits"]
    return table.view(np.uint8)


def regions(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, masks: list[int]) -> DataFrame:
    """``doc_id, start, words, hits``: stretches of documents around windows whose hash may be a benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 4 MB, whatever the tables hold

    def known(hashes: np.ndarray) -> np.ndarray:
        bits = shared.value
        first, second = bit_places(hashes)
        at = np.nonzero(bits[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & np.uint8(1))[0]
        second = second[at]
        return at[(bits[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & np.uint8(1)) == 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in text_batches(batches):
            tokens = [words_of(v) for v in values]
            ends = np.cumsum([0, *map(len, tokens)])
            flat = [w for doc in tokens for w in doc]
            hashed = hash_words(flat, 1)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for mask in masks:
                pattern = ALL_MASKS[mask]
                hashes = window_hashes(hashed, pattern)
                at = known(hashes)
                doc = np.searchsorted(ends, at, side="right") - 1
                inside = at + len(pattern) <= ends[doc + 1]  # a window must not run into the next text
                for d, p, h in zip(
                    doc[inside].tolist(), at[inside].tolist(), hashes[at[inside]].view(np.int64).tolist(), strict=True
                ):
                    found.setdefault(d, []).append((p - int(ends[d]), mask, h))
            out: dict[str, list] = {"doc_id": [], "start": [], "words": [], "hits": []}
            for d, hits in found.items():
                hits.sort()
                groups = [[hits[0]]]
                for hit in hits[1:]:
                    if hit[0] - groups[-1][-1][0] > 2 * AROUND:
                        groups.append([])
                    groups[-1].append(hit)
                for group in groups:
                    start = max(0, group[0][0] - AROUND)
                    end = group[-1][0] + SPAN + AROUND
                    out["doc_id"].append(ids[d].as_py())
                    out["start"].append(start)
                    out["words"].append(b" ".join(tokens[d][start:end]).decode())
                    out["hits"].append([{"at": p - start, "mask": m, "hash": h} for p, m, h in group])
            hit_type = pa.list_(pa.struct([("at", pa.int64()), ("mask", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()),
                    pa.array(out["words"], pa.string()), pa.array(out["hits"], hit_type),
                ],
                names=["doc_id", "start", "words", "hits"],
            )

    schema = "doc_id bigint, start bigint, words string, hits array<struct<at:bigint,mask:bigint,hash:bigint>>"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def best_segment(same: list[bool], penalty: int = 3) -> tuple[int, int, int]:
    """(start, end, matching words) of the segment with the best sum; of equal ones the first."""
    best, out, total, start = 0, (0, 0, 0), 0, 0
    for at, equal in enumerate(same):
        if total <= 0:
            total, start = 0, at
        total += 1 if equal else -penalty
        if total > best:
            best, out = total, (start, at + 1, 0)
    return out[0], out[1], sum(same[out[0] : out[1]])


def overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_words: int = 13,
) -> DataFrame:
    """``doc_id, item_id, matched, overlap, doc_word, item_word``: the longest overlap of each document and item.

    ``matched`` of the ``overlap`` words are the same; it starts at word ``doc_word`` of the document and word
    ``item_word`` of the item.
    """
    windows = materialise(item_windows(items, item_id, item_text), "windows")
    used = sorted(r["mask"] for r in windows.select("mask").distinct().collect())  # as many as ALL_MASKS at most
    near = materialise(
        regions(docs, doc_id, doc_text, bit_table(windows), used).withColumn("region", F.monotonically_increasing_id()),
        "regions",
    )
    hits = near.select("region", F.inline("hits")).withColumnRenamed("at", "doc_at")
    diagonals = (
        hits.join(windows, ["mask", "hash"])
        .select("region", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    )
    known = items.select(
        F.col(item_id).cast("bigint").alias("known_id"), F.coalesce(F.col(item_text), F.lit("")).alias("item")
    )
    pairs = diagonals.join(near.select("region", "doc_id", "start", "words"), "region").join(
        known, F.col("item_id").eqNullSafe(F.col("known_id"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "matched", "overlap", "doc_word", "item_word"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc, item, shift = r["words"].encode().split(), words_of(r["item"].encode()), r["shift"]
                low = max(0, -shift)
                same = [a == b for a, b in zip(item[low:], doc[max(0, shift) :], strict=False)]
                a, b, matched = best_segment(same)
                if matched >= min(min_words, len(item)):
                    rows.append((r["doc_id"], r["item_id"], matched, b - a, r["start"] + shift + low + a, low + a))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    found = pairs.select("doc_id", "item_id", "shift", "start", "words", "item").mapInArrow(
        verify, "doc_id bigint, item_id bigint, matched bigint, overlap bigint, doc_word bigint, item_word bigint"
    )
    best = F.max(F.struct("matched", -F.col("overlap"), -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.matched").alias("matched"), (-F.col("best.col2")).alias("overlap"),
        (-F.col("best.col3")).alias("doc_word"), (-F.col("best.col4")).alias("item_word"),
    )
