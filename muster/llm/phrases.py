"""Phrase collocations by relational mining of sorted occurrences (SETM).

A-Z become a-z; texts are split at ``. , ; : ! ?`` and at the characters 0A-0D into pieces, pieces at blanks and tabs into words.
Everything is counted per language (null: ``und``).

Level by level the occurrences of phrases are a relation written to the shared folder, sorted by place.  A place is the
piece and the position in it as one rising number: positions of a piece follow one another, and between two pieces one number is
left out, so "same piece, next position" is "place + 1".  A level

* merge-joins the occurrences of the level below with themselves at the next place: phrases of k-1 words that overlap in
  k-2 give one of k words,
* counts the groups, that is the phrases, first within a part of the relation, then over all of it,
* and semi-joins the occurrences with the frequent groups before the next level extends them.

A part of the relation holds the occurrences in about ``PART_BYTES`` of text as they lie in a table's split, by language, in
one row, with the part's own numbers for words and phrases.  Rows are large, so a file has a row group for each of them: a task
holds one part at a time, however many its split has.  A piece lies within a document and a document within a part, so
parts join among themselves; only counts are shuffled.  They are counted in two steps.  First by a hash of the phrase, five bytes
a phrase and part, which tells the phrases that may be frequent from the many that are not; no phrase is lost, since texts of
one hash add up.  Then those that may be frequent by their text, which is exact.  Both the second count and the semi-join
look phrases up in a table of bits by hash, whose size has an upper bound: what it lets through by mistake falls out by its
count, so results do not depend on it.

A phrase of 2 to ``longest`` words with ``a >= least`` occurrences is a candidate.  Its score is the smallest
``2000000 * a div (l + r)`` over its cuts in two phrases, which occur ``l`` and ``r`` times; ties go to the shortest first part.  A candidate
within a longer one that occurs at least ``share`` percent as often is dropped.

Null texts are empty; texts without a word add nothing; repeated rows count each; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import LOWER, text_batches
from muster.session import materialise, remove_folder, scratch_path

LEAST = 30
LONGEST = 4
SHARE = 80
BEST = 2000
#: Bits of the table of frequent phrases: 16 for each of them, within these bounds (8 KiB and 32 MiB).
FEWEST_BITS, MOST_BITS = 16, 28
PART_BYTES = 8 << 20
#: Bytes of a row group of the relation: small parts share one, a large one is alone.
ROW_GROUP_BYTES = 4 << 20
#: Entries counted by hash in one group, at most on average, and rows handed back at once.
GROUP, ROWS = 1 << 20, 1 << 16

#: A-Z become a-z, all that ends a piece becomes one byte; a word cannot hold it, so it can stand between pieces.
_BETWEEN = b"."
_CUT = bytes(46 if b in b".,;:!?\x0A\x0B\x0C\x0D" else b for b in LOWER)

#: A row is a part: ``n`` its words in all, ``kinds`` its phrases, ``gaps`` the differences of rising places, ``codes`` the phrase at
#: each place, ``words`` its words joined by blanks, ``tuples`` the words of each phrase, ``counts`` how often it occurs here.
PART = "lang string, n bigint, kinds bigint, gaps binary, codes binary, words binary, tuples binary, counts binary"


def _part(lang: str, places: np.ndarray, codes: np.ndarray, words: pa.Array, tuples: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One part; words no phrase uses are left out."""
    used, numbers = np.unique(tuples, return_inverse=True)
    held = [x.astype("<i4").tobytes() for x in (np.diff(places, prepend=0), codes, numbers, counts)]
    held.insert(2, b" ".join(words.take(pa.array(used)).to_pylist()))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([len(codes)], pa.int64()), pa.array([len(counts)], pa.int64()), *[pa.array([x], pa.binary()) for x in held]],
        names=[c.split()[0] for c in PART.split(", ")],
    )


class Phrases:
    """The phrases of a part: their words, their hashes and their texts."""

    def __init__(self, lang: str, words: bytes, tuples: bytes, counts: bytes):
        self.lang, self.words = lang, pa.array(words.split(b" "), pa.binary())
        self.counts = np.frombuffer(counts, "<i4")
        self.tuples = np.frombuffer(tuples, "<i4").reshape(len(self.counts), -1)

    def hashes(self) -> np.ndarray:
        return mixed(self.lang, self.words.to_pylist(), self.tuples)

    def texts(self, which: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(c)) for c in self.tuples[which].T], b" ").cast(pa.string())


def mixed(lang: str, words: list[bytes], tuples: np.ndarray) -> np.ndarray:
    """A 64-bit hash per phrase: its words' hashes as digits of a number, mixed."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    out = np.zeros(len(tuples), np.uint64)
    for column in tuples.T:
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[column]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", part_bytes: int = PART_BYTES) -> DataFrame:
    """The relation of single words."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def part(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        tokens = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string())).flatten()
        coded = tokens.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
        codes = codes[codes != pc.index(words, pa.scalar(b"")).as_py()]  # before a text's first word
        places = np.nonzero(codes != pc.index(words, pa.scalar(_BETWEEN)).as_py())[0]
        if len(places):
            number, codes, counts = np.unique(codes[places], return_inverse=True, return_counts=True)
            yield _part(lang, places, codes, words, number[:, None], counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[bytes]] = {}
        size = 0
        for langs, values in text_batches(batches, part_bytes):
            for lang, value in zip(langs.to_pylist(), values, strict=True):
                found.setdefault(lang, []).append(value.translate(_CUT).replace(_BETWEEN, b" . ") + b" .")
                size += len(value) + 2
                if size >= part_bytes:
                    for each in found.items():
                        yield from part(*each)
                    found, size = {}, 0
        for each in found.items():
            yield from part(*each)

    return rows.mapInArrow(run, PART)


class Frequent:
    """A table of bits by hash that holds all of some phrases, and by chance others.

    Tasks get it by ``shared``.  Executors keep a copy until ``release``, which its last reader calls.
    """

    def __init__(self, hashes: DataFrame):
        """``hashes``: a column ``h``, of which the first ``MOST_BITS`` bits at least are those of the phrases' hashes."""
        self.context, self.sent = hashes.sparkSession.sparkContext, None
        size = max(hashes.count(), 1)
        self.bits = min(max(int(16 * size - 1).bit_length(), FEWEST_BITS), MOST_BITS)
        slots = hashes.select(F.shiftrightunsigned("h", 64 - self.bits).alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int))) AS mask")
        ).toArrow()  # at most 2**23 rows, whatever the number of phrases
        self.table = np.zeros(max((1 << self.bits) // 32, 1), np.uint32)
        self.table[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.table[slots >> 5] >> (slots & 31).astype(np.uint32) & 1).astype(bool)

    def __reduce__(self):
        return _received, (self.bits, self.table)

    def shared(self) -> Broadcast:
        if self.sent is None:
            self.sent = self.context.broadcast(self)
        return self.sent

    def release(self) -> None:
        if self.sent is not None:
            self.sent.destroy()
            self.sent = None


def _received(bits: int, table: np.ndarray) -> Frequent:
    """The table as a task has it."""
    out = Frequent.__new__(Frequent)
    out.bits, out.table = bits, table
    return out


def perhaps_frequent(parts: DataFrame, least: int) -> DataFrame:
    """``h``: the hashes, cut to 32 bits and a group's number, whose phrases occur ``least`` times or more together."""
    total = parts.agg(F.sum("kinds")).first()[0] or 0
    above = max((total // GROUP).bit_length(), 1)
    cap = min(least, 255)  # a part that reaches the cap alone decides already

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                phrases = Phrases(*row)
                hashes = phrases.hashes()
                order = np.argsort(hashes)
                hashes, counts = hashes[order], np.minimum(phrases.counts[order], cap).astype(np.uint8)
                keys = (hashes >> np.uint64(32 - above)).astype("<u4")
                bounds = np.searchsorted(hashes >> np.uint64(64 - above), np.arange((1 << above) + 1, dtype=np.uint64))
                spans = [(g, a, b) for g, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _, _ in spans], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in spans], pa.binary()),
                     pa.array([counts[a:b].tobytes() for _, a, b in spans], pa.binary())],
                    names=["group", "keys", "counts"],
                )

    def summed(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), "<u4")
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.nonzero(np.diff(keys, prepend=keys[0] ^ 1))[0]
        sums = np.add.reduceat(counts[order].astype(np.int64), starts)
        kept = keys[starts[sums >= cap]].astype(np.uint64)
        number = np.uint64(group["group"][0].as_py())
        return pa.table({"h": ((number << np.uint64(64 - above)) | (kept << np.uint64(32 - above))).view(np.int64)})

    each = parts.select("lang", "words", "tuples", "counts").mapInArrow(dealt, "group int, keys binary, counts binary")
    return each.groupBy("group").applyInArrow(summed, "h bigint")


def counted(parts: DataFrame, perhaps: Frequent) -> DataFrame:
    """``lang, phrase, f`` of the phrases the table holds."""
    shared = perhaps.shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                phrases = Phrases(*row)
                held = np.nonzero(shared.value.holds(phrases.hashes()))[0]
                for start in range(0, len(held), ROWS):
                    some = held[start : start + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[0]] * len(some)), phrases.texts(some), pa.array(phrases.counts[some].astype(np.int64))],
                        names=["lang", "phrase", "n"],
                    )

    each = parts.select("lang", "words", "tuples", "counts").mapInArrow(run, "lang string, phrase string, n bigint")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def hashed(phrases: DataFrame) -> DataFrame:
    """``h`` of phrases given as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                words = phrase.encode().split(b" ")
                found.append(mixed(lang, words, np.arange(len(words))[None])[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h bigint")


def extended(parts: DataFrame, frequent: Frequent) -> DataFrame:
    """The relation one word longer: frequent occurrences only, merge-joined with those at the next place."""
    shared = frequent.shared()

    def longer(lang: str, gaps: bytes, codes: bytes, words: bytes, tuples: bytes, counts: bytes) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(lang, words, tuples, counts)
        places, codes = np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64), np.frombuffer(codes, "<i4")
        kept = shared.value.holds(phrases.hashes())[codes]
        places, codes = places[kept], codes[kept].astype(np.int64)
        # merge join of two lists sorted by place: the partner at place + 1 is the next row or there is none
        at = np.nonzero(np.diff(places) == 1)[0]
        if len(at):
            size = len(phrases.tuples)
            pair, new, counts = np.unique(codes[at] * size + codes[at + 1], return_inverse=True, return_counts=True)
            joined = np.column_stack([phrases.tuples[pair // size], phrases.tuples[pair % size, -1]])
            yield _part(lang, places[at], new, phrases.words, joined, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                yield from longer(*row)

    return parts.select("lang", "gaps", "codes", "words", "tuples", "counts").mapInArrow(run, PART)


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score``: the lowest-scoring cut of each candidate; arithmetic in 38 digits."""
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")
    ).select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
        F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the phrases within longer candidates and how often the most frequent of those occurs."""
    runs = (
        "flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), "
        "i -> array_join(slice(w, i, k), ' '))))"
    )
    longer = candidates.select("lang", "f", F.split("phrase", " ").alias("w")).where("size(w) > 2")
    inner = longer.select("lang", "f", F.explode(F.expr(runs)).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
    share: int = SHARE, best: int = BEST,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``best`` phrases; n is its number of words."""
    spark = docs.sparkSession
    parts, path = _written(occurrences(docs, text_col, lang_col), "words")
    total = materialise(parts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = []
    for length in range(1, longest + 1):
        if length > 1:
            held = Frequent(hashed(frequent[-1]))
            longer, written = _written(extended(parts, held), "longer")
            held.release()
            remove_folder(spark, path)
            parts, path = longer, written
        held = Frequent(materialise(perhaps_frequent(parts, least), "perhaps"))
        frequent.append(materialise(counted(parts, held).where(F.col("f") >= least), "frequent"))
        held.release()
    remove_folder(spark, path)
    candidates = reduce(DataFrame.unionByName, frequent[1:])
    chosen = scored(candidates, reduce(DataFrame.unionByName, frequent)).join(covered(candidates), ["lang", "phrase"], "left")
    dropped = F.coalesce(
        F.expr(f"cast(100 as decimal(19, 0)) * longer >= cast({int(share)} as decimal(19, 0)) * a"), F.lit(False)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = chosen.where(~dropped).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= best)
    # one row a language
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table and its folder, which goes after the last reader.

    Without these options a writer looks at its size after a hundred rows first, that is, holds a hundred parts, and a reader
    gets them as one batch.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
    for key, value in (("page.size.row.check.min", 1), ("page.size.row.check.max", 1), ("enable.dictionary", False), ("column.statistics.enabled", False)):
        writer = writer.option(f"parquet.{key}", value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
