"""Near-duplicates by SimHash, with links found through pivot distance tables.

A word is a run of bytes other than white space after A-Z became a-z; shingles are ``shingle`` words joined by one
blank, repeats included (fewer words: the whole sequence).  A bit of the 64-bit fingerprint is 1 if it is set in over
half of the shingles' XXH64 values (seed 42).  A text without words, empty or null, has fingerprint zero.

Distinct fingerprints are compared, never copies.  The Hamming distance of each of six bands of a fingerprint to the
same band of twelve reference fingerprints is computed once; the sums over the bands are the distances to the whole
references.  Fingerprints that differ in at most three bits agree in three bands at least, hence in all distances of
those bands: these are the keys that bring a pair together (20 ways to choose three bands).  Pairs whose distances to
some reference differ by more than three cannot be linked (triangle inequality) and are dropped; the bits of the
survivors are counted.

A crowded key, with more than ``CROWD`` fingerprints, is not paired: what the fingerprints of that key do not share is cut
into six bands again, of which three must agree in turn, and so once more.  Below the third cut a key has at most
2**8 fingerprints, so the work is in proportion to their number however crowded a key is, and no link is lost.

``keep_one`` keeps one document of each component.

Rows with a null id take part, but have no id to give to a component: a component of such rows only is null.
Repeated rows are copies.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from muster.llm.common import LOWER, text_batches, texts
from muster.llm.components import components
from muster.operators.skew import join_per_key
from muster.session import materialise

RADIUS = 3
BANDS = 6
REFERENCES = 12
CROWD = 64
LEVELS = 3


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = text.translate(LOWER).split()  # bytes split at 09-0D and 20 only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    values = np.fromiter((digest(p, 42) for p in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        part = values[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in text_batches(batches):
            fps = pa.array([fingerprint(v, shingle) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, fps], names=["doc_id", "fp"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def cut(bits: list[int]) -> list[int]:
    """Masks of six bands of near equal width over the given bits."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, BANDS)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def references() -> list[int]:
    """The fixed reference fingerprints."""
    return [int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63 - 1, REFERENCES)]


def distances(fp: Column, mask: int | None = None) -> list[Column]:
    """Hamming distances to the references, within a band or on the whole."""
    apart = [fp.bitwiseXOR(F.lit(r).cast("bigint")) for r in references()]
    return [F.bit_count(x if mask is None else x.bitwiseAND(F.lit(signed(mask)).cast("bigint"))) for x in apart]


def first_keys(fps: DataFrame) -> DataFrame:
    """``fp, path, key``: a row per choice of three bands; the key stands for the distances within them."""
    bands = cut(list(range(64)))
    table = fps.select(
        "fp", *[F.xxhash64(F.lit(b), *distances(F.col("fp"), mask)).alias(f"b{b}") for b, mask in enumerate(bands)]
    )
    ways = [
        F.struct(F.lit(at).alias("path"), F.xxhash64(F.lit(at), *[F.col(f"b{b}") for b in way]).alias("key"))
        for at, way in enumerate(combinations(range(BANDS), 3))
    ]
    return table.select("fp", F.inline(F.array(*ways)))


def deeper_masks(spark: SparkSession, level: int) -> DataFrame:
    """``path, next, mask``: which bits the fingerprints of a crowded key must share at the next level.

    20 rows per choice of three bands, 400 rows at level 1 and 8,000 at level 2.
    """
    paths = [list(range(64))]
    for _ in range(level):
        paths = [
            [b for b in bits if not sum(masks[i] for i in way) >> b & 1]
            for bits in paths for masks in [cut(bits)] for way in combinations(range(BANDS), 3)
        ]
    ways = list(combinations(range(BANDS), 3))
    rows = [
        (path, path * len(ways) + at, signed(sum(masks[i] for i in way)))
        for path, bits in enumerate(paths) for masks in [cut(bits)] for at, way in enumerate(ways)
    ]
    return spark.createDataFrame(rows, "path int, next int, mask bigint")


def near(keyed: DataFrame) -> DataFrame:
    """``a, b``: the linked pairs, a < b, among fingerprints with one key."""
    left = keyed.select("path", "key", F.col("fp").alias("a"))
    pairs = left.join(keyed.select("path", "key", F.col("fp").alias("b")), ["path", "key"]).where("a < b")
    apart = [F.abs(x - y) for x, y in zip(distances(F.col("a")), distances(F.col("b")), strict=True)]
    survives = reduce(lambda x, y: x & y, [d <= RADIUS for d in apart])
    return pairs.where(survives).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints with three differing bits or fewer."""
    spark = fps.sparkSession
    keyed, found = first_keys(fps), []
    for level in range(1, LEVELS + 1):
        counts = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialise(keyed.join(counts, ["path", "key"]), "keyed")
        last = level == LEVELS
        found.append(near(shared if last else shared.where(F.col("n") <= CROWD)))
        crowded = shared.where(F.col("n") > CROWD)
        if last or crowded.isEmpty():
            break
        keyed = crowded.join(F.broadcast(deeper_masks(spark, level)), "path").select(  # 8,000 rows at most
            "fp", F.col("next").alias("path"),
            F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"),
        )
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links."""
    rows = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    named = component_of(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    return join_per_key(rows, named.withColumnRenamed("first", "component_id"), ["fp"]).select("doc_id", "fp", "component_id")


def component_of(distinct: DataFrame, least: str) -> DataFrame:
    """``fp`` and, under the name ``least``, the smallest such value in its component, for every distinct fingerprint.

    Only linked fingerprints are joined by component; the others, most of a corpus, keep the value they have.
    """
    first = materialise(distinct.select("fp", F.col(least).alias("value")), "distinct")
    roots = components(links(first.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    rooted = materialise(first.join(roots, "fp", "left"), "rooted")
    linked = rooted.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("value").alias("least"))
    met = join_per_key(linked, smallest, ["root"]).select("fp", F.col("least").alias(least))
    return materialise(met.unionByName(rooted.where("root is null").select("fp", F.col("value").alias(least))), "components")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with one row of each component: of those with the smallest id the first as written; rows without an id last.

    The rows are written once with their fingerprint and a number, so a row is known by that number whatever its columns
    hold, and only numbers are compared.
    """
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(v, shingle) for _, values in text_batches(iter([batch])) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["row", "fp"])

    marked = whole.mapInArrow(run, StructType([whole.schema["row"], StructField("fp", LongType())]))
    rows = materialise(marked.withColumn("at", F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col(f"row.`{id_col}`").isNull().alias("unnamed"), F.col(f"row.`{id_col}`").alias("id"), "at")
    kept = component_of(rows.groupBy("fp").agg(F.min(order).alias("best")), "best").select("best.at").distinct()
    return rows.join(kept, "at", "left_semi").select("row.*")
