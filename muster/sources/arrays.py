"""JSON array files of any size, read by many tasks.

A file is split at commas by Spark's text source, which knows nothing of strings, brackets and comments.  So a first pass learns of
every split what it does to a reader who enters it in code, in a string, in a line comment or in a block comment: in which
of these the reader leaves it, and by how much the depth of brackets changes.  (After a comma nothing else can be pending: no escape, no
half of a comment mark.)  Composed along a file, these give the state and depth at the beginning of every split.

With them a second pass cuts each split at the commas of depth one.  What lies between two cuts of a split is a document; what is left
at the ends of splits is joined along the file, a few rows a split.  Documents are numbered by counts per split.

The table of split beginnings has one row per split and is handed to all tasks; nothing else grows on the driver.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.operators.skew import join_per_key
from muster.session import materialise

CODE, STRING, LINE, BLOCK = range(4)
NOT_ARRAY = "not a JSON array of documents"

# a string or a comment; one that does not end here is the group of its kind
_TOKEN = re.compile(
    rb'"(?:[^"\\]|\\[\s\S])*+"|("(?:[^"\\]|\\[\s\S])*+\\?\Z)|//[^\n]*+\n|(//[^\n]*+\Z)|/\*(?:[^*]|\*(?!/))*+\*/|(/\*(?:[^*]|\*(?!/))*+\Z)'
)
_STRING_END = re.compile(rb'(?:[^"\\]|\\[\s\S])*+"')


def masked(text: bytes, state: int) -> tuple[bytes, int]:
    """``text`` with comments made blank and strings made ``x``, lengths kept, and the state after it."""
    fill, start = (b"x" if state == STRING else b" "), 0
    if state == STRING:
        found = _STRING_END.match(text)
        start = found.end() if found else -1
    elif state == LINE:
        start = text.find(b"\n") + 1 or -1
    elif state == BLOCK:
        start = text.find(b"*/") + 2
        start = start if start > 1 else -1
    if start < 0:
        return fill * len(text), state
    out, after = [fill * start], CODE
    for found in _TOKEN.finditer(text, start):
        out.append(text[start : found.start()])
        out.append((b"x" if found[0].startswith(b'"') else b" ") * (found.end() - found.start()))
        start, after = found.end(), (found.lastindex or 0)
    out.append(text[start:])
    return b"".join(out), after


def depths(code: bytes) -> np.ndarray:
    """The change of depth up to and including each byte of a masked text."""
    b = np.frombuffer(code, np.uint8)
    return np.cumsum(((b == 91) | (b == 123)).astype(np.int64) - ((b == 93) | (b == 125)))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, split, its text in pieces that end with a comma): a task reads its splits one after the other."""
    pieces = (
        (batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), b",".join(batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist()) + b",")
        for batch in batches if batch.num_rows for a, b in _same(batch)
    )
    held = next(pieces, None)

    def rest(of: tuple) -> Iterator[bytes]:
        nonlocal held
        while held is not None and held[:2] == of:
            piece, held = held[2], next(pieces, None)
            yield piece

    while held is not None:
        of = held[:2]
        yield *of, rest(of)


def _same(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    files = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    blocks = batch.column(1).to_numpy(zero_copy_only=False)
    cuts = (np.nonzero((np.diff(files) != 0) | (np.diff(blocks) != 0))[0] + 1).tolist()
    return zip([0, *cuts], [*cuts, batch.num_rows], strict=True)


def effects(chunks: DataFrame) -> DataFrame:
    """``file, block, leaves, deltas``: what each split does to a reader, by the state in which it is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, pieces in runs(batches):
            state, delta = list(range(4)), [0] * 4
            for piece in pieces:
                done = {}
                for at in range(4):
                    if state[at] not in done:
                        code, after = masked(piece, state[at])
                        done[state[at]] = after, int(depths(code)[-1])
                    after, change = done[state[at]]
                    state[at], delta[at] = after, delta[at] + change
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([state], pa.list_(pa.int32())), pa.array([delta], pa.list_(pa.int64()))],
                names=["file", "block", "leaves", "deltas"],
            )

    return chunks.mapInArrow(run, "file string, block bigint, leaves array<int>, deltas array<bigint>")


def entries(found: DataFrame) -> DataFrame:
    """``file, block, state, depth`` at the beginning of every split; a file that does not end as it should is an error."""

    def follow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        state, depth, out = CODE, 0, []
        for row in rows:
            out.append((row["file"], row["block"], state, depth))
            state, depth = row["leaves"][state], depth + row["deltas"][state]
        if depth or state in (STRING, BLOCK):
            raise ValueError(f"{NOT_ARRAY}: {rows[0]['file']}")
        return pa.table({name: [r[at] for r in out] for at, name in enumerate(("file", "block", "state", "depth"))}, pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("depth", pa.int64())]))

    return found.groupBy("file").applyInArrow(follow, "file string, block bigint, state int, depth bigint")


#: A stretch of a split between cuts; ``nth`` is -1 for what lies before the first cut, ``opener`` and ``closer`` are null at a split's ends.
STRETCH = "file string, block bigint, nth bigint, opener string, closer string, blank boolean, text string"


def stretches(chunks: DataFrame, begin: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """All splits cut at the bracket that opens the array, the commas of depth one, and the bracket that closes it."""
    shared = chunks.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, pieces in runs(batches):
            state, depth = shared.value[file, block]
            nth, opener, text, blank, rows = -1, None, [], True, []
            for piece in pieces:
                code, after = masked(piece, state)
                level = depth + depths(code)
                b = np.frombuffer(code, np.uint8)
                opens, closes = (b == 91) & (level == 1), (b == 93) & (level == 0)
                if ((level == 0) & (b > 32) & ~closes & (b != 44)).any() or ((b == 123) & (level == 1)).any() or (level < 0).any():
                    raise ValueError(f"{NOT_ARRAY}: {file}")
                start = 0
                for cut in np.nonzero(opens | closes | ((b == 44) & (level == 1)))[0].tolist():
                    text.append(piece[start:cut])
                    blank = blank and not code[start:cut].strip()
                    rows.append((file, block, nth, opener, chr(b[cut]), blank, b"".join(text)))
                    nth, opener, text, blank, start = nth + 1, chr(b[cut]), [], True, cut + 1
                text.append(piece[start:])
                blank = blank and not code[start:].strip()
                state, depth = after, int(level[-1])
                if rows:
                    yield _rows(rows)
                    rows = []
            yield _rows([(file, block, nth, opener, None, blank, b"".join(text))])

    return chunks.mapInArrow(run, STRETCH)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    columns = [pa.array([r[at] for r in rows], kind) for at, kind in enumerate(kinds)]
    columns[-1] = columns[-1].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRETCH.split(", ")])


def split_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, seq, text``: the text of every document of JSON array files, in as many tasks as the files have splits."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    chunks = spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    begin = entries(effects(chunks)).toArrow()
    known = dict(zip(zip(begin["file"].to_pylist(), begin["block"].to_pylist(), strict=True),
                     zip(begin["state"].to_pylist(), begin["depth"].to_pylist(), strict=True), strict=True))
    cut = materialise(stretches(chunks, known), "stretches")
    # one row a split: how many documents lie before it, and the last cut before it
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialise(
        cut.groupBy("file", "block").agg(
            F.max("nth").alias("last"), F.count_if(F.col("opener").isin("[", ",")).alias("starts"),
            F.count_if(F.col("opener") == "[").alias("opened"),
        ).select(
            "file", "block", "opened", F.coalesce(F.sum("starts").over(along), F.lit(0)).alias("before"),
            F.last(F.when(F.col("last") >= 0, F.struct("block", "last")), ignorenulls=True).over(along).alias("held"),
        ), "splits",
    )
    wrong = splits.groupBy("file").agg(F.sum("opened").alias("arrays")).where("arrays <> 1").select("file").limit(1).collect()
    if wrong:
        raise ValueError(f"{NOT_ARRAY}: {wrong[0][0]}")
    ends = F.col("closer").isNull() | F.col("opener").isNull()
    whole = join_per_key(cut.where(~ends & F.col("opener").isin("[", ",")), splits.select("file", "block", "before"), ["file", "block"]).select(
        "file", (F.col("before") + F.col("nth")).alias("seq"), "opener", "closer", "blank", "text"
    )
    # the ends of splits, a few rows each, go to the document that the last cut before them opened
    torn = cut.where(ends).join(splits, ["file", "block"]).withColumn(
        "owner", F.when(F.col("nth") >= 0, F.struct("block", F.col("nth").alias("last"))).otherwise(F.col("held"))
    )
    part = F.struct("block", "text")
    joined = torn.groupBy("file", "owner").agg(
        F.max(F.when(F.col("nth") >= 0, F.struct((F.col("before") + F.col("nth")).alias("seq"), "opener"))).alias("first"),
        F.max("closer").alias("closer"), F.min("blank").alias("blank"), F.sort_array(F.collect_list(part)).alias("parts"),
    ).where(F.col("first.opener").isin("[", ",")).select(
        "file", "first.seq", "first.opener", "closer", "blank", F.array_join("parts.text", "").alias("text")
    )
    no_value = F.raise_error(F.concat(F.lit("no value between commas: "), "file")).cast("string")
    empty = (F.col("opener") == "[") & (F.col("closer") == "]")
    return whole.unionByName(joined).where(~(F.col("blank") & empty)).select(
        "file", F.col("seq").cast("bigint").alias("seq"), F.when(F.col("blank"), no_value).otherwise(F.col("text")).alias("text")
    )
