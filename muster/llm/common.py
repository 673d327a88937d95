"""What several operators share: reading tables, worker set-up, text batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; bytes above 127 are never touched.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes handed to a Python worker at once: texts are long, and two workers share an executor's memory.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers started from another folder import this package, and bound what they get at once."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``: whatever else the table holds cannot clash with an operator's own columns."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_batches(
    batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20
) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, UTF-8 texts) in pieces of about ``most_bytes``, which bounds a worker's memory; null texts are empty."""
    for batch in batches:
        column = batch.column(1)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        values = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
        start, size = 0, 0
        for at, value in enumerate(values):
            size += len(value)
            if size >= most_bytes:
                yield batch.column(0).slice(start, at + 1 - start), values[start : at + 1]
                start, size = at + 1, 0
        if start < len(values):
            yield batch.column(0).slice(start), values[start:]
        del values, column
        pa.default_memory_pool().release_unused()


def hash_words(words: list[bytes], seed: int) -> np.ndarray:
    """A 64-bit number per word; each distinct word is hashed once."""
    import xxhash

    coded = pa.array(words, pa.binary()).dictionary_encode()
    each = np.fromiter(
        (xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
