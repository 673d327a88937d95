"""Document sources: JSON array files with comments, JSON text, stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from muster.sources.arrays import split_documents

# white space and comments before the first value of a file
_LEADING = r"\A(?:\s++|//[^\n]*+(?:\n|\z)|/\*[\s\S]*?\*/)*+"
_JSON = {"mode": "FAILFAST", "allowComments": "true"}
WHOLE_BYTES = 64 << 20


def resolve_path(path: str, root: str | None = None) -> str:
    """A relative path is taken from the configuration root; URLs and absolute paths stay."""
    if root is None or path.startswith("/") or "://" in path:
        return path
    return f"{root.rstrip('/')}/{path}"


def _array_items(text: Column, schema: str, label: Column) -> Column:
    """The documents of a JSON array; anything but an array is an error."""
    kind = ArrayType(StructType.fromDDL(schema))
    body = F.regexp_replace(text, _LEADING, "")
    wrong = F.raise_error(F.concat(F.lit("not a JSON array of documents: "), label))
    return F.when(body.startswith("["), F.from_json(text, kind, _JSON)).otherwise(wrong.cast(kind))


def read_documents(
    spark: SparkSession, paths: str | Sequence[str], schema: str, root: str | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Documents of JSON array files; ``//`` and ``/* */`` comments are allowed.

    Files of up to ``whole_bytes`` are read as a whole, one task a file; larger ones are cut into splits and read by many tasks
    (see ``muster.sources.arrays``), with the same rows.  ``seq`` orders the documents of one file and ``file`` names it.
    """
    paths = [resolve_path(p, root) for p in ([paths] if isinstance(paths, str) else paths)]
    sizes = spark.read.format("binaryFile").load(paths).where(F.col("length") > whole_bytes)
    large = [r.path for r in sizes.select("path").collect()]  # names only; their number follows from their size
    texts = spark.read.text(paths, wholetext=True)
    if large:
        texts = texts.where(F.col("_metadata.file_size") <= whole_bytes)
    file = F.col("_metadata.file_path")
    whole = (
        texts.select(file.alias("file"), F.posexplode(_array_items(F.col("value"), schema, file)).alias("seq", "_d"))
        .select("_d.*", "file", F.col("seq").cast("bigint").alias("seq"))
    )
    if not large:
        return whole
    parsed = F.from_json("text", StructType.fromDDL(schema), _JSON).alias("_d")
    return whole.unionByName(split_documents(spark, large).select(parsed, "file", "seq").select("_d.*", "file", "seq"))


def documents_from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents passed inline as the text of a JSON array, one row each; malformed text is an error."""
    items = _array_items(F.col(column), schema, F.lit("inline documents"))
    return df.select(F.posexplode(items).alias("seq", "_d")).select("_d.*", F.col("seq").cast("bigint").alias("seq"))


def documents_from_table(df: DataFrame, id_col: str = "_id") -> DataFrame:
    """A stored collection: rows with a null id are no documents."""
    return df.where(F.col(id_col).isNotNull())
