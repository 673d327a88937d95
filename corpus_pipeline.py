"""From raw documents to tokens: toxic documents and near copies go, leaked benchmark texts go, personal data is masked.

Each stage takes all that its predecessor kept and returns the columns of documents, whatever they are; the last one
returns the tokens.  A stage decides by the text, so null or repeated ids are no special case: two rows with one id and
different texts are judged apart, and of rows with one text one stays.  Null texts are empty; empty texts are copies of
one another.  An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import bpe, decontaminate, pii, simhash, toxicity
from muster.llm.common import ready, table
from muster.session import materialise, tune


def packed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns but the text, and ``text``: nothing a stage adds can clash with a column of documents."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of documents again, with new values for those named."""
    values = {"text": F.col("text"), **new}
    return rows.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents the classifier chain rejects; it is fitted on the labelled ones among ``docs``."""
    chain = toxicity.fit(docs, table(ready(spark), sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), chain, keep=("row", "text")).where("not rejected"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose fingerprints are linked: three-word shingles, three bits apart at most."""
    ready(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with an item of the benchmark; a row is known by its number in a written table."""
    ready(spark)
    named = materialise(packed(docs).withColumn("key", F.monotonically_increasing_id()), "named")
    leaks = decontaminate.overlaps(named.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(named.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti"), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind; ``n_chars`` follows the text where documents have it."""
    found = pii.find_spans(packed(docs))
    masked = found.withColumn("masked", pii.redact(F.col("text"), F.col("spans")))
    return unpacked(masked, docs, text=F.col("masked"), n_chars=F.length("masked").cast("bigint"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: ids as little-endian 32-bit numbers, and the text decoded from them."""
    ready(spark)
    coded = bpe.code_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]

#: Trained models take part, which SQL cannot express; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
