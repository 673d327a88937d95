"""One query per operator over its whole table, and the SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import bpe, chat, decontaminate, licenses, lm, phrases, pii, quality, ranked, shards, simhash, topk, toxicity
from muster.llm.common import ready, table
from muster.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(tune(spark)), sf_dir)

    QUERIES[fn.__name__] = tuned
    return tuned


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.code_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("rejected", "toxic")


@query
def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


ORACLE["op6_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out():
        return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    named = F.filter("blocks", lambda b: b["named"])
    blocks = F.transform(named, lambda b: b["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    shares = F.concat(
        F.transform(named, lambda b: b["containment"]), F.transform("places", lambda p: F.lit(1.0).cast("double"))
    )
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, blocks)).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 20 best documents."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A-Z only: ``lower`` would change other letters too.
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op11_ranked_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED.format('text')}, '{_TERM}') AS terms FROM documents
), each AS (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d WHERE len(terms) > 0),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM each GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM d WHERE len(terms) > 0),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), item AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED.format('text')}, '{_TERM}')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), scored AS (
  SELECT item_id, row, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term), total WHERE doc_id IS NOT NULL GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted in windows and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], given.schema)
    return chat.digests(chat.windows(given.unionByName(made)))


ORACLE["op12_chat_windows"] = r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(text, '<\\*\|[^|>]*\|>')) + len(regexp_extract_all(text, '<\\*/?s>'))
    + len(regexp_extract_all(text, '\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*</?SYS>>')) AS added
  FROM given
), sized AS (
  SELECT *, 4 + (strlen(text) + coalesce(added, 0) + 3) // 4 AS cost,
    length('<|turn|>') + length(role) + 1 + length(text) + coalesce(added, 0) + length('<|end|>') + 1 AS size
  FROM escaped
), summed AS (
  SELECT *, sum(cost) OVER w - cost AS before, row_number() OVER w AS nth FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), led AS (SELECT conv_id, cost AS system_cost, size AS system_size FROM summed WHERE nth = 1 AND role = 'system'),
turns AS (
  SELECT s.*, s.before - coalesce(system_cost, 0) AS place, coalesce(system_size, 0) AS system_size
  FROM summed s LEFT JOIN led ON s.conv_id IS NOT DISTINCT FROM led.conv_id WHERE NOT (nth = 1 AND role = 'system')
), own AS (
  SELECT conv_id, min(place) AS start, sum(size) AS size, any_value(system_size) AS system_size
  FROM turns GROUP BY conv_id, place // 384, cost > 384
), repeated AS (
  SELECT o.conv_id, o.start, sum(t.size) AS size
  FROM own o JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.place < o.start AND t.place >= o.start - 256 GROUP BY ALL
), formatted AS (
  SELECT o.conv_id, sum(o.size + o.system_size + coalesce(r.size, 0)) AS size
  FROM own o LEFT JOIN repeated r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.start = o.start GROUP BY o.conv_id
), said AS (
  SELECT conv_id, count(*) AS n_turns, any_value(size) FILTER (nth = 1) AS first_size,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '') AS learnt
  FROM summed GROUP BY conv_id
)
SELECT s.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  coalesce(f.size, first_size)::BIGINT AS formatted_chars
FROM said s LEFT JOIN formatted f ON s.conv_id IS NOT DISTINCT FROM f.conv_id
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 4 words by language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = rf"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL),
candidate AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, l.f AS l, r.f AS r, (2000000 * c.a::HUGEINT // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidate) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : len(c.w)], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrase AS (
  SELECT DISTINCT lang, a AS longer, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM candidate, (SELECT unnest([2, 3]) AS k) WHERE k < len(w))
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrase i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 80 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
