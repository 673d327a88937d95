"""The registered queries at the smallest scale, against plain versions that read the same tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__ as entry
from muster.llm.queries import ORACLE, QUERIES
from tests.check_oracle import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    return {i: t or "" for i, t in rows}


def result(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF_DIR).collect()]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_all_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, oracle_connection(SF_DIR), SF_DIR, name) is None


def test_op1(spark, docs):
    ranks = {}
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for a, b in map(bytes.split, lines):
            ranks[base64.b64decode(a)] = int(b)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = result(spark, "op1_byte_bpe")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    values = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def test_op2(spark, docs):
    want = {i: plain_fingerprint(t) for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in docs:
        new = {i: min(group[j] for j in docs if (want[i] ^ want[j]).bit_count() <= 3) for i in docs}
        if new == group:
            break
        group = new
    rows = result(spark, "op2_simhash")
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == group


def test_op3(spark, docs):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall())

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    want = set()
    for d, text in docs.items():
        joined = " %s " % " ".join(words(text))
        want |= {(d, i) for i, t in items.items() if " %s " % " ".join(words(t)) in joined}
    rows = result(spark, "op3_decontamination")
    got = {(r["doc_id"], r["item_id"]): r for r in rows}
    assert want and want <= set(got)
    for (d, i), r in got.items():
        doc = words(docs[d])[r["doc_word"] : r["doc_word"] + r["overlap"]]
        item = words(items[i])[r["item_word"] : r["item_word"] + r["overlap"]]
        assert sum(a == b for a, b in zip(doc, item, strict=True)) == r["matched"] >= min(13, len(words(items[i])))


def test_op4_and_op8_on_held_out_labels(spark):
    """At a scale with enough labels; quality never sees the held-out rows."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r[0]: r[1:] for r in duckdb.sql(f"SELECT * FROM '{sf_dir}/labels.parquet'").fetchall()}
    rows = [r.asDict() for r in entry.queries()["op8_quality"](spark, sf_dir).collect()]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]][0] for r in tested) >= 0.95 * len(tested)
    rows = [r.asDict() for r in entry.queries()["op4_toxicity"](spark, sf_dir).collect()]
    clean = [r for r in rows if labels.get(r["doc_id"], (0, 1))[1] == 0]
    toxic = [r for r in rows if labels.get(r["doc_id"], (0, 0))[1] == 1]
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)


def test_op5_beats_single_token_counts(spark, docs):
    rows = result(spark, "op5_pseudo_likelihood")
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode().split()) for i, t in docs.items()}
    for r in rows:
        assert (r["mean"] is None) == (r["n_tokens"] == 0)
        assert r["n_tokens"] == 0 or abs(r["mean"] * r["n_tokens"] - r["pseudo_log_likelihood"]) < 1e-6 * r["n_tokens"] + 1e-6


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(v - 9 if v > 9 else v for v in twice)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_op7(spark, docs):
    for r in result(spark, "op7_pii"):
        base = plain_base(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        for kind in PII:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def test_op9(spark, docs):
    rows = result(spark, "op9_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    loads = collections.Counter()
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        loads[r["shard"]] += r["size"]
    for shard in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert max(loads.values()) - min(loads.values()) <= 0.15 * sum(loads.values()) / 16


def test_op10(spark, docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    seen = 0
    for r in result(spark, "op10_licenses"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(docs[r["doc_id"]]))
        found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        seen += len(found)
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert r["first_word"] == min((i for i, _ in found), default=None)
        assert r["last_word"] == max((i for i, _ in found), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert seen


def test_pipeline(spark):
    """Each stage keeps what it should of its own input; the last one decodes to what it was given."""
    import corpus_pipeline

    from muster.session import materialise

    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, given, SF_DIR), name)
        assert out.columns == given.columns
        before, after = given.count(), out.count()
        assert after == before if name == "personal_data" else 0.6 * before < after <= before
        if name == "near_duplicates":
            assert out.select("text").distinct().count() == after
        if name == "personal_data":
            assert not [r for r in out.select("text").collect() if plain_base(r["text"] or "")]
        given = out
    last = materialise(corpus_pipeline.STAGES[-1][1](spark, given, SF_DIR), "tokens")
    texts = {r["doc_id"]: r["text"] or "" for r in given.collect()}
    for r in last.collect():
        assert r["text"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) // 4
