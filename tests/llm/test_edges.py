"""Nulls, empty and very long texts, repeated rows, empty tables and columns whose names an operator uses itself."""

import itertools
import random
import textwrap
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm import bpe, decontaminate, licenses, lm, pii, quality, shards, simhash, topk, toxicity
from muster.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHING = ("label", "fp", "component_id", "score", "spans", "base", "row", "_text", "_row", "words", "node", "h1", "key",
            "rejected", "p_toxic", "_masked", "vslot", "n", "id")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(60_000))
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(30))


def made_rows():
    near = " ".join(rng.choice(WORDS) for _ in range(200))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, near), (6, near), (6, near), (7, near.replace(WORDS[0], "zz")),
        (8, near + " end"), (None, near), (None, None), (None, "only here " + PASSAGE), (9, PASSAGE), (9, "other text"),
        (10, "call +1 (212) 555-0199 or a.b@c.org\nReleased under the MIT License."), (11, "x" * 5000),
        (12, "stupid trash " * 30), (13, "stupid trash and more " * 30), (14, "so stupid trash " * 30),
    ]
    return [(i, t, "en", "s", None, *["?"] * len(CLASHING)) for i, t in texts]


ROWS = made_rows()


def text_rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(text_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (5, 1, 0), (9, 1, 0), (12, 0, 1), (13, 0, 1), (14, 0, 1), (10, 0, None), (None, 0, 1), (4, 1, 0), (4, 1, 0), (99, 0, 1)],
        "doc_id bigint, quality int, toxic int",
    )


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_bpe(spark, docs):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )
    rows = collected(bpe.code_documents(docs, RANKS))
    want = sorted(own.encode_ordinary(r[1] or "") for r in text_rows())
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == want
    back = bpe.decode_ids(spark.createDataFrame([(1, None), (2, bytearray(rows[0]["ids"]))], "doc_id bigint, ids binary"), RANKS)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in collected(back)}[1] == b""
    assert collected(bpe.code_documents(docs.limit(0), RANKS)) == []


def test_bpe_on_odd_texts():
    made = bpe.Coder(bpe.load_ranks(RANKS), bpe.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    parts = ["a", " ", "b1", "'s", ".", "\n", "\x1c", "\x01", "\t", "é", "!", "\xa0", "ll", "漢", "🙂", "  ", "　 "]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    odd += ["a" * 3000, " " * 1000 + "a", "=-" * 500, "aab" * 300, "".join(rng.choice("ab") for _ in range(800))]
    coded = made.encode([o.encode() for o in odd])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [own.encode_ordinary(o) for o in odd]
    assert made.decode(coded) == [o.encode() for o in odd]
    with pytest.raises(ValueError):
        made.decode([np.array([60_000], "<u4").tobytes()])


def test_simhash(docs):
    rows = collected(simhash.near_duplicates(docs))
    assert len(rows) == len(text_rows())
    empty = [r for r in rows if r["fp"] == 0]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert collected(simhash.near_duplicates(docs.limit(0))) == []


def test_links_in_crowded_keys(spark):
    """Hundreds of fingerprints that share most bits: every link is found, below each cut as well."""
    values = {rng.getrandbits(64) for _ in range(300)}
    for width in (8, 14, 30):
        base = rng.getrandbits(64)
        values |= {base ^ rng.getrandbits(width) << 20 for _ in range(400)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {(r["a"], r["b"]) for r in collected(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")))}
    u = np.array(sorted(signed), np.int64)
    near = np.bitwise_count(u[:, None].view(np.uint64) ^ u[None, :].view(np.uint64)) <= 3
    assert found == {(int(u[i]), int(u[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2000, 1999)]
    got = {r["node"]: r["root"] for r in collected(components(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b"))}
    assert got == {**{i: 0 for i in range(201)}, 1999: 1999, 2000: 1999}


def grouped_by_bits(values, radius=3):
    """The smallest position reachable over links, by comparing all pairs."""
    fps = np.array(values, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    group = np.arange(len(fps))
    while True:
        new = np.array([group[row].min() for row in near])
        if (new == group).all():
            return group.tolist()
        group = new


def test_keeping_one_of_each_component(spark):
    """Copies, near copies and families of them: what stays is the smallest of each group of a comparison of all pairs."""
    made = np.random.default_rng(77)
    family = []
    for _ in range(3):
        base = [f"b{x}" for x in made.integers(0, 10**6, 200)]
        family += [base] * 3
        for _ in range(40):
            copy = list(base)
            for at in made.choice(200, int(made.integers(1, 9)), replace=False):
                copy[at] = f"c{made.integers(0, 10**6)}"
            family.append(copy)
    family += [[rng.choice(WORDS) for _ in range(80)] for _ in range(20)]
    texts = [" ".join(f) for f in family]
    group = grouped_by_bits([simhash.fingerprint(t.encode()) % (1 << 64) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(group)) and len(kept) < len(texts)


def test_dropping_near_copies(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = text_rows()
    group = grouped_by_bits([simhash.fingerprint((r[1] or "").encode()) % (1 << 64) for r in rows])
    want = [min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=-1) for g in set(group)]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(want)
    nameless = docs.where("doc_id is null and text is null")
    assert simhash.keep_one(nameless.unionByName(nameless)).count() == 1
    assert collected(simhash.keep_one(docs.limit(0))) == []


def test_decontamination(spark, docs):
    words = PASSAGE.split()
    spoiled = " ".join(words[:9] + ["changed"] + words[10:])
    items = spark.createDataFrame(
        [(1, spoiled, "?"), (2, None, "?"), (3, ""  , "?"), (4, "too short to match", "?"), (None, spoiled, "?"), (5, spoiled, "?")],
        "item_id bigint, text string, words string",
    )
    rows = collected(decontaminate.overlaps(docs, items))
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d in (9, None) for i in (1, None, 5)}
    assert {(r["matched"], r["overlap"]) for r in rows} == {(29, 30)}
    assert {r["doc_word"] for r in rows if r["doc_id"] is None} == {2}
    assert collected(decontaminate.overlaps(docs, items.limit(0))) == []
    assert collected(decontaminate.overlaps(docs.limit(0), items)) == []


def test_masks_hit_every_overlap_the_verification_accepts():
    """All places of up to four substituted words in passages of 13 to 20 words, and every fifth word of 60."""
    looked = [[at for at, look in enumerate(mask) if look == "1"] for mask in decontaminate.MASKS]
    span = decontaminate.SPAN
    accepted = 0
    patterns = [(n, spoiled) for n in range(13, 21) for k in range(5) for spoiled in itertools.combinations(range(n), k)]
    for n, spoiled in [*patterns, (60, tuple(range(4, 60, 5)))]:
        same = [at not in spoiled for at in range(n)]
        if decontaminate.best_segment(same)[2] >= 13:
            accepted += 1
            assert any(all(same[at + i] for i in places) for at in range(n - span + 1) for places in looked), (n, spoiled)
    assert accepted > 500


def test_substituted_words_are_found(spark):
    passage = [f"p{x}" for x in range(60)]
    fifth = ["x" if at % 5 == 4 else w for at, w in enumerate(passage)]
    short = ["x" if at in (4, 9) else w for at, w in enumerate(passage[:15])]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(passage[:15]))], "item_id bigint, text string")
    given = spark.createDataFrame([(1, " ".join(fifth)), (2, " ".join(short))], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"], r["matched"]) for r in collected(decontaminate.overlaps(given, items))}
    assert {(1, 1, 48), (2, 2, 13)} <= found


def test_short_items_are_found_word_for_word(spark):
    """Items of 1 to 12 words match verbatim, at the ends of a text too, and not with a word changed or left out."""
    items = [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in range(1, 13)]
    given = [(n, f"Some words before: {text.upper()}, and after.") for n, text in items]
    given += [(100 + n, text) for n, text in items]
    given += [(200 + n, "other " + text.replace(f"s{n}x{n - 1}", "changed")) for n, text in items]
    given += [(300, "")]
    found = collected(decontaminate.overlaps(
        spark.createDataFrame(given, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ))
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in found} == {(d + n, n, n) for n in range(1, 13) for d in (0, 100)}


def test_toxicity(docs, labels):
    chain = toxicity.fit(docs, labels)
    rows = collected(toxicity.score(docs, chain))
    assert len(rows) == len(text_rows())
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in ("insult", "contempt", "toxic"))
    best = max(rows, key=lambda r: r["p_toxic"])
    assert best["doc_id"] in (12, 13, 14)
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None
    assert not any(r["rejected"] for r in collected(toxicity.score(docs, None)))
    assert collected(toxicity.score(docs.limit(0), chain)) == []


def test_language_model(docs):
    network = lm.fit(docs)
    rows = collected(lm.score(docs, network))
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["mean"] is None and r["pseudo_log_likelihood"] == 0 for r in rows if not r["n_tokens"])
    assert all(np.isfinite(r["pseudo_log_likelihood"]) for r in rows)
    assert collected(lm.score(docs.limit(0), lm.fit(docs.limit(0)))) == []


def test_language_model_uses_both_sides(spark):
    """In 'a x b' and 'c x d' the outer words tell the middle one; a trained network beats single-word counts."""
    texts = [(i, " ".join(rng.choice(["aa mm bb", "cc nn dd"]) for _ in range(200))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = collected(lm.score(df, lm.fit(df, rounds=((1, 0.2),) * 5)))
    assert sum(r["pseudo_log_likelihood"] for r in rows) / sum(r["n_tokens"] for r in rows) > -0.6  # counts alone: -1.79


def plain_log_likelihood(model, counts, text):
    """Every word by itself: softmax over the groups, softmax over the group's tokens, share of the class."""
    net, words = model.network, text.lower().encode().split()
    place = {w: i + 1 + lm.CLASSES for i, w in enumerate(net.words)}

    def kind(w):
        return 1 + (len(w) * 13 + w[0] * 7 + w[-1] * 5) % lm.CLASSES

    tokens = [place.get(w, kind(w)) for w in words]
    size = [1] * (lm.CLASSES + 1)
    for w, n in counts.items():
        if w not in place:
            size[kind(w)] += n + 1
    total = 0.0
    for at, token in enumerate(tokens):
        hidden = net.bias.astype(float)
        for p, offset in enumerate(lm.OFFSETS):
            hidden = hidden + net.near[p, tokens[at + offset] if 0 <= at + offset < len(tokens) else 0]
        hidden = np.append(np.tanh(hidden), 1.0)
        for logits, target in ((hidden @ net.group, token // lm.MEMBERS),
                               (hidden @ net.member[token // lm.MEMBERS], token % lm.MEMBERS)):
            total += logits[target] - np.log(np.exp(logits).sum())
        if words[at] not in place:
            total += np.log((counts.get(words[at], 0) + 1) / size[token])
    return total


def test_language_model_against_a_plain_sum(spark):
    """Every word of the corpus counts, whether it is a token, held, joined or unknown; rows that repeat score each."""
    gen = random.Random(4)
    words = [f"w{int(gen.paretovariate(0.6)) % 3000}" for _ in range(20_000)]
    rows = [(i % 190, " ".join(words[100 * i : 100 * i + 100])) for i in range(200)] + [(None, ""), (None, None)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = Counter(w for _, t in rows for w in (t or "").encode().split())
    model = lm.fit(df, held=100)
    assert len(counts) > 500 and len(model.held) == 100 and model.counts.count() == len(counts) - 100 - len(model.network.words)
    fresh = spark.createDataFrame([*rows, (7, "W1 notseen W2 notseen")], df.schema)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["pseudo_log_likelihood"]) for r in collected(lm.score(fresh, model)))
    want = sorted(
        (i or -1, len((t or "").split()), plain_log_likelihood(model, counts, t or "")) for i, t in [*rows, (7, "W1 notseen W2 notseen")]
    )
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-4, atol=1e-3)


def test_rare_words_of_one_class_score_apart(spark):
    """Two words with the same length and ends stand in the same places; the one that occurs more often scores higher."""
    common = [f"c{i:03d}" for i in range(lm.VOCABULARY)]
    rows = [(i, f"{' '.join(common)} ruby {' '.join(common)}") for i in range(20)] + [(20, f"{' '.join(common)} rapy {' '.join(common)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    score = {r["doc_id"]: r["pseudo_log_likelihood"] for r in collected(lm.score(df, lm.fit(df, held=0)))}
    # ruby occurs 20 times, rapy once: (20 + 1) / (1 + 1) as often, to the rounding of a batch
    assert abs(score[0] - score[20] - np.log(21 / 2)) < 0.05


def plain_top(vectors, k):
    q = {(i, n): [int(np.floor(256 * float(x))) for x in v] for n, (i, v) in enumerate(vectors)
         if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, a in {(i, tuple(a)) for (i, _), a in q.items() if i % 50 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for (j, _), b in q.items()
                        if j != i and len(a) == len(b))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    def vector(n):
        return [rng.uniform(-2, 2) for _ in range(n)]

    same = vector(8)
    rows = [(i, vector(8)) for i in range(120)] + [(200 + i, same) for i in range(30)] + [(250, vector(3)), (251, vector(3))]
    rows += [(300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, same)]
    rows += [(100, same), (350, [1e6] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id bigint, embedding array<double>, rank string, id string")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_top(rows, 5)
    assert topk.top_k(df.where("vec_id % 50 = 0"), df.limit(0)).count() == 0
    assert topk.top_k(df.limit(0), df).count() == 0


def test_top_k_of_one_slice():
    """A whole slice against a chunk of queries: the same rows as all scores sorted, in bounded memory, dense or not."""
    made = np.random.default_rng(8)
    c = np.floor(256 * made.normal(size=(8192, 64)))
    c[4000:6000] = c[4000]  # a vector with many copies
    q = np.concatenate([c[:200], c[4000:4040], np.floor(40 * made.normal(size=(16, 64)))])
    ids, q_ids = np.arange(8192), np.concatenate([np.arange(200), np.arange(4000, 4040), np.arange(9000, 9016)])
    scores = (q @ c.T).astype(np.int64)
    want = []
    for row, own in zip(scores, q_ids, strict=True):
        order = [i for i in np.lexsort((ids, -row)) if ids[i] != own][:5]
        want.append([(int(i), int(row[i])) for i in order])
    for dense in (topk.DENSE, 2.0):
        topk.DENSE, before = dense, topk.DENSE
        try:
            tracemalloc.start()
            left, right, score = topk.tile_top(q_ids, q, ids, c, 5)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        finally:
            topk.DENSE = before
        assert [[(int(r), int(s)) for r, s in zip(right[left == i], score[left == i], strict=True)] for i in range(len(q))] == want
        assert dense > 1 or peak < 500 << 20


def test_personal_data(docs):
    found = collected(pii.find_spans(docs))
    assert set(found[0]) == {*docs.columns, "base", "spans"}
    spans = next(r["spans"] for r in found if r["doc_id"] == 10)
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", 26, 35), ("phone", 5, 22)]
    masked = docs.withColumn("spans", pii.base_spans(F.coalesce("text", F.lit(""))))
    texts = {r[0]: r[1] for r in masked.select("doc_id", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert texts[10].startswith("call [PHONE] or [EMAIL]\n") and texts[1] is None and texts[4] == LONG
    assert collected(pii.find_spans(docs.limit(0))) == []


def test_personal_data_in_long_runs(spark):
    texts = ["1" * 50_000, "1 " * 30_000, "a@b" + ".c" * 20_000, "a" * 100_000, "+" + "1" * 40_000, "1.2.3.4." * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["doc_id"]: r["base"] for r in collected(pii.find_spans(df))}
    assert [len(rows[i]) for i in range(6)] == [0, 0, 1, 0, 0, 2000]


def test_personal_data_learns_secrets(spark):
    """Identifiers with a cue teach the trees; the same kind of identifier without one is added."""
    rows = [(i, f"note token = {rng.getrandbits(160):040x} and item {rng.randint(1, 99)}") for i in range(300)]
    rows += [(1000, f"plain {rng.getrandbits(160):040x} here")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    spans = next(r["spans"] for r in collected(pii.find_spans(df)) if r["doc_id"] == 1000)
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("secret", 6, 46)]


def luhn(body):
    digits = [int(c) for c in body]
    total = sum(d if at % 2 else sum(divmod(2 * d, 10)) for at, d in enumerate(reversed(digits)))
    return body + str(-total % 10)


def test_personal_data_in_loose_formats(spark):
    """Spans in loose formats, which no rule takes, are added and masked; other numbers are left alone."""
    gen = random.Random(11)

    def phone():
        return f"+1 ({gen.randint(200, 999)}) 555-{gen.randint(1000, 9999)}"

    rows = []
    for i in range(400):
        word = gen.choice(WORDS)
        rows.append((i, gen.choice([
            f"{word} {word}.{i}@mail{i % 9}.example.com {word}", f"{word} {phone()} or so", f"paid {luhn('4' + str(gen.randrange(10**14, 10**15 - 1))[:14])} by",
            f"order {gen.randrange(10**15, 10**16)} of {gen.randint(1990, 2024)}-{gen.randint(10, 12)}-{gen.randint(10, 28)}",
            f"host 10.{i % 200}.3.{i % 99} item {gen.randrange(10**8, 10**9)} {word}",
        ])))
    card = luhn("4539578763621" + "48")
    loose = {
        1001: ("email", "jo.doe [at] mail3 [dot] example [dot] com"), 1002: ("email", "jo.doe(at)example.com"),
        1003: ("card", f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"), 1004: ("phone", "(415) 555-0132"),
        1005: ("phone", "415-555-0132"),
    }
    clean = {2001: "on 2023-11-05 we", 2002: "part 123456789 was", 2003: f"lot {int(card) + 1} is", 2004: "sum 1234567 of"}
    rows += [(i, f"see {match} please") for i, (_, match) in loose.items()] + list(clean.items())
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = pii.find_spans(df).withColumn("masked", pii.redact(F.col("text"), F.col("spans")))
    got = {r["doc_id"]: r for r in found.where("doc_id > 1000").collect()}
    for i, (kind, match) in loose.items():
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]] == [(kind, 4, 4 + len(match))], (kind, match)
        assert got[i]["masked"] == f"see [{kind.upper()}] please" and not got[i]["base"]
    assert all(not got[i]["spans"] for i in clean)


def test_loosened_spans_are_proposals(spark):
    """Every loose format is one that the generators propose whole."""
    rows = [("email", f"u{i}.x@mail{i}.example.com") for i in range(20)] + [("phone", f"+1 ({300 + i}) 555-{1000 + i}") for i in range(40)]
    rows += [("card", luhn(str(400000000000000 + 7919 * i))) for i in range(20)]
    df = spark.createDataFrame(rows, "kind string, match string")
    for kind in ("email", "phone", "card"):
        part = df.where(F.col("kind") == kind).select(pii.loosened(kind, F.col("match")).alias("loose"))
        assert part.where(~F.col("loose").rlike("^" + pii.LOOSE[kind] + "$")).collect() == []


def test_quality(docs, labels):
    model = quality.fit(docs, labels)
    rows = collected(quality.score(docs, model))
    assert len(rows) == len(text_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in collected(quality.score(docs, None))} == {0.5}
    assert collected(quality.score(docs.limit(0), model)) == []


def test_quality_gradient():
    gen = np.random.default_rng(2)
    x, doc = gen.standard_normal((9, quality.N_FEATURES)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3])
    y, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    model = quality.Attention(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    before = model.score(x, doc)
    after = model.fit(x, doc, y, weight, 200).score(x, doc)
    assert np.abs(after - y).max() < 0.05 < np.abs(before - y).max()


def test_shards(spark, docs):
    rows = collected(shards.shard_documents(docs, n_shards=3))
    assert len(rows) == len(text_rows())
    for shard in {r["shard"] for r in rows}:
        places = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert collected(shards.shard_documents(docs.limit(0))) == []


def test_rebalancing_edits_the_map(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    rows, path = shards.records(df, "doc_id", "text", 512), str(tmp_path / "map")
    weights = shards.slot_weights(rows)
    shards.store_map(spark, path, 0, weights, shards.edit_map(weights, 8))
    assert shards.rebalance(spark, path, 0, rows, 9) == 1
    old, new = ({r["vslot"]: r["shard"] for r in shards.load_map(spark, path, v).collect()} for v in (0, 1))
    moved = [s for s in old if old[s] != new[s]]
    assert {new[s] for s in moved} >= {8} and len(moved) < 0.2 * len(old)
    size = {s: b for s, b, _ in weights}
    loads = [sum(size[s] for s in new if new[s] == shard) for shard in range(9)]
    assert max(loads) <= 1.05 * sum(loads) / 9


def test_licenses(docs):
    rows = {r["doc_id"]: r for r in collected(licenses.scan_licenses(docs))}
    found = rows[10]
    assert [(p["word"], p["label"]) for p in found["places"]] == [(13, "mit")]
    assert [(b["block"], b["label"], b["containment"]) for b in found["blocks"]] == [(1, "mit-notice", 1.0)]
    assert rows[1]["n_words"] == 0 and rows[1]["blocks"] == []
    assert collected(licenses.scan_licenses(docs.limit(0))) == []
    assert all(not r["blocks"] for r in collected(licenses.scan_licenses(docs, templates={})))


def test_wrapped_notices(spark):
    """Every template, wrapped at 72 and at 30 columns behind comment signs, within other words."""
    rows, labels = [], list(licenses.TEMPLATES)
    for at, label in enumerate(labels):
        for more, columns in ((0, 72), (100, 30)):
            lines = textwrap.wrap("Some file. " + licenses.TEMPLATES[label], columns)
            rows.append((at + more, "first line\n" + "\n".join(" * " + x for x in lines) + "\n\nint main"))
    found = collected(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for r in found:
        label = labels[r["doc_id"] % 100]
        assert (label, 1.0) in [(b["label"], b["containment"]) for b in r["blocks"]]
        assert all(b["block"] >= 1 and b["word"] >= 4 for b in r["blocks"] if b["label"] == label)


def test_near_notices_are_told_apart(spark):
    lesser = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
              "General Public License as published by the Free Software Foundation")
    scattered = " word ".join(w for w in licenses.TEMPLATES["all-rights"].split())
    cases = [
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]), ("Licensed under CC BY-SA 4.0.", ["cc-by-sa"]),
        ("Licensed under CC BY-ND 4.0.", []), ("Released under the BSD License", []), (lesser, ["lgpl-notice"]),
        ("the GNU Lesser General Public License, version 3", []), (scattered, []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", []),
        *[(text, [label]) for label, text in licenses.TEMPLATES.items()],
    ]
    given = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id bigint, text string")
    for r in collected(licenses.scan_licenses(given)):
        assert [b["label"] for b in r["blocks"] if b["named"]] == cases[r["doc_id"]][1], cases[r["doc_id"]][0]
    both = licenses.TEMPLATES["gpl-notice"] + ", version 3"
    found = collected(licenses.scan_licenses(spark.createDataFrame([(1, both)], "doc_id bigint, text string")))[0]["blocks"]
    assert [(b["label"], b["containment"], b["named"]) for b in found] == [("gpl-notice", 1.0, True), ("gpl-version", 1.0, True)]


def test_license_blocks_against_all_windows():
    """A block is given for every window of a text that meets the threshold: each is one of them, and each overlaps one given."""
    vocabulary = [f"w{i}".encode() for i in range(14)]
    templates = {f"t{i}": " ".join(w.decode() for w in rng.choices(vocabulary, k=rng.randint(1, 9))) for i in range(12)}
    counts = {w: rng.randint(0, 9) for w in vocabulary}
    sets = licenses.template_sets(templates)
    met = 0
    for threshold in (0.5, 0.8, 1.0):
        matcher = licenses.Matcher(templates, counts, threshold)
        for _ in range(150):
            text = [rng.choice([*vocabulary, b"x", b"y"]) for _ in range(rng.randint(0, 40))]
            got = {label: [] for label in sets}
            for start, label, share, _ in matcher.find(text):
                got[label].append((start, share))
            for label, words in sets.items():
                width = matcher.width[label]
                windows = {
                    (a, b): len(words & set(text[a:b])) / len(words) for a in range(len(text)) for b in range(a + 1, min(a + width, len(text)) + 1)
                    if len(words & set(text[a:b])) >= threshold * len(words) - 1e-9
                }
                given = [min(((b, a) for (a, b), s in windows.items() if a == start and s == share), default=None) for start, share in got[label]]
                assert None not in given
                met += len(given)
                for a, b in windows:
                    assert any(a < stop and start < b for stop, start in given), (label, a, b)
                for (stop, _), (_, start) in zip(sorted(given), sorted(given)[1:]):
                    assert stop <= start
    assert met > 1000


def test_many_notices_in_one_text(spark):
    """Fifty thousand notices are found one by one, in time that grows with the text."""
    line = licenses.TEMPLATES["mit-notice"] + ". "
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 0.8, licenses.TELLING, licenses.BARRED)
    words = [w for part in licenses.blocks_of((line + "x y z ") .encode() * 50_000) for w in part]
    started = time.time()
    found = matcher.find(words)
    assert sum(label == "mit-notice" and share == 1.0 for _, label, share, _ in found) == 50_000
    assert time.time() - started < 20


def test_pipeline_stages(spark, docs, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([(12, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf_dir)
            if name != "tokens":
                assert out.columns == given.columns, name
            rows = out.collect()
            if name == "decontamination" and given.columns:
                assert not [r for r in rows if PASSAGE in (r["text"] or "")]
            assert len(rows) <= len(text_rows())
