"""Ranked search against a plain version, bags of copies, blocks of items, and the edges."""

import math
import random
import re
from collections import Counter

from muster.llm import ranked

rng = random.Random(11)
WORDS = ["the", "of"] * 20 + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) for _ in range(150)]


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def plain_search(docs, items, k):
    bags = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in bags if t]
    total, count = sum(n for _, _, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for item, text in set(items):
        wanted.setdefault(item, []).extend(plain_terms(text))
    out = {}
    for item, terms in wanted.items():
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (i, -score)
    return out


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made_docs():
    same = text(30)
    docs = [(i, text(rng.randint(1, 60))) for i in range(100)]
    docs += [(1000 - i, same) for i in range(60)]  # one bag, more members than an item returns
    docs += [(2000 + i, same.upper() + " !?" + " zz" * (i % 2)) for i in range(40)]
    docs += [(3000, None), (3001, ""), (3002, " ... "), (None, same), (None, text(9)), (5, docs[5][1]), (3003, text(40_000)),
             (3004, "Größe ÄÖ x9 \x00y"), (3005, "größe äö X9_y")]
    return docs


def found(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_against_a_plain_version(spark):
    docs = made_docs()
    items = [(i, text(rng.randint(1, 20))) for i in range(30)] + [(40, docs[120][1]), (41, "Größe x9"), (42, None), (43, ""), (44, "unheard-of-word")]
    items += [(1, items[1][1]), (2, text(5)), (None, text(3))]
    given = spark.createDataFrame([(*d, "?", 1, "?") for d in docs], "doc_id bigint, text string, score string, n int, bag string").repartition(7)
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (20, 3):
        want = plain_search(docs, items, k)
        assert found(ranked.search(given, wanted, k)) == want
    assert found(ranked.search(given, wanted, 3, block_bytes=600)) == want  # several passes


def test_blocks_are_bounded(spark):
    rows = [(i, f"w{i}_{j}", 1) for i in range(50) for j in range(10)]
    postings = spark.createDataFrame(rows, "item_id bigint, term string, times bigint").cache()
    made = list(ranked.blocks(postings, 5_000))
    assert len(made) > 3 and sorted(i for b in made for i in b.items) == list(range(50))
    assert all(sum(len(t) + 24 for t in b.vocabulary) <= 5_000 for b in made)


def test_small_cells_give_the_same_scores(spark, monkeypatch):
    docs = made_docs()[:60]
    block = ranked.Block(ranked.item_terms(spark.createDataFrame([(i, text(9)) for i in range(5)], "item_id bigint, text string"), "item_id", "text").toArrow())
    counted = ranked.bags(spark.createDataFrame(docs, "doc_id bigint, text string"), block)
    batches = ranked.classes(counted.cache(), 60, 2000, 20).toArrow().to_batches()
    import numpy as np

    weights = np.arange(len(block.vocabulary)) + 5

    def run():
        scorer = ranked.Scorer(block, weights, 4)
        for b in batches:
            scorer.add(b)
        return scorer.rows().to_pydict()

    whole = run()
    monkeypatch.setattr(ranked, "CELLS", 7)
    assert run() == whole and whole["score"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(some, items.limit(0)).collect() == []
    assert ranked.search(some.where("doc_id = 2"), items).collect() == []
    assert [tuple(r) for r in ranked.search(some, items).collect()][0][:3] == (1, 1, 1)
