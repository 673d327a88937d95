"""Collocations against a plain version, the bit table's false hits, and the edges."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from muster.llm import phrases

rng = random.Random(13)
WORDS = ["of", "the", "new", "york"] * 6 + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(40)]
SCHEMA = "doc_id bigint, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, longest, share, best):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(ln == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q)))
               for (ln, q), b in candidates.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s)
            for lang, rows_ in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:best], 1)}


def text(n):
    return "".join(rng.choice(WORDS) + rng.choice([" "] * 12 + ["\t", "  ", ". ", "\n", ", ", "\x0b"]) for _ in range(n))


def made_rows():
    same = "New York of the new york; the New\tYork, \x1codd\x85 \xa0word É é"
    rows = [(i, text(rng.randint(1, 200)), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(200 + i, same, "en") for i in range(40)] + [(1, same, "en")] * 3
    rows += [(300, None, "en"), (301, "", "fr"), (302, " .;\n", "fr"), (None, "aa bb " * 50, None), (303, text(30_000).replace(".", " "), "en"),
             (304, "und " * 40, "und")]
    return rows


def got(df):
    return {tuple(r) for r in df.collect()}


def test_against_a_plain_version(spark):
    rows = made_rows()
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA + ", phrase string, n string").repartition(6)
    assert got(phrases.collocations(df)) == plain(rows, 30, 4, 80, 2000)
    assert got(phrases.collocations(df, least=8, longest=3, share=50, best=25)) == plain(rows, 8, 3, 50, 25)


def test_phrases_let_through_by_mistake_change_nothing(spark, monkeypatch):
    """A table of 2**4 bits lets nearly all phrases pass; counts decide."""
    rows = made_rows()[:150]
    monkeypatch.setattr(phrases, "FEWEST_BITS", 4)
    monkeypatch.setattr(phrases, "MOST_BITS", 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(phrases.collocations(df, least=20)) == plain(rows, 20, 4, 80, 2000)


def test_large_counts_are_exact(spark):
    counts = spark.createDataFrame([("x", "a b", 4 * 10**18), ("x", "a", 4 * 10**18 + 1), ("x", "b", 4 * 10**18 + 3)], "lang string, phrase string, f bigint")
    row = phrases.scored(counts.where("phrase = 'a b'"), counts).first()
    assert row["score"] == 2000000 * 4 * 10**18 // (8 * 10**18 + 4)


def test_relation_is_sorted_and_pieces_stand_apart(spark):
    df = spark.createDataFrame([(1, " a b. c", "en"), (2, "d", "en")], SCHEMA).coalesce(1)
    part = phrases.occurrences(df).first()
    places, codes, tuples = np.cumsum(np.frombuffer(part["gaps"], "<i4")), *(np.frombuffer(part[c], "<i4") for c in ("codes", "tuples"))
    words = part["words"].decode().split(" ")
    assert [words[tuples[c]] for c in codes] == ["a", "b", "c", "d"] and part["n"] == part["kinds"] == 4
    assert np.diff(places).tolist() == [1, 2, 2]


def test_parts_and_groups_of_any_size_count_alike(spark, monkeypatch):
    rows = made_rows()[:100]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    found = []
    for part_bytes, group in ((1, 1 << 22), (500, 100), (1 << 23, 3)):
        monkeypatch.setattr(phrases, "GROUP", group)
        parts = phrases.occurrences(df, part_bytes=part_bytes).cache()
        held = phrases.Frequent(phrases.perhaps_frequent(parts, 60))
        found.append(sorted(r for r in phrases.counted(parts, held).collect() if r["f"] >= 60))
    assert found[0] == found[1] == found[2] and len(found[0]) > 5


def test_a_file_of_many_parts_is_not_one_batch(spark, tmp_path, monkeypatch):
    """All parts of a task were one row group and one page, so its memory grew with its split; small parts share a row group."""
    monkeypatch.setattr(phrases, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(phrases, "ROW_GROUP_BYTES", 4000)

    def groups(name, words, part_bytes):
        df = spark.createDataFrame([(i, text(words), "en") for i in range(40)], SCHEMA).coalesce(1)
        parts, path = phrases._written(phrases.occurrences(df, part_bytes=part_bytes), name)
        file, = (tmp_path / name).glob("*.parquet")
        found = pq.ParquetFile(file).metadata
        assert sorted(parts.collect()) == sorted(phrases.occurrences(df, part_bytes=part_bytes).collect())
        return found.num_rows, [found.row_group(i).num_rows for i in range(found.num_row_groups)]

    rows, each = groups("large", 200, 2000)
    assert rows >= 8 and each == [1] * rows
    rows, each = groups("small", 10, 1)
    assert rows == 40 and 1 < len(each) < 40


def test_tables_of_bits_do_not_pile_up(spark, monkeypatch):
    """Executors kept the tables of all lengths, up to 32 MiB each, until the driver happened to collect its garbage."""
    sent, gone, context = [], [], type(spark.sparkContext)
    broadcast = context.broadcast

    def noted(self, value):
        out = broadcast(self, value)
        if isinstance(value, phrases.Frequent):
            assert sent == gone
            sent.append(out._jbroadcast.id())
            destroy = out.destroy
            out.destroy = lambda *a: (gone.append(sent[-1]), destroy(*a))
        return out

    monkeypatch.setattr(context, "broadcast", noted)
    rows = made_rows()[:60]
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=8)) == plain(rows, 8, 4, 80, 2000)
    assert len(sent) == 7 and gone == sent


def test_empty_table(spark):
    df = spark.createDataFrame(made_rows()[:3], SCHEMA)
    assert got(phrases.collocations(df.limit(0))) == set()
    assert got(phrases.collocations(df.withColumn("text", df["text"].substr(0, 0)))) == set()
