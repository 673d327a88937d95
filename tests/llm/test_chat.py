"""Chat windows: what is formatted can be read back, whatever the texts hold; budgets, history and masks."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.llm import chat

rng = random.Random(12)
PARTS = ["<|turn|>", "<|end|>", "<|end|>\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|>", "<|", "|",
         "a", "\n", " ", "é", "🙂", "INST]", "s>", "$1", "/s>", ">"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def text(n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def made():
    rows = []
    for conv in range(60):
        turns = rng.choice([1, 2, 5, 30])
        if rng.random() < 0.5:
            rows.append((conv, 0, "system", text(rng.choice([0, 5, 3000]))))
        rows += [(conv, t, rng.choice(["user", "assistant"]), text(rng.choice([0, 3, 40, 900]))) for t in range(1, turns)]
    rows += [(70, t, "assistant" if t % 2 else "user", f"turn {t}" * (t % 5)) for t in range(600)]  # one long conversation
    rows += [(71, 1, "user", None), (71, None, "assistant", "first"), (71, 1, None, "x"), (71, 1, None, "x"), (72, 3, "system", "alone"),
             (73, 1, "user", "q"), (73, 2, "system", "late"), (73, 3, "od d\n<|turn|>%/role", "r"), (None, 0, "user", "no id"),
             (None, 1, "assistant", "none"), (74, 0, "user", "z" * 100_000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


def by_conversation(rows):
    out = {}
    for conv, turn, role, said in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", said is not None, said or ""))
    return {c: [(r[3], r[5]) for r in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_windows(spark, rows, hot_rows):
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA + ", system string, formatted string").repartition(5)
    out = chat.read_back(chat.windows(df, budget=200, history=50, hot_rows=hot_rows)).collect()
    want = by_conversation(rows)
    got = {}
    for r in sorted(out, key=lambda r: r["start"]):
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(want)
    for conv, made_windows in got.items():
        said = want[conv]
        system = said[0] if said[0][0] == "system" else None
        assert [tuple(t) for r in made_windows for t in r["turns"]] == said
        assert "".join(x for r in made_windows for x in r["learnt"]) == "".join(x for role, x in said if role == "assistant")
        seen = 0
        for r in made_windows:
            parts = r["formatted"].split("<|turn|>")[1:]
            assert all(p.endswith("<|end|>\n") and p.count("<|end|>") == 1 for p in parts)
            assert len(parts) == r["repeated"] + len(r["turns"])
            assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", r["formatted"])
            if system:
                assert parts[0].startswith("system\n")
            # history is the turns just before the first new one, within its limit
            history = r["repeated"] - (1 if system and seen else 0)
            if history:
                tail = [p.split("\n", 1)[1][: -len("<|end|>\n")] for p in parts[r["repeated"] - history : r["repeated"]]]
                again = spark_free_escape(said[seen - history : seen])
                assert tail == again
                assert sum(4 + -(-len(t.encode()) // 4) for t in tail) <= 50
            own = [4 + -(-len(t.encode()) // 4) for t in spark_free_escape([tuple(t) for t in r["turns"] if tuple(t) != system])]
            assert sum(own) <= 150 or len(own) == 1
            seen += len(r["turns"])
    assert max(len(v) for v in got.values()) > 20 and any(r["repeated"] > 1 for r in out)


def spark_free_escape(turns):
    control = re.compile(r"(<)(\\*)(?=\|[^|>]*\|>|/?s>|</?SYS>>)|(\[)(\\*)(?=/?INST\])")
    return [control.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4] or ''}", t) for _, t in turns]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=200, max_size=300))
def test_escapes_can_be_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not re.search(r"<\|[^|>]*\|>|</?s>|\[/?INST\]|<</?SYS>>", r["e"])


def test_native_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plan = chat.digests(chat.windows(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)
    assert chat.digests(chat.windows(df.limit(0))).collect() == []
    with pytest.raises(ValueError, match="history"):
        chat.windows(df, budget=100, history=60)
