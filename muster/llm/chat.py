r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns.  Each turn costs tokens (four bytes count as one, and ``MARKS`` for
its marks); running sums of the costs place it.  The line of tokens is divided into steps of ``(budget - history) / 2``: the turns that
begin in one step are the new turns of one window, and a turn longer than a step, which must be the last to begin
in its step, has a window to itself.  So new turns cost at most two steps, unless one turn alone is longer.  Before them a window
repeats the turns that begin within the last ``history`` tokens, and before those the system turn, which is kept in every
window whatever it costs.  No window depends on another one, so a conversation of any length is cut in parallel.

Every turn is new in exactly one window.  The loss mask covers the texts of new assistant turns: the same texts repeated as
history are masked, so every target is learnt once.

The template is ``<|turn|>role\ntext<|end|>\n``.  Control strings in a text, ``<|...|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>`` and ``<</SYS>>``, get a backslash after their first character; where there are backslashes already one is added, so the
change can be undone whatever the text.  Roles are percent-encoded.

Turns are in the order of turn, role and text, nulls first.  The system turn is the first turn if its role is ``system``; a
later one is like any other.  Null texts and roles are empty.  Rows without a conversation id are one conversation, whose
id is null.  Repeated rows are turns of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.ordered import running_total
from muster.operators.skew import HOT_ROWS, hot_groups, join_per_key

BUDGET = 1024
HISTORY = 256
MARKS = 4

# fixed values: the template
TURN, END = "<|turn|>", "<|end|>\n"
# fixed values: what follows the first character of a control string
_AFTER_ANGLE = r"\|[^|>]*\|>|/?s>|</?SYS>>"
_AFTER_SQUARE = r"/?INST\]"
_CONTROL = rf"(<)(\\*)(?={_AFTER_ANGLE})|(\[)(\\*)(?={_AFTER_SQUARE})"
_ESCAPED = rf"(<)\\(\\*)(?={_AFTER_ANGLE})|(\[)\\(\\*)(?={_AFTER_SQUARE})"


def escape(text: Column) -> Column:
    """No control string is left in the result."""
    return F.regexp_replace(text, _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$3$2$4")


def cost(escaped: Column) -> Column:
    return (F.lit(MARKS) + F.ceil(F.octet_length(escaped) / F.lit(4))).cast("bigint")


def marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit("\n"), text, F.lit(END))


def placed_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str, hot_rows: int) -> DataFrame:
    """Every turn with its system turn, and the tokens of the turns before it; the system turn itself lies below 0."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("by"),
        F.col(text).cast("string").alias("given"), escape(whole).alias("text"),
    ).withColumn("cost", cost(F.col("text"))).withColumn("role", F.url_encode(F.coalesce("by", F.lit(""))))
    order = ["turn", "by", "given"]
    hot = hot_groups(rows.select("key"), ["key"], hot_rows)
    summed = running_total(rows, ["key"], order, [F.lit(0)], F.col("cost"), "upto", hot_rows, hot)
    first = rows.groupBy("key").agg(F.min_by(F.struct("by", "role", "text", "cost"), F.struct(*order)).alias("first"))
    system = first.where(F.col("first.by") == "system").select("key", F.col("first").dropFields("by").alias("system"))
    led = join_per_key(summed, system, ["key"], "left", hot)
    return led.select(
        "key", "conv_id", "role", "text", "cost", "system",
        (F.col("upto") - F.col("cost") - F.coalesce("system.cost", F.lit(0))).alias("at"),
    )


def windows(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``conv_id, start, repeated, tokens, formatted, loss`` of every window.

    ``start`` orders the windows of a conversation; the first ``repeated`` turns of ``formatted`` are the system turn and history
    seen before; ``loss`` lists the spans to learn as (start, stop) in characters, stop exclusive.
    """
    step = (budget - history) // 2
    if not 0 <= history <= step:
        raise ValueError("the history must fit into a third of the budget")
    turns = placed_turns(conversations, conv, turn, role, text, hot_rows)
    leads = F.col("at") < 0
    long = (F.col("cost") > step) & ~leads
    cell = F.when(leads, F.lit(0)).otherwise(F.floor(F.col("at") / step)).cast("bigint")
    # a turn can be history in the next step only if it begins near the end of its own
    late = ~leads & ~long & (F.col("at") >= (F.col("cell") + 1) * step - history)
    dealt = (
        turns.withColumn("long", long).withColumn("cell", cell)
        .withColumn("to", F.explode(F.when(late, F.array(F.col("cell"), F.col("cell") + 1)).otherwise(F.array("cell"))))
    )
    each = F.struct(
        "at", "role", "text", "cost", "long", (F.col("to") == F.col("cell")).alias("new"),
        (F.length("role") + F.length("text") + len(TURN) + len(END) + 1).alias("size"),
    )
    met = dealt.groupBy("key", "to").agg(
        F.first("conv_id").alias("conv_id"), F.first("system").alias("system"), F.sort_array(F.collect_list(each)).alias("turns")
    )

    def new(t: Column) -> Column:
        return t["new"] & (t["at"] >= 0)

    plain = F.filter("turns", lambda t: new(t) & ~t["long"])
    alone = F.filter("turns", lambda t: new(t) & t["long"])
    only_system = ~F.exists("turns", lambda t: t["at"] >= 0)
    sides = F.filter(F.array(plain, alone), lambda w: F.size(w) > 0)
    cut = met.withColumn("own", F.explode(F.when(only_system, F.array(plain)).otherwise(sides)))
    start = F.coalesce(F.try_element_at("own", F.lit(1))["at"], F.lit(0))
    cut = cut.withColumn("start", start).withColumn(
        "all", F.concat(F.filter("turns", lambda t: (t["at"] >= F.greatest(F.lit(0), F.col("start") - history)) & (t["at"] < F.col("start"))), "own")
    )
    head = F.when(F.col("system").isNull(), F.lit("")).otherwise(marked(F.col("system.role"), F.col("system.text")))
    cut = cut.withColumn("head", head)
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")

    def follow(done: Column, t: Column) -> Column:
        begin = (done["size"] + len(TURN) + F.length(t["role"]) + 1).cast("bigint")
        span = F.struct(begin.alias("start"), (begin + F.length(t["text"])).cast("bigint").alias("stop"))
        learns = (t["at"] >= F.col("start")) & (t["role"] == "assistant")
        return F.struct(
            (done["size"] + t["size"]).cast("bigint").alias("size"),
            F.when(learns, F.concat(done["loss"], F.array(span))).otherwise(done["loss"]).alias("loss"),
        )

    loss = F.aggregate(
        "all", F.struct(F.length("head").cast("bigint").alias("size"), none.alias("loss")), follow, lambda done: done["loss"]
    )
    kept = F.when(F.col("system").isNull() | (F.col("start") == 0), 0).otherwise(1)
    return cut.select(
        "conv_id", "key", "start", (F.size("all") - F.size("own") + kept).alias("repeated"),
        (F.aggregate("all", F.lit(0).cast("bigint"), lambda n, t: n + t["cost"]) + F.coalesce("system.cost", F.lit(0))).alias("tokens"),
        F.concat("head", F.array_join(F.transform("all", lambda t: marked(t["role"], t["text"])), "")).alias("formatted"),
        loss.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, the new turns as (role, text), and ``learnt``, the texts under the loss mask."""
    parts = F.split("formatted", r"<\|turn\|>")
    own = F.slice(parts, F.col("repeated") + 2, F.size(parts))
    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(1 + len(END)))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(own, turn)).withColumn("learnt", learnt)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation with what can be read back from its windows.

    A digest of a whole conversation needs its text in one place; this is the only step that does.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_back(formatted).select(
        "conv_id", "key", "start", F.size("turns").alias("n"), said.alias("said"), F.array_join("learnt", "").alias("learnt"),
        F.length("formatted").alias("size"),
    )
    whole = F.sort_array(F.collect_list(F.struct("start", "said", "learnt")))
    joined = each.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), whole.alias("w"), F.sum("size").alias("formatted_chars")
    )
    def digest(part: str) -> Column:
        return F.sha2(F.array_join(F.transform("w", lambda w: w[part]), ""), 256)

    chars = F.aggregate("w", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w["learnt"]))
    return joined.select(
        "conv_id", "n_turns", digest("said").alias("turns_sha256"), chars.alias("loss_chars"),
        digest("learnt").alias("loss_sha256"), "formatted_chars",
    )
