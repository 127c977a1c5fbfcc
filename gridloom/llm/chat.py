r"""Event-sourced chat reconstruction and rendering with a loss mask.

Events: conv, msg (any orderable value; messages of a conversation stand in its order), seq (orderable within the
conversation), kind, role, text. Kinds: `open` starts a message, `delta` appends, `edit` replaces the text so far,
`regenerate` empties it and withdraws every later message that began before it.

Fold: messages are grouped by (conv, msg), so the events of a hot conversation are spread over tasks; the last reset of a message
and the deltas after it make its text; a running maximum over the conversation finds withdrawn messages. That maximum and the
rendering order the messages of a conversation in one task, as its one output row does anyway. Rendering gives
`<|im_start|>role\ntext<|im_end|>\n` per message. Inside roles and texts a backslash is doubled and one is put after
the first character of each control string, so no text can close or open a turn; `unescape` undoes it exactly.

Edge cases: null text and role are empty; a null msg sorts first; equal events are all kept; a message whose events
were all withdrawn disappears, and so does a conversation without messages; deltas before any `open` start the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, sha_hex, text_of

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates; every one gets a backslash after its first character.
CONTROLS = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
CONTROL_PATTERN = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL_PATTERN, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv, msg, role, text): the final messages."""
    e = events.select("conv", "msg", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    m = e.groupBy("conv", "msg").agg(
        F.min("seq").alias("born"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        F.max_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
    )
    reset = F.aggregate("log", F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when(x["kind"] != "delta", a["i"]).otherwise(a["last"]).alias("last")))
    m = m.withColumn("last", reset["last"])
    kept = F.slice("log", F.col("last") + 1, F.size("log"))
    m = m.withColumn("text", F.array_join(F.transform(kept, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), ""))
    redone = F.max("redone").over(W.partitionBy("conv").orderBy("msg").rowsBetween(W.unboundedPreceding, -1))
    m = m.withColumn("withdrawn", F.coalesce(redone > F.col("born"), F.lit(False)))
    return m.filter(~F.col("withdrawn")).select("conv", "msg", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv, formatted, mask): the string of a conversation and the code point spans [s, e) that carry loss."""
    m = messages.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    m = m.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = F.coalesce(F.sum(F.length("turn")).over(W.partitionBy("conv").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("s", before + F.length("head"))
    span = F.when(F.col("role") == trained, F.struct(F.col("s"), (F.col("s") + F.length("body")).alias("e")))
    g = m.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("msg", "turn"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("mask"))
    return g.select("conv", F.array_join("turns.turn", "").alias("formatted"), "mask")


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a rendered conversation."""
    turns = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(turns, 2, F.size(turns))
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.regexp_extract(t, r"^[^\n]*\n((?s:.*))<\|im_end\|>\n$", 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["s"].cast("int") + 1, (m["e"] - m["s"]).cast("int")))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """Each row as the log of a streamed message. A third of the rows (by hash) opens and arrives in two deltas; a third starts with its
    second half and is edited to the first one before the rest follows; a third is begun wrongly, regenerated, and streamed again."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("t"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("msg", F.struct("turn", "role", F.xxhash64("t").alias("h"), "uid"))
    half = F.expr("cast(length(t) / 2 as int)")
    front, back, none = F.substring(F.col("t"), F.lit(1), half), F.substring(F.col("t"), half + 1, F.length("t")), F.lit("")

    def log(*steps: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps)])

    way = F.pmod(F.xxhash64("conv", "turn", "role"), F.lit(3))
    events = (
        F.when(way == 0, log(("open", none), ("delta", front), ("delta", back)))
        .when(way == 1, log(("open", back), ("edit", front), ("delta", back)))
        .otherwise(log(("open", none), ("delta", back), ("regenerate", none), ("delta", front), ("delta", back)))
    )
    e = rows.select("conv", "msg", "role", F.explode(events).alias("e"))
    return e.select("conv", "msg", F.struct("msg", F.col("e.k").alias("k")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def by_turn(messages: DataFrame) -> DataFrame:
    """Messages of `events_of` in the order of turn, role and text: turns that tie are told apart by what they say."""
    return messages.withColumn("msg", F.struct("msg.turn", "role", "text", "msg.uid"))


def digest(rendered: DataFrame) -> DataFrame:
    r = rendered.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha_hex(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha_hex(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows plus conversation -1, whose texts are control strings."""
    probe = conversations.sparkSession.sql(f"select -1L as conv_id, x.turn as turn, x.role as role, '{PROBE}' as text from (select explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) as x)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(render(by_turn(fold(events_of(with_probe(read(spark, sf_dir, "conversations")))))))
