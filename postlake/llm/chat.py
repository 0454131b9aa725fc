"""Chat formatting from an event log, in DataFrame functions only.

An event is (conv_id, turn, seq, op, role, text). Within a message (conversation and turn) the events fold
by seq: `delta` appends a piece, `edit` replaces what is there by its text, `regenerate` starts over with
its text (null: nothing). What precedes the last edit or regeneration is dropped, the rest is joined.

A conversation is rendered as segments: for each message `<|role|>` and a line feed, its text, `<|end|>` and
a line feed. Control strings inside roles and texts are escaped with a backslash after their first
character, backslashes are doubled; `unescape` undoes both. Segments of assistant texts carry the loss mask.

Null texts and roles count as empty. Repeated events each count; stored rows of one turn follow each other by role,
then text, and those without a turn come first. No rows: none. A conversation's messages
end up in one row, because its rendering is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of this template and of common others.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
END = "<|end|>\n"

#: Characters of a streamed piece when a stored message is turned into events.
PIECE = 256

SEGMENT = "array<struct<text:string,loss:boolean>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s:(.))", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): the final messages.

    `copy` tells apart messages that stand at the same turn; logs without it have one per turn. The last
    role that an event of the message names is its role. Events with equal seq are taken by op, then text.
    """
    key = ["conv_id", "turn", "copy"]
    starts = F.col("op").isin("edit", "regenerate")
    order = Window.partitionBy(*key).orderBy("seq", "op", "text")
    since = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = F.count(F.when(starts, 1)).over(since) - F.when(starts, 1).otherwise(0)
    last = F.max_by(F.col("role"), F.struct("seq", "op"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "op", "text")))
    return (
        events.withColumn("_later", later)
        .filter(F.col("_later") == 0)
        .groupBy(*key)
        .agg(last.alias("role"), F.array_join(pieces["text"], "", "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns and the segments of its text with the loss mask."""
    opening = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    segments = F.array(
        F.struct(opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    ).cast(SEGMENT)
    rows = messages.select("conv_id", F.struct("turn", "copy", segments.alias("segments")).alias("m"))
    sorted_rows = F.array_sort(F.collect_list("m"))
    return rows.groupBy("conv_id").agg(F.flatten(sorted_rows["segments"]).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, unescaped."""
    parts = F.filter(F.split(text, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"^<\|(?s:(.*?))\|>\n", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"^<\|(?s:.*?)\|>\n(?s:(.*))$", 1)).alias("text"),
        ),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """Stored messages as the log of a stream: pieces of PIECE characters, in order.

    Rows of one turn are messages of their own, numbered by role and text. The rows are dealt by conversation once;
    folding and rendering need no other exchange.
    """
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).repartition("conv_id")
    pieces = F.greatest(F.ceil(F.char_length("text") / PIECE), F.lit(1)).cast("int")
    return (
        rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
        .select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("seq"))
        .select(
            "conv_id", "turn", "copy", "seq", F.lit("delta").alias("op"), "role",
            F.substring("text", F.col("seq") * PIECE + 1, F.lit(PIECE)).alias("text"),
        )
    )


def check_conversation(df: DataFrame) -> DataFrame:
    """Conversation -7: two turns whose text is made of control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    return df.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digest(rendered: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the rendered text."""
    under = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
    back = rendered.select(
        "conv_id", formatted(F.col("segments")).alias("text"), loss.alias("loss")
    ).withColumn("turns", read_back(F.col("text")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )


def _escape_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s as (select conv_id, count(*)::bigint as n_turns,
  string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  sum(length('<|' || {_escape_sql("role")} || '|>' || chr(10) || {_escape_sql("text")} || '<|end|>' || chr(10)))::bigint as formatted_chars
  from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars,
  sha256(loss) as loss_sha256, formatted_chars from s
"""
