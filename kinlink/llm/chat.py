"""Chat formatting with prefix-target expansion (operator 2), DataFrame functions only.

A conversation is formatted once: for each turn, START, its role, a newline,
its text, END and a newline.  Every assistant turn is an example: its text is
the formatted conversation up to and with that reply, and its loss mask covers
that reply alone, so an example is a prefix length and a span.  ``expand``
makes the examples' full texts; the compact form holds them without the
quadratic repetition of contexts.

Control strings inside roles and texts are escaped reversibly: a backslash
becomes ``\\s``, the bar of ``<|`` becomes ``\\p``, a newline of a role ``\\n``;
so every backslash of a formatted text begins a two-character code.

Defined results: null role or text is empty; a null turn sorts first, ties go
by role, then text, and all rows stay; null conv_id is a conversation of its
own; a conversation without assistant has no examples; further columns aren't
read.  A conversation is one row: its turns are gathered, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    for code, plain in (("\\n", "\n"), ("\\p", "|"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, and examples: array of structs of the
    example's number, loss_start (characters before the reply) and loss_end
    (characters of the example without its closing END)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumns({"a": F.length("head").cast("long"), "b": F.length("body").cast("long")})
    # Where a turn begins: the lengths before it, along the conversation.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("a") + F.col("b") + len(END) + 1
    rows = rows.withColumn("at", F.sum(size).over(order) - size)
    part = F.struct("turn", "role", "text", "at", "head", "body", "a", "b")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    replies = F.filter("parts", lambda p: p["role"] == TARGET)
    examples = F.transform(replies, lambda p, i: F.struct(i.alias("example"), (p["at"] + p["a"]).alias("loss_start"), (p["at"] + p["a"] + p["b"]).alias("loss_end")))
    return whole.select("conv_id", formatted.alias("formatted"), examples.alias("examples"))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, text (all turns up to and
    with the reply), loss_start and loss_end: the span that is trained on."""
    rows = conversations.select("conv_id", "formatted", F.explode("examples").alias("e"))
    text = F.substring(F.col("formatted"), F.lit(1), (F.col("e.loss_end") + len(END) + 1).cast("int"))
    return rows.select("conv_id", F.col("e.example").alias("example"), text.alias("text"), F.col("e.loss_start").alias("loss_start"), F.col("e.loss_end").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "\\Q" + START + "\\E"), lambda b: b != "")

    def turn(b: Column) -> Column:
        at = F.instr(b, "\n")
        body = F.substring(b, at + 1, F.length(b) - at - len(END) - 1)
        return F.struct(unescape(F.substring(b, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation the contract's counts and digests, read back from the
    formatted text and from the expanded examples."""
    turns = conversations.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    reply = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    replies = expand(conversations).select("conv_id", "example", unescape(reply).alias("reply"), F.length("text").cast("long").alias("chars"))
    learned = replies.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("r"), F.sum("chars").alias("expanded_chars"))
    loss = learned.select(F.col("conv_id").alias("c"), F.array_join(F.col("r.reply"), "").alias("loss"), F.size("r").cast("long").alias("n_examples"), "expanded_chars")
    joined = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    text = F.coalesce("loss", F.lit(""))
    zero = F.lit(0).cast("long")
    return joined.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", F.coalesce("n_examples", zero).alias("n_examples"), F.coalesce("expanded_chars", zero).alias("expanded_chars"))


#: DuckDB SQL for the digests.  formatted_chars and expanded_chars follow the
#: template: 12 + role + 1 + text + 11 characters a turn, escapes one more each.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (
  SELECT *, 24 + length(role) + length(text)
    + (length(role || text) - length(replace(role || text, '\', '')))
    + (length(role) - length(replace(role, '<|', '|'))) + (length(text) - length(replace(text, '<|', '|')))
    + (length(role) - length(replace(role, chr(10), ''))) AS chars FROM t),
c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant')::BIGINT AS n_examples,
  coalesce(sum(prefix) FILTER (role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM c GROUP BY conv_id
"""
