"""Chat formatting by prefix-target expansion (operator 6), in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context, and
only its own text is trainable. The examples of one conversation are prefixes of
one another, so an example's row does not repeat its context: ``segment`` holds
the formatted turns since the example before, ``context_chars`` the length of
all that comes before the reply, and the example's full text is the segments of
its conversation up to its own, in order (``expanded`` makes it). So the output
grows with the conversation and not with its square, also for a conversation of
many thousand turns. Turns after the last reply form a last row without a loss.

The template marks turns as ``[INST]..[/INST]`` (user), ``<s>..</s>``
(assistant), ``<<SYS>>..<</SYS>>`` (system) and ``[ROLE=name]..[/ROLE]`` (any
other role, its name URL-encoded). A control string inside a text gets a
backslash after its first character, and one that already has backslashes there
gets one more, so unescaping gives back every text, and no text can end a turn.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; turns are in the order of (turn, role, text), a null
turn first, and repeated rows are repeated turns. An empty table gives no rows.
The digest of a conversation needs its turns in one row, as does a formatted
conversation for training; nothing else of a conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the opening and closing marks of the three named roles.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_CONTROL = r"(?:/?INST\]|/?s>|</?SYS>>|ROLE=|/ROLE\])"
ESCAPE = rf"([\[<])(\\*{_CONTROL})"
UNESCAPE = rf"([\[<])\\(\\*{_CONTROL})"
TURN_END = r"(?<=\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE="), F.url_encode(role), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit("[/ROLE]")
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per assistant turn (and one for turns after the last): (conv_id, example, segment, context_chars, loss_start, loss_chars, chars).

    ``loss_start`` is the place in ``segment`` of the trainable (escaped) text and
    ``loss_chars`` its length, 0 in a row without a reply; ``chars`` is the length of
    the whole example, context and all.
    """
    t = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == "assistant"
    t = t.withColumn("example", F.coalesce(F.sum(reply.cast("int")).over(order), F.lit(0)))
    body = escape(F.col("text"))
    opening, closing = _opening(F.col("role")), _closing(F.col("role"))
    t = t.select(
        "conv_id", "example", "turn", "role", "text", F.concat(opening, body, closing).alias("part"),
        F.when(reply, F.length(body)).alias("loss"), F.when(reply, F.length(closing)).alias("close"),
    )
    # turns of one example: at most one reply, and it is the last
    packed = t.groupBy("conv_id", "example").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "part"))), lambda x: x["part"]), "").alias("segment"),
        F.max("loss").alias("loss"),
        F.max("close").alias("close"),
    )
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment").cast("long")
    start = F.when(F.col("loss").isNotNull(), size - F.col("close") - F.col("loss")).otherwise(size)
    earlier = F.coalesce(F.sum(size).over(before), F.lit(0))
    return packed.select(
        "conv_id", F.col("example").cast("long").alias("example"), "segment", (earlier + start).alias("context_chars"),
        start.alias("loss_start"), F.coalesce("loss", F.lit(0)).cast("long").alias("loss_chars"), (earlier + size).alias("chars"),
    )


def whole_texts(examples: DataFrame) -> DataFrame:
    """Every row of the examples with ``text``, its whole text: the segments of its conversation up to its own."""
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    return examples.withColumn("text", F.array_join(F.collect_list("segment").over(before), ""))


def expanded(examples: DataFrame) -> DataFrame:
    """The full text of every example with a reply: (conv_id, example, text, loss_start, loss_chars).

    The text of a conversation with n replies is written n times by nature; filter the
    examples first, or train from the segments.
    """
    return whole_texts(examples).where("loss_start < length(segment)").select(
        "conv_id", "example", "text", F.col("context_chars").alias("loss_start"), "loss_chars"
    )


def parsed(segment: Column) -> Column:
    """The turns of a formatted segment, read back: array of (role, text)."""
    parts = F.filter(F.split(segment, TURN_END), lambda p: p != "")

    def turn(p: Column) -> Column:
        role, opened, closed = F.url_decode(F.regexp_extract(p, r"^\[ROLE=([^\]]*)\]", 1)), F.length(F.regexp_extract(p, r"^\[ROLE=[^\]]*\]", 0)), F.lit(len("[/ROLE]"))
        for name, (opening, closing) in MARKS.items():
            of_role = F.startswith(p, F.lit(opening))
            role = F.when(of_role, F.lit(name)).otherwise(role)
            opened = F.when(of_role, F.lit(len(opening))).otherwise(opened)
            closed = F.when(of_role, F.lit(len(closing))).otherwise(closed)
        text = unescape(F.substring(p, opened + 1, F.length(p) - opened - closed))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(parts, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation: its loss and size, read back from the whole text of every example, and its turns, from the segments."""
    turns = parsed(F.col("segment"))
    read = whole_texts(examples).select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"),
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("turns"),
        unescape(F.substring(F.col("text"), F.col("context_chars").cast("int") + 1, F.col("loss_chars").cast("int"))).alias("loss"),
    ).select("conv_id", "chars", F.size("turns").cast("long").alias("n"), F.struct("example", F.array_join("turns", "").alias("turns"), "loss").alias("x"))
    joined = lambda name: F.array_join(F.transform("xs", lambda x: x[name]), "")
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("x")).alias("xs"))
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("turns").alias("turns"), joined("loss").alias("loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
