"""Chat formatting by prefix-target expansion.

Every turn of an assistant becomes an example of its own: all turns before it
are the context and only its text is trained on.  The examples of one
conversation share their contexts, so a row holds what its example adds: the
turns since the row before, the reply last, and the place where the row
starts in the conversation's formatted text.  The context of an example is the
texts of all rows before; ``whole_examples`` puts it in front of every target,
which grows with the square of a conversation's length.  Stored rows grow with
the input.

A formatted turn is ``### role``, a line feed, the escaped text, ``</turn>``
and a line feed.  In texts ``\\``, ``#`` and ``</`` get a backslash, and roles
are percent-encoded, so no text can show a control string, and removing the
backslashes gives every text back.

Conversations are ordered in blocks of turn numbers, so a long one is spread
over tasks; a block whose last turn is no reply ends in a row without target,
which is context for the rows that follow.  Built from DataFrame operations
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TURN_END = "### ", "</turn>\n"
BLOCK_BITS = 12                 # turn numbers of a block: 2 ** 12


def escaped(text: Column) -> Column:
    """Text in which no control string can occur; null counts as empty."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(F.coalesce(role, F.lit(""))), F.lit("\n"))


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         target: str = "assistant") -> DataFrame:
    """One row per example and per block's rest: id, block, example, start, text, loss_start, loss_end.

    ``text`` holds the turns since the row before, ``start`` is its place in the
    conversation's formatted text, and the code points ``loss_start`` to
    ``loss_end`` of ``text`` are the reply (both null in a row without target).
    Turns are ordered by number (null first), equal numbers by role and text,
    repeated rows stay.  A null text or role counts as empty; rows without id
    form one conversation; an empty table gives no rows; other columns are
    ignored.
    """
    body = escaped(F.col(text_col))
    rows = turns.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.shiftright(F.col(turn_col).cast("long"), BLOCK_BITS), F.lit(-1 << 62)).alias("block"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.concat(_head(F.col(role_col)), body, F.lit(TURN_END)).alias("formatted"),
        F.length(body).alias("chars"))
    block = ["key", "no_id", "block"]
    order = Window.partitionBy(*block).orderBy("turn", "role", "formatted")
    reply = F.col("role") == target
    placed = (rows.withColumn("place", F.row_number().over(order))
              .withColumn("example", F.coalesce(F.sum(reply.cast("long")).over(
                  order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))))
    last = F.element_at("list", -1)
    text = F.array_join(F.transform("list", lambda x: x["formatted"]), "")
    end = F.length("text") - len(TURN_END)
    made = (placed.groupBy(*block, "example")
            .agg(F.min("id").alias("id"),
                 F.sort_array(F.collect_list(F.struct("place", "formatted", "chars", reply.alias("reply")))).alias("list"))
            .select("id", *block, "example", text.alias("text"), last["reply"].alias("reply"),
                    last["chars"].alias("chars"))
            .select("id", *block, "example", "text", F.when(F.col("reply"), end - F.col("chars")).alias("loss_start"),
                    F.when(F.col("reply"), end).alias("loss_end")))
    # characters of the blocks before: one narrow row per block
    whole = (rows.groupBy(*block).agg(F.sum(F.length("formatted")).alias("all"))
             .withColumn("before", F.sum("all").over(Window.partitionBy("key", "no_id").orderBy("block")) - F.col("all"))
             .drop("all"))
    inside = Window.partitionBy(*block).orderBy("example")
    start = F.col("before") + F.sum(F.length("text")).over(inside) - F.length("text")
    return (made.join(whole, block).withColumn("start", start)
            .select(F.col("id").alias(id_col), "block", "example", "start", "text", "loss_start", "loss_end"))


def whole_examples(rows: DataFrame, *, id_col: str = "conv_id", rest: bool = False) -> DataFrame:
    """Every example written out: id, block, example, text (context and reply), loss_start, loss_end.

    With ``rest`` the turns after a conversation's last reply make one more
    example, without target.  A task holds one conversation and one example at a time.
    """
    before = Window.partitionBy(id_col).orderBy("block", "example").rowsBetween(Window.unboundedPreceding,
                                                                               Window.currentRow)
    kept = F.col("loss_start").isNotNull()
    if rest:
        after = F.lead(F.lit(True)).over(Window.partitionBy(id_col).orderBy("block", "example"))
        rows, kept = rows.withColumn("ends", after.isNull()), kept | F.col("ends")
    return (rows.withColumn("parts", F.collect_list("text").over(before)).where(kept)
            .withColumn("whole", F.array_join("parts", ""))
            .select(id_col, "block", "example", F.col("whole").alias("text"),
                    (F.col("start") + F.col("loss_start")).alias("loss_start"),
                    (F.col("start") + F.col("loss_end")).alias("loss_end")))


def read_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted text, unescaped."""
    parts = F.split(text, TURN_END)
    name = lambda x: F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), "\n", 1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.struct(
        F.url_decode(name(x)).alias("role"),
        unescaped(F.substr(x, F.length(name(x)) + len(HEAD) + 2)).alias("text")))


def read_loss(rows: DataFrame) -> Column:
    """Unescaped text under a row's loss mask, null without target."""
    return unescaped(F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def read_back(rows: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read from its formatted rows alone.

    Columns: id, n_turns, turns (``role \\n text \\n`` of every turn), loss (all
    text under the mask), formatted_chars: characters of all examples with
    their contexts; the turns after the last reply count as one more.  A
    conversation is one value here, so its texts must fit one string.
    """
    turns = read_turns(F.col("text"))
    one = rows.select(
        F.col(id_col).alias("id"), F.size(turns).cast("long").alias("n"), F.struct(
            "block", "example",
            F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
            .alias("turns"), F.coalesce(read_loss(rows), F.lit("")).alias("loss")).alias("part"),
        (F.col("start") + F.length("text")).alias("end"), F.col("loss_start").isNotNull().alias("reply"))
    listed = F.sort_array(F.collect_list("part"))
    joined = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    return (one.groupBy("id").agg(
                F.sum("n").alias("n_turns"), listed.alias("parts"),
                F.coalesce(F.sum(F.when(F.col("reply"), F.col("end"))), F.lit(0)).alias("examples"),
                F.max(F.struct("end", "reply")).alias("last"))
            .select(F.col("id").alias(id_col), "n_turns", joined("turns").alias("turns"), joined("loss").alias("loss"),
                    (F.col("examples") + F.when(F.col("last.reply"), 0).otherwise(F.col("last.end")))
                    .alias("formatted_chars")))


def expand_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """Prefix-target expansion: every example with its whole context, see ``whole_examples``."""
    made = format_conversations(turns, **columns)
    return whole_examples(made, id_col=columns.get("id_col", "conv_id"), rest=True)


def read_examples(examples: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """The columns of ``read_back``, read from whole examples alone.

    Turns come from the last example, which holds all of them; the loss is the
    targets in order, and every example counts with all its characters.
    """
    one = examples.select(
        F.col(id_col).alias("id"), F.struct("block", "example").alias("place"), "text",
        F.struct("block", "example", F.coalesce(read_loss(examples), F.lit("")).alias("loss")).alias("part"))
    turns = read_turns(F.col("last"))
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return (one.groupBy("id").agg(
                F.max_by("text", "place").alias("last"), F.sort_array(F.collect_list("part")).alias("parts"),
                F.sum(F.length("text")).cast("long").alias("formatted_chars"))
            .withColumn("all", turns)
            .select(F.col("id").alias(id_col), F.size("all").cast("long").alias("n_turns"),
                    F.array_join(F.transform("all", line), "").alias("turns"),
                    F.array_join(F.transform("parts", lambda x: x["loss"]), "").alias("loss"), "formatted_chars"))
