"""Chat formatting by event-sourced reconstruction, in DataFrame operations alone.

A log holds events (conv_id, seq, turn, kind, role, text):

    message     sets a turn's role and text
    delta       appends text to a turn (a streamed piece); its role counts if the turn has none yet
    edit        replaces a turn's text
    regenerate  empties a turn's text and drops all later turns, as of that event

Events of a conversation are ordered by (seq, kind, role, text), nulls first. Events of a turn up to the last regenerate of an
earlier turn are void; a turn with none left is dropped. Of the others, a turn's text is that of its last message, edit or
regenerate (empty) with the deltas after it appended, and its role that of its last message that has one, else of its first
delta that has one. Null text counts as empty, a null role as the empty role; an unknown or null kind is ignored. Conversations
are told apart by conv_id, null being one of them; a null turn comes before all others. Repeated events count as often as they
stand. An empty log gives no rows. Other columns are ignored. A conversation is one string when rendered, so it may hold 2 GB
at most; its events meet in one task, which their order asks for.

Rendering: each turn becomes `<|im_start|>` role `\\n` text `<|im_end|>\\n`. In roles and texts `&` becomes `&amp;`, `<` becomes
`&lt;`, `[` becomes `&#91;` and a role's `\\n` becomes `&#10;`, so no control string of this or another template is left, and
reading back undoes it. The loss mask covers the text of each assistant turn and is given as spans of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The marks of the template.
START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """Final turns (conv_id, turn, seq, role, text) of a log; seq: of the turn's first event that is not void."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    clean = events.select("conv_id", "seq", "turn", F.lower("kind").alias("kind"), text("role"), text("text")).where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    event = F.struct("seq", "kind", "role", "text")
    # One exchange: windows and groups below are all by conversation.
    by_turn = clean.repartition("conv_id").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("all"), F.max(F.when(F.col("kind") == "regenerate", event)).alias("regenerated"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    void = by_turn.withColumn("void", F.max("regenerated").over(earlier))
    live = void.select("conv_id", "turn", F.when(F.col("void").isNull(), F.col("all")).otherwise(F.filter("all", lambda e: e > F.col("void"))).alias("live")).where(F.size("live") > 0)
    bases = live.withColumn("base", F.get(F.reverse(F.filter("live", lambda e: e["kind"] != "delta")), F.lit(0)))
    appended = F.transform(F.filter("live", lambda e: (e["kind"] == "delta") & (F.col("base").isNull() | (e > F.col("base")))), lambda e: e["text"])
    start = F.when(F.col("base.kind").isin("message", "edit"), F.col("base.text")).otherwise(F.lit(""))
    roles = lambda kind: F.transform(F.filter("live", lambda e: (e["kind"] == kind) & (e["role"] != "")), lambda e: e["role"])
    role = F.coalesce(F.get(F.reverse(roles("message")), F.lit(0)), F.get(roles("delta"), F.lit(0)), F.lit(""))
    return bases.select("conv_id", "turn", F.get("live", F.lit(0))["seq"].alias("seq"), role.alias("role"), F.concat(start, F.array_join(appended, "")).alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) of turns (conv_id, turn, role, text, and tie-breaking seq).

    spans has for each turn: at, size (the turn in formatted), loss_at, loss_size (its part under the loss mask), in code points.
    """
    body = turns.select("conv_id", "turn", "seq", F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")).alias("head"), F.col("role"), escape(F.col("text")).alias("text"))
    body = body.withColumn("piece", F.concat(F.lit(START), "head", F.lit(MIDDLE), "text", F.lit(STOP)))
    w = Window.partitionBy("conv_id").orderBy("turn", "seq", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("piece").cast("long")
    body = body.withColumn("n", F.row_number().over(w)).withColumn("at", F.sum(size).over(w) - size)
    loss = F.when(F.col("role") == ASSISTANT, F.length("text")).otherwise(F.lit(0)).cast("long")
    span = F.struct("at", size.alias("size"), (F.col("at") + len(START) + F.length("head") + len(MIDDLE)).alias("loss_at"), loss.alias("loss_size"))
    whole = body.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span")))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.transform("parts", lambda p: p["span"]).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From render()'s output alone: conv_id, turns (array of role, text), loss_texts (array of texts under the mask), formatted_chars."""
    pieces = F.expr("slice(split(formatted, '<[|]im_start[|]>', -1), 2, 2147483647)")
    body = lambda p: F.substring_index(p, STOP, 1)
    turn = lambda p: F.struct(unescape(F.substring_index(p, MIDDLE, 1)).alias("role"), unescape(body(p).substr(F.length(F.substring_index(p, MIDDLE, 1)) + 2, F.length(p))).alias("text"))
    # A span's loss part lies inside its turn's piece, so each piece is cut by itself.
    masked = F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("spans").alias("s")), lambda x: x["s"]["loss_size"] > 0)
    loss = F.transform(masked, lambda x: unescape(x["p"].substr((x["s"]["loss_at"] - x["s"]["at"] - len(START) + 1).cast("int"), x["s"]["loss_size"].cast("int"))))
    return formatted.withColumn("pieces", pieces).select("conv_id", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(turns: DataFrame) -> DataFrame:
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of events that leads to rows of conversations (conv_id, turn, role, text), with the ways a chat takes.

    A turn of the assistant is a message with a draft, a regenerate, and the text streamed in three deltas; any other turn is
    a message with a draft, an edit to the first third of the text, and the rest in two deltas. Rows that share a turn stay
    turns of their own, ordered by role and text.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    third = F.ceil(F.length("text") / 3).cast("int")
    rows = conversations.select("conv_id", F.row_number().over(w).cast("long").alias("n"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("third", third)
    piece = lambda k: F.substring(F.col("text"), F.col("third") * k + 1, F.col("third"))
    event = lambda k, kind, text: F.struct((F.col("n") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = event(0, "message", F.lit("draft"))
    streamed = F.array(draft, event(1, "regenerate", F.lit("")), *(event(2 + k, "delta", piece(k)) for k in range(3)))
    edited = F.array(draft, event(1, "edit", piece(0)), *(event(1 + k, "delta", piece(k)) for k in (1, 2)))
    return rows.select("conv_id", "n", "role", F.explode(F.when(F.col("role") == ASSISTANT, streamed).otherwise(edited)).alias("e")).select("conv_id", "e.seq", F.col("n").alias("turn"), "e.kind", "role", "e.text")


def op7_chat_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(control).alias("text"))
    return digest(read_back(render(fold(as_events(rows.unionByName(extra))))))
