"""Chat formatting from event logs, in DataFrame operations only.

A log is dealt by conversation and ordered by sequence number. Folding it gives the final messages: a ``message`` or
``edit`` sets a message's text, a ``delta`` appends to it, a ``regenerate`` empties its message and takes back every
later one that was there by then. The final messages are rendered with turn marks; inside texts a backslash and the
start of any mark are escaped, so the marks can't be forged and the output reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import missing_as_null, rows_of

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of event that set a message's text anew.
SETS = ("message", "edit", "regenerate")


def escape(text: Column, newline: bool = False) -> Column:
    """Backslash to two; ``<|`` to ``<\\|``; in roles also a line feed to ``\\n``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if newline else out


def unescape(text: Column, newline: bool = False) -> Column:
    """The text that ``escape`` was given. A backslash always stands before what it escapes."""
    if not newline:
        return F.regexp_replace(text, r"\\([\\|])", "$1")
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def final_messages(log: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", message_col: str = "turn", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Fold an event log into messages: (conv, message, role, text), one row for each message that is left.

    Columns of the log that are missing count as null; a null or unknown kind is a message. Events of equal sequence
    number go by role and text. Null texts are empty. A message keeps the role that the last message, edit or regenerate
    event with a role gave it, whatever came before or after without one; else a delta's; else it is empty.
    """
    kind = F.lower(F.coalesce(missing_as_null(log, kind_col, "string"), F.lit("message")))
    seq = missing_as_null(log, seq_col, "long") if seq_col in log.columns else F.col(f"`{message_col}`")
    rows = rows_of(log, conv=conv_col, message=message_col, role=missing_as_null(log, role_col, "string"), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")), kind=kind, seq=seq)
    rows = rows.withColumn("kind", F.when(F.col("kind").isin("delta", *SETS), F.col("kind")).otherwise("message")).repartition("conv")
    own, earlier = Window.partitionBy("conv", "message"), Window.partitionBy("conv").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the last event that set the message; the last regeneration of a message before it
    rows = rows.withColumn("set_at", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(own))
    rows = rows.withColumn("redone", F.max(F.when(F.col("kind") == "regenerate", F.struct("seq", "message"))).over(earlier))
    # the role outlives an edit or regeneration without one: the last that a setting event gave, else the first of any
    setter = (F.col("kind") != "delta") & F.col("role").isNotNull()
    ranked = lambda c: F.when(c, F.struct("seq", "role"))
    rows = rows.withColumn("known", F.coalesce(F.max(ranked(setter)).over(own)["role"], F.min(ranked(F.col("role").isNotNull())).over(own)["role"], F.lit("")))
    alive = (F.col("set_at").isNull() | (F.col("seq") >= F.col("set_at")) | F.col("seq").isNull()) & (F.col("redone").isNull() | (F.col("redone.message") == F.col("message")) | (F.col("seq") > F.col("redone.seq")))
    event = F.struct("seq", (F.col("kind") == "delta").alias("later"), "role", "text")
    return rows.where(alive).groupBy("conv", "message").agg(F.array_sort(F.collect_list(event)).alias("events"), F.first("known").alias("role"))


def _rendered(messages: DataFrame) -> DataFrame:
    """(conv, formatted, spans): spans are (start, length) of each assistant text in code points of ``formatted``."""
    turn = F.struct("message", "role", "text")
    turns = messages.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape(t["role"], True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("own")))
    turns = turns.select("conv", parts.alias("parts"))
    tail = f"{END}\n"
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    lengths = F.transform("parts", lambda p: F.struct((F.length(p["head"])).alias("h"), F.length(p["body"]).alias("n"), p["own"].alias("own")))
    turns = turns.select("conv", formatted.alias("formatted"), lengths.alias("lengths"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        "lengths",
        zero,
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["n"] + F.lit(len(tail))).alias("at"),
            F.when(x["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["h"]).alias("start"), x["n"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return turns.select("conv", "formatted", walked["spans"].alias("spans"))


def format_chats(log: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """Render every conversation of an event log: ``conv_col``, ``formatted``, ``loss_spans``.

    ``loss_spans`` are the (start, length), in code points of ``formatted``, of the assistant's texts: the loss mask.
    A null conversation id is a conversation; a null role is empty; a null message number comes first; repeated rows are
    repeated turns when the log has no sequence numbers of its own. An empty log gives an empty result. Other columns are
    ignored. A conversation is one record, so it must fit a task; nothing else is gathered.
    """
    folded = final_messages(log, conv_col, **columns)
    stream = columns.get("kind_col", "kind") in log.columns
    if stream:
        joined = F.array_join(F.transform("events", lambda e: e["text"]), "")
        messages = folded.select("conv", "message", "role", joined.alias("text"))
    else:  # no deltas: every event is a turn of its own
        messages = folded.select("conv", "message", F.explode("events").alias("e")).select("conv", "message", F.coalesce("e.role", F.lit("")).alias("role"), "e.text")
    return _rendered(messages).select(F.col("conv").alias(conv_col), "formatted", F.col("spans").alias("loss_spans"))


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted output says, and nothing else: ``turns`` (role, text) and ``loss_text``, both unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p, i: i > 0)
    body = lambda p: F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END) - 1)
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1), True).alias("role"), unescape(body(p)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.select(conv_col, turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Figures and SHA-256 digests of ``read_back``, one row for each conversation."""
    back = read_back(chats, conv_col)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        sha(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
