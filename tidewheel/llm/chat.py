"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

``reconstruct`` folds an event log into final messages; ``render`` writes each
conversation as one string with a loss mask; ``read_back`` parses that string.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles
and texts every ``<`` + n backslashes + ``|`` gets one more backslash, so no
control string can occur in them, and taking one away restores the text.  In
roles a backslash and a newline are written ``\\\\`` and ``\\n`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages.

    ``events``: conv_id, seq, message (its place in the conversation), kind,
    role, text.  Kinds: ``message`` and ``edit`` set the whole text,
    ``delta`` appends to it, ``regenerate`` empties it (deltas follow) and
    drops every later message begun before it, ``delete`` drops the message.

    Events are folded in the order of ``seq``; of equal ``seq`` in that of kind,
    role and text.  A null text is empty, a null role is empty, an unknown kind is
    ignored.  A ``regenerate`` wipes out all that was said in later messages up to
    its ``seq``; what comes after begins them anew, whatever happens to the
    regenerated message itself later.  A ``delta`` begins a message that isn't there.
    A message's role is that of its last ``message``/``edit``/``regenerate``, or
    of its first ``delta`` if there is none since it was dropped.
    Extra columns are dropped; an empty log gives no messages.

    One shuffle by conversation, which windows and the aggregation share; folding
    is done by (conversation, message) within it, so the text of one message is
    the most that a group gathers.
    """
    e = events.select(
        F.col("conv_id"), F.col("message").cast("long").alias("message"),
        F.struct(F.col("seq").cast("long").alias("seq"), F.col("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("ord"),
    ).where(F.col("kind").isin("message", "edit", "delta", "regenerate", "delete"))
    kind = F.col("ord.kind")
    # a regeneration drops what was said in later messages before it
    e = e.withColumn("place", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("message")))
    earlier = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("again", F.max(F.when(kind == "regenerate", F.col("ord.seq"))).over(earlier))
    e = e.where(F.col("again").isNull() | (F.col("ord.seq") > F.col("again")))
    by_message = Window.partitionBy("conv_id", "message")
    e = e.withColumn("base", F.max(F.when(kind != "delta", F.col("ord"))).over(by_message))
    e = e.where((F.col("base").isNull() | (F.col("ord") >= F.col("base"))) & (kind != "delete"))
    deltas = F.transform(F.array_sort(F.collect_list(F.when(kind == "delta", F.col("ord")))), lambda x: x["text"])
    whole = F.max(F.when(kind.isin("message", "edit"), F.col("ord.text")))
    folded = e.groupBy("conv_id", "message").agg(F.min_by(F.col("ord.role"), "ord").alias("role"), F.concat(F.coalesce(whole, F.lit("")), F.array_join(deltas, "")).alias("text"))
    return folded.select("conv_id", F.col("message").alias("turn"), "role", "text")


def as_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of ``message`` events, each a message of its own.

    ``seq`` and ``message`` number a conversation's rows by turn (null first),
    role and text, so rows of equal or null turn stay apart.
    """
    r = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    r = r.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    return r.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return _escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(_unescape(role), r"\\\\")  # on two backslashes
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted`` and ``loss_mask``.

    ``messages``: conv_id, turn, role, text; null role and text are empty, rows
    of equal turn are ordered by role and text (repeated rows stay), a null turn
    comes first and a null conversation is one of its own.  ``loss_mask`` holds
    (start, length), in code points of ``formatted``, of each assistant text;
    markers, roles and other texts are outside it.  An empty table gives no row.

    One shuffle by conversation; a window for the offsets and the aggregation
    share it.  A conversation's output is one string, which is gathered in one
    task by nature; nothing else is.
    """
    m = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    m = m.withColumn("head", head).withColumn("body", _escape(F.col("text")))
    piece = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("end", F.sum(piece.cast("long")).over(before))
    m = m.select("conv_id", F.struct("end", "role", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("body").cast("long").alias("n")).alias("x"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("xs", lambda x: x["role"] == "assistant"),
            lambda x: F.struct((x["end"] - len(END) - x["n"]).alias("start"), x["n"].alias("length")),
        ).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` (conv_id, formatted): adds ``turns``, array of (role, text), unescaped, in order.

    Texts hold no control string, so splitting at them is exact.  A null or
    empty string has no turns.  Narrow: no shuffle.
    """
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(_role_in(role).alias("role"), _unescape(text).alias("text"))

    return formatted.withColumn("turns", F.coalesce(F.transform(pieces, turn), F.array().cast("array<struct<role:string,text:string>>")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text that the loss mask covers, spans joined with nothing between."""
    return F.array_join(F.transform(mask, lambda s: _unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of a rendered table, taken from its output alone."""
    r = read_back(rendered)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )
