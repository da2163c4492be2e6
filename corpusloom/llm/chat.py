"""Chat formatting: event logs of conversations folded into final messages and rendered.

The log is event-sourced. Its rows are partitioned by conversation, ordered by sequence
number and folded:

* ``message`` sets the text of its turn (a null kind counts as ``message``),
* ``delta`` appends to it,
* ``edit`` replaces it,
* ``regenerate`` drops its turn and every later turn that was logged before, and starts
  the turn anew.

Everything is DataFrame functions. All steps share one shuffle on the conversation; a
formatted conversation is one string by nature, so the longest conversation bounds a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END, LINE = "<|turn|>", "<|end|>", "<|line|>"
#: Strings with a meaning to this template or to common chat models; never left whole inside a text.
CONTROLS = (TURN, END, LINE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _pattern(controls: Sequence[str], marks: str) -> str:
    first = "".join(sorted({re.escape(c[0]) for c in controls}))
    rest = "|".join(sorted({re.escape(c[1:]) for c in controls}, key=lambda r: (-len(r), r)))
    return rf"([{first}]){marks}(\\*)({rest})"


def escape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """One backslash more after the first character of every control string, so that none is left whole."""
    return F.regexp_replace(text, _pattern(controls, ""), r"$1\\$2$3")


def unescape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, _pattern(controls, r"\\"), "$1$2$3")


def _role_line(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _role_of(line: Column) -> Column:
    return unescape(F.replace(line, F.lit(LINE), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Null texts are empty, a null conversation id is a conversation of its own, a null turn
    comes before all others. Events of equal sequence number are ordered by their other
    columns, so repeated rows are folded the same way each time. A turn takes the last role
    that is not null (none: empty). An empty log gives no rows. Other columns are ignored.
    """
    kind = F.coalesce("kind", F.lit("message"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    log = events.select("conv_id", "seq", turn.alias("turn"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # newest first, so that what came later is a frame of preceding rows
    newest = Window.partitionBy("conv_id").orderBy(*(F.col(c).desc_nulls_last() for c in ("seq", "turn", "kind", "role", "text")))
    later_cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    live = (
        log.select("*", F.row_number().over(newest).alias("age"), later_cut.alias("cut"))
        .where(F.col("cut").isNull() | (F.col("cut") > F.col("turn")))
    )
    turns = live.groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("kind") != "delta", F.col("age"))).alias("start"),
        F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("at"), "text"))).alias("parts"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("age"))).alias("role"),
    )
    kept = F.filter("parts", lambda p: F.col("start").isNull() | (p["at"] >= -F.col("start")))
    return turns.select(
        "conv_id", F.when(F.col("turn") != -(1 << 62), F.col("turn")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    A turn is ``<|turn|>role\\n text <|end|>\\n``, role and text escaped. ``loss_spans`` are
    (start, length) in code points of the formatted string, one per turn of a trained role
    and around its escaped text alone.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    piece = messages.select(
        "conv_id", "turn", F.col("role").isin(*trained_roles).alias("trained"),
        F.concat(F.lit(TURN), _role_line(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    ).select("*", F.concat("head", "body", F.lit(f"{END}\n")).alias("piece"))
    before = F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = piece.select(
        "conv_id", F.row_number().over(order).alias("n"), "piece",
        F.when(F.col("trained"), F.struct((before + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("pieces"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_log(events: DataFrame, trained_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """:func:`fold_events`, then :func:`render`."""
    return render(fold_events(events), trained_roles)


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, as an array."""
    pieces = F.split(formatted, re.escape(TURN))
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        rest = F.char_length(head) + 2
        body = F.substring(piece, rest, F.char_length(piece) - rest + 1 - (len(END) + 1))
        return F.struct(_role_of(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: one ``message`` event per row, in the order of turns.

    Rows that share a turn number stay turns of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    at = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", at.alias("seq"), at.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """Formats conversations and reads the digests of turns and loss back from the formatted strings."""
    read = format_log(conversation_events(conversations)).select(
        "conv_id", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
