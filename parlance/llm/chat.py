"""Chat transcripts from event logs: events are folded into final messages, which a template renders; all in DataFrame functions.

An event (conversation, message, sequence, kind, role, text) is one of
- open: the message begins, with its role; - delta: text is added at its end;
- edit: text replaces what it said; - regenerate: what it said goes, deltas follow.
An edit or a regeneration also drops every message that was opened after the message and before the event: the conversation goes
on from there. A message that such an event dropped stays dropped, and its own edits drop what they would have dropped.

Events are dealt by conversation and message (and summed up before they are sent), so that a conversation with very many events is
spread; only final messages meet by conversation, sorted by sequence, because a conversation becomes one text (one cell, below 2 GB).

Control strings inside roles and texts get a backslash in front, and reading takes one away. Control strings don't overlap one another
and stand between spaces in the template, so that this is undone exactly, also where a text has backslashes of its own.

Defined results: a null text is empty, and so is a null role; an event delivered twice counts once; of several resets with one
sequence the greatest text wins, and deltas with a reset's sequence count as before it; a message without an open event begins with its first
event and has an empty role; messages that open at once go by their keys, and one that opens with a reset's sequence counts as before it; nulls among conversations are one conversation, nulls in
a sequence come first; other columns aren't read; an empty log gives no conversations.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("edit", "regenerate")


class Template(NamedTuple):
    """Marks of a turn: begin, the role's mark, a space, the text, a space, end; a role without a mark stands between two of its own."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: tuple[tuple[str, str], ...] = (("user", "[INST]"), ("assistant", "[/INST]"), ("system", "[SYS]"))
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> str:
        """A pattern for all control strings."""
        found = (self.begin, self.end, *(m for _, m in self.marks), *self.other)
        if any(re.search(r"[\s\\]", c) or not c for c in found) or any(a != b and a in b for a in found for b in found):
            raise ValueError("control strings have no white space or backslash and don't contain each other")
        if any(a.endswith(b[:k]) for a in found for b in found for k in range(1, len(b))):
            raise ValueError("control strings must not overlap")
        return "|".join(map(quoted, found))


def quoted(text: str) -> str:
    return re.sub(r"([^\w<>/])", r"\\\1", text)


def reconstruct(events: DataFrame, conversation: str = "conv_id", message: list[str] = ["message"], sequence: list[str] = ["seq"]) -> DataFrame:  # noqa: B006
    """(conversation, opened, message columns, role, text) of the messages that stay."""
    at, text = F.struct(*sequence), F.coalesce("text", F.lit(""))
    reset = F.col("kind").isin(*RESETS)
    log = events.select(conversation, *message, at.alias("at"), F.when(reset, F.struct(at.alias("at"), text.alias("text"))).alias("reset"), F.when(F.col("kind") == "open", F.struct(at.alias("at"), F.coalesce("role", F.lit("")).alias("role"))).alias("open"), text.alias("text"))
    parts = F.when(F.col("reset").isNull(), F.struct("at", "text"))
    found = log.groupBy(conversation, *message).agg(F.collect_set(parts).alias("parts"), F.max("reset").alias("reset"), F.min("open").alias("open"), F.min("at").alias("first"))
    later = F.filter(F.array_sort("parts"), lambda p: F.col("reset").isNull() | (p.at > F.col("reset.at")))
    final = F.concat(F.coalesce("reset.text", F.lit("")), F.array_join(F.transform(later, lambda p: p.text), ""))
    messages = found.select(conversation, *message, F.coalesce("open.at", "first").alias("opened"), F.col("reset.at").alias("reset_at"), F.coalesce("open.role", F.lit("")).alias("role"), final.alias("text"))
    before = Window.partitionBy(conversation).orderBy("opened", *message).rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("until", F.max("reset_at").over(before))
    return messages.where("until IS NULL OR until < opened").select(conversation, "opened", *message, "role", "text")


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({template.controls()})", r"\\$1")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"\\\\({template.controls()})", "$1")


def render(messages: DataFrame, template: Template = Template(), conversation: str = "conv_id", message: list[str] = ["message"]) -> DataFrame:  # noqa: B006
    """(conversation, n_turns, formatted, loss_spans) from messages (conversation, opened, message columns, role, text).

    loss_spans: where the texts of trained roles stand in `formatted`, as (start, length) in code points and (byte_start, byte_length) in UTF-8."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.concat(F.lit(f"{template.other[0]} "), escape(role, template), F.lit(f" {template.other[1]}"))
    for name, known in template.marks:
        mark = F.when(role == name, F.lit(known)).otherwise(mark)
    rows = messages.select(conversation, "opened", *message, F.concat(F.lit(template.begin), mark, F.lit(" ")).alias("head"), escape(text, template).alias("body"), role.isin(*template.trained).alias("trained"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(f" {template.end}")))
    before = Window.partitionBy(conversation).orderBy("opened", *message).rowsBetween(Window.unboundedPreceding, -1)
    place = lambda size: (F.coalesce(F.sum(size("piece").cast("bigint")).over(before), F.lit(0)) + size("head")).cast("bigint")
    span = F.struct(place(F.length).alias("start"), F.length("body").cast("bigint").alias("length"), place(F.octet_length).alias("byte_start"), F.octet_length("body").cast("bigint").alias("byte_length"))
    rows = rows.select(conversation, F.struct("opened", *message, "piece", F.when(F.col("trained"), span).alias("span")).alias("turn"))
    done = rows.groupBy(conversation).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.span.isNotNull()), lambda t: t.span)
    return done.select(conversation, F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), spans.alias("loss_spans"))


def turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    marks = "|".join(quoted(m) for _, m in template.marks)
    one = rf"(?s)^{quoted(template.begin)}(?:({marks})|{quoted(template.other[0])} (.*?) (?<!\\){quoted(template.other[1])}) (.*) $"

    def read(turn: Column) -> Column:
        mark = F.regexp_extract(turn, one, 1)
        role = unescape(F.regexp_extract(turn, one, 2), template)
        for name, known in template.marks:
            role = F.when(mark == known, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_extract(turn, one, 3), template).alias("text"))

    parts = F.split(formatted, rf"(?<!\\){quoted(template.end)}", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), read)


def loss_texts(raw: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask of a formatted conversation (its UTF-8 bytes), as they were before they were escaped."""
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s.byte_start + 1).cast("int"), s.byte_length.cast("int")), "UTF-8"), template))
