"""Retrieval level of a question, by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import strip

# The patterns and words that decide a question's level.
DOCUMENT = (
    r"\bsummariz",
    r"\bsummary\b",
    r"\boverview\b",
    r"\boverall\b",
    r"\bgive me a (brief|short|quick|full)?\s*(summary|overview|recap)",
    r"\bwhat was discussed\b",
    r"\bwhat (were|are) the (main|key|primary|major) (points|topics|themes|issues)",
    r"\bwhat happened\b",
    r"\brecap\b",
    r"\bhigh.level\b",
    r"\bmain points?\b",
    r"\bkey (points?|takeaways?|highlights?)\b",
    "要約",
    "まとめ",
    "概要",
    "全体",
)
SEGMENT = (
    r"\bwho said\b",
    r"\bwho mentioned\b",
    r"\bwhen did\b",
    r"\bdid .{1,30} say\b",
    r"\bwhat did .{1,30} say\b",
    r"\b(at what|which) time\b",
    r"\btimestamp\b",
    r"\bspeaker\b",
    r"\bwhich speaker\b",
    r"\bwho spoke\b",
    r"\bwho talked about\b",
    r"\bmentioned by\b",
    r"\bsaid by\b",
    r"\baccording to\b",
    "言った",
    "話した",
    "誰が",
    "いつ",
)
SUMMARY = (
    "summarize", "summary", "summarise", "要約", "まとめ", "overview", "key points", "main points", "takeaways", "what was discussed",
    "what happened", "recap", "meeting notes", "minutes", "action items", "全体", "概要",
)
LEVELS = ("document", "segment", "chunk")


def detect_intent(question: Column) -> Column:
    q = strip(question)
    hit = lambda patterns: q.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    return F.when(hit(DOCUMENT), "document").when(hit(SEGMENT), "segment").otherwise("chunk")


def is_summary(question: Column) -> Column:
    q = F.lower(strip(question))
    return F.array_contains(F.array(*[F.contains(q, F.lit(w)) for w in SUMMARY]), True)


def parse_level(answer: Column) -> Column:
    """The level that a model's answer ends with, else chunk."""
    last = F.lower(F.element_at(F.split(strip(answer), r"\s+"), -1))
    return F.when(last.isin(*LEVELS), last).otherwise("chunk")


def route(method: Column, job_id: Column) -> Column:
    return F.when((method == "pageindex") & job_id.isNotNull(), "pageindex").otherwise("vector")
