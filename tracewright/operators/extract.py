"""Reasoning, summaries and traces out of records whose fields are a text, a list or null: arrays, one element for each text to segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.python import nfkc
from ..functions.text import TRACE_BREAK, blank_to_null, first_think_or_all, normalised, strip, stripped_bodies

# Fields that may hold summaries, by priority.
SUMMARY_FIELDS = ("summary_answer_driven", "answer_summaries", "summary", "summaries", "summary_text", "summary_en", "summary_zh")


def none() -> Column:
    return F.array().cast("array<string>")


def folded(c: Column) -> Column:
    """Normalised, with compatibility folding. For whole columns; within arrays the folding must come before."""
    return normalised(nfkc(F.regexp_replace(c, "\r", "\n")))


def _not_blank(a: Column) -> Column:
    return F.filter(a, lambda x: F.coalesce(strip(x), F.lit("")) != "")


def reasonings(generations: Column, solution: Column) -> Column:
    """Of each generation its first think body, else all of it, normalised; without any, the solution. Compatibility folding is left to segmentation."""
    found = F.transform(F.coalesce(generations, none()), lambda g: first_think_or_all(F.coalesce(g, F.lit(""))))
    found = F.transform(_not_blank(found), normalised)
    other = blank_to_null(solution)
    return F.when(F.size(found) > 0, found).when(other.isNotNull(), F.array(normalised(other))).otherwise(none())


def preferred(summary: Column, answer_summary: Column, traces: Column, solution: Column, prefer: str = "summary") -> Column:
    """Array of struct text, source from the first field that isn't blank as it stands: summaries, traces, solution; traces or the solution come first if
    preferred. A field that is blank once normalised gives nothing, and no other stands in."""
    one = lambda c: F.when(blank_to_null(c).isNotNull(), F.array(c)).otherwise(none())
    fields = {"summary_trace_augmented": one(summary), "summary_answer_driven": one(answer_summary), "traces_natural": F.coalesce(traces, none()), "solution": one(solution)}
    order = {
        "summary": ("summary_trace_augmented", "summary_answer_driven", "traces_natural", "solution"),
        "traces": ("traces_natural", "summary_trace_augmented", "summary_answer_driven", "solution"),
        "solution": ("solution", "summary_trace_augmented", "summary_answer_driven", "traces_natural"),
    }[prefer]

    def of(name: str) -> Column:
        texts = F.filter(F.transform(fields[name], lambda x: normalised(first_think_or_all(F.coalesce(x, F.lit("None"))))), lambda x: x != "")
        return F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(name).alias("source")))

    out = F.when(F.size(fields[order[0]]) > 0, of(order[0]))
    for name in order[1:]:
        out = out.when(F.size(fields[name]) > 0, of(name))
    return out.otherwise(F.array().cast("array<struct<text:string,source:string>>"))


def as_list(text: Column, items: Column | None = None) -> Column:
    """A field that is a list, or one text, as a list of normalised texts that aren't blank."""
    one = F.when(text.isNotNull(), F.array(text)).otherwise(none())
    return F.filter(F.transform(one if items is None else F.coalesce(items, one), lambda x: normalised(F.coalesce(x, F.lit("None")))), lambda x: x != "")


def summaries(fields: list[Column]) -> Column:
    """The first field, a list from as_list, that has anything."""
    out = F.when(F.lit(False), none())
    for c in fields:
        out = out.when(F.size(c) > 0, c)
    return out.otherwise(none())


def traces(generations: Column, solution: Column) -> Column:
    """Distinct think bodies of all generations, then of the solution, in order of first occurrence."""
    found = F.flatten(F.transform(F.coalesce(generations, none()), lambda g: stripped_bodies(F.coalesce(g, F.lit("")))))
    return F.array_distinct(F.concat(found, stripped_bodies(F.coalesce(solution, F.lit("")))))


def joined_traces(found: Column) -> Column:
    return F.array_join(found, TRACE_BREAK)


def finish_reason(reasons: Column, index: Column) -> Column:
    """Null beyond the list."""
    return F.get(reasons, index)
