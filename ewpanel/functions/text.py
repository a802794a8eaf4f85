"""Text and document expressions: terms, themes, locations, prompts and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_count(text: Column, terms: list[str]) -> Column:
    """Word-bounded, case-insensitive matches of any of the terms."""
    pattern = "(?i)\\b(?:" + "|".join(re.escape(t) for t in terms) + ")\\b"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs, also inside words."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(re.escape(t) for t in terms))


def first_themes(themes: Column, most: int = 10) -> Column:
    """Of a ;-list the first non-empty entries, then distinct and sorted."""
    return F.array_sort(F.array_distinct(F.slice(F.filter(F.split(themes, ";"), lambda x: x != ""), 1, most)))


def location_codes(locations: Column) -> Column:
    """Distinct third part of each #-separated location of a ;-list that has at least four parts."""
    parts = F.transform(F.split(locations, ";"), lambda x: F.split(x, "#"))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.size(p) >= 4), lambda p: p[2]))


def first_number(vector: Column) -> Column:
    """First number of a comma list, null if it is none."""
    return F.split(vector, ",")[0].try_cast("double")


def any_marker(themes: Column, markers: list[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | themes.contains(m)
    return F.coalesce(hit, F.lit(False))


def pairs_of(array: Column) -> Column:
    """All (a, b) with a before b in the array."""
    return F.flatten(F.transform(array, lambda x, i: F.transform(F.slice(array, i + 2, F.size(array)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def answer_probability(answer: Column) -> Column:
    """Probability in an answer: from the JSON between the first { and the last }, else from a line PROBABILITY: x."""
    json = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    from_json = F.from_json(json, "probability double")["probability"]
    line = F.regexp_extract(answer, r"(?i)PROBABILITY:\s*([0-9]*\.?[0-9]+)", 1)
    return F.coalesce(from_json, F.when(line != "", line.cast("double")))


def trend(delta: Column, edge: float = 2.0) -> Column:
    return F.when(delta > edge, "rising").when(delta < -edge, "falling").otherwise("flat")


def cell_context(place: Column, issue: Column, c30: Column, p30: Column, c90: Column, p90: Column, c365: Column, since: Column) -> Column:
    """A cell's situation in a few lines."""
    return F.format_string(
        "Cell in %s, issued %s.\nLast 30 days: %d events (%d in the 30 days before, %s, change %+d).\nLast 90 days: %d (%d before).\nLast 365 days: %d.\nDays since the last event: %d.",
        place, issue.cast("string"), c30, p30, trend(c30 - p30), c30 - p30, c90, p90, c365, since)


def country_context(place: Column, share: Column, change: Column, tone: Column) -> Column:
    """A country's situation in one line, changes with their sign."""
    return F.format_string("%s: conflict share %.2f (%+.2f), tone %+.1f", place, share, change, tone)


#: What each prompt style asks for, before the situation.
STYLES = {
    "plain": "Estimate how likely escalation is. Answer with PROBABILITY: and a number between 0 and 1.",
    "stepwise": "Name two signs for and two against escalation, then answer with PROBABILITY: and a number between 0 and 1.",
    "json": "Answer only with JSON that has the keys reasoning and probability.",
}


def prompt(style: str, context: Column, analogs: Column | None = None) -> Column:
    """Instruction, situation and, if given, an array of lines on similar past situations."""
    parts = [F.lit(STYLES[style]), F.concat(F.lit("Situation: "), context)]
    if analogs is not None:
        parts.append(F.when(F.size(analogs) > 0, F.concat(F.lit("Similar situations:\n"), F.array_join(analogs, "\n"))))
    return F.concat_ws("\n\n", *parts)


def analog_line(number: Column, name: Column, similarity: Column, happened: Column) -> Column:
    return F.format_string("%d. %s (similarity %.2f): %s", number, name, similarity, F.when(happened == 1, "escalated").otherwise("did not escalate"))
