"""Example configuration of the general operators: cues, headings and terms of job postings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.extract import Cues

# Words around a duration that make it a demand for experience, a wish, a study or a firm's age.
EXPERIENCE = Cues(
    asks=r"\b(?:experience|exp|requires?|required|minimum|at least)\b",
    wishes=r"\b(?:preferred|ideally|desirable|nice.to.have|a plus|bonus)\b",
    follows=r"(?:degree|bachelor|master|program|course|university|college)\b",
    precedes="company|business|founded|established|operating|serving|history|industry leader",
    unless=r"(?:of\s+)?(?:experience|exp)\b",
)
#: Every duration of a contract or a demand, with how long it runs.
TERMS_OF_CONTRACT = Cues(asks=r"\b(?:contract|length|probation|holding|required|evidence|experience)\b", wishes=r"\b(?:welcome|ideally)\b", follows=r"(?:ago|old)\b")

# What the heading of one role looks like, and what begins the part for all.
_ROLE = r"(?i)\b(?:developer|engineer|designer|analyst|manager|recruiter|accountant|specialist|writer|executive|intern)\b"
_LABEL = r"(?i)^(?:role|position|job title)\s*:\s*(.+)$"
_DEMAND = r"(?i)\b(?:required|requirements|experience|years?|must|seeking|hiring|looking|welcome)\b|\. |[:;]"
_BULLET = r"^\s*(?:[-*•]\s+|\d+[.)]\s+)"
_FOR_ALL = r"(?i)^\s*(?:for all (?:roles|positions)|common requirements|how to apply)\s*:"


def role_heading(line: Column) -> Column:
    """The role that a line announces, by label or as a short line of its own; else null."""
    bare = F.trim(F.regexp_replace(line, _BULLET, ""))
    label = F.regexp_extract(bare, _LABEL, 1)
    short = bare.rlike(_ROLE) & ~bare.rlike(_DEMAND) & (F.size(F.split(bare, r"\s+")) <= 10)
    title = F.regexp_replace(F.when(label != "", F.trim(label)).when(short, bare), r"^[*: ]+|[*: ]+$", "")
    return F.when(F.length(title).between(3, 120), title)


def for_all(line: Column) -> Column:
    """Whether a line begins the part that belongs to every role."""
    return line.rlike(_FOR_ALL)


#: Lines of a vacancy that open a part of it.
PARTS = ("benefits", "required", "our promise", "contract length")


def part_heading(line: Column) -> Column:
    """The label of a line that opens a part of a vacancy; else null."""
    label = F.lower(F.regexp_extract(line, rf"(?i)^\W*({'|'.join(PARTS)})\s*:", 1))
    return F.when(label != "", label)
