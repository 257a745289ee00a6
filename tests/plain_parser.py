"""Sections and roles of one text in plain Python: what the expressions are held against."""

from __future__ import annotations

import re
from datetime import date

from vellum.functions import patterns as R

def heading_of(line: str) -> list[str]:
    """Sections that a line is a heading of: 2 to 60 characters, no final . or , and a keyword in front."""
    own = line.strip()
    if not 2 <= len(own) <= 60 or own.endswith((".", ",")):
        return []
    bare = re.sub(r"^[-=_*#\s]+|[-=_*#\s]+$", "", own.lower().rstrip(":").strip())
    return [s for s, words in R.SECTION_KEYWORDS.items() if bare.startswith(words)]


def sections_of(text: str) -> dict[str, str]:
    """Sections found and their contents; without any heading the whole text is the summary.

    A section runs from its first heading to the next section's. Its heading line goes, unless it is all there is.
    """
    lines = text.split("\n")
    first: dict[str, int] = {}
    for k, line in enumerate(lines):
        for name in heading_of(line):
            first.setdefault(name, k)
    if not first:
        return {"summary": text}
    names = sorted(first, key=lambda s: (first[s], list(R.SECTION_KEYWORDS).index(s)))
    ends = [*(first[n] for n in names[1:]), len(lines)]
    bodies = {n: "\n".join(lines[first[n] : end]).strip() for n, end in zip(names, ends, strict=True)}
    return {n: body.partition("\n")[2].strip() if "\n" in body else body for n, body in bodies.items()}


_RANGE, _YEARS, _TIME, _MARK = (re.compile(p, re.I) for p in (R.DATE_RANGE, R.YEAR_RANGE, R.DURATION, R.BULLET))
_NAMES = {m: k + 1 for k, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
_HEADINGS = frozenset(k for words in R.SECTION_KEYWORDS.values() for k in words)


def month_number(said: str, as_of: date) -> int | None:
    """Months since year 0 of `Jan 2022`, `2022` (January) or a word for now; None if it is none of these."""
    parts = said.strip().lower().split()
    if parts in (["present"], ["current"], ["now"], ["ongoing"]):
        return as_of.year * 12 + as_of.month
    if len(parts) == 2 and parts[0][:3] in _NAMES and parts[1].isdigit():
        return int(parts[1]) * 12 + _NAMES[parts[0][:3]]
    return int(parts[0]) * 12 + 1 if len(parts) == 1 and re.fullmatch(r"\d{4}", parts[0]) else None


def span_of(line: str, as_of: date) -> tuple[str | None, int | None, list[str]]:
    """(period, months, warnings) of a line: a month range, else a year range, else a stated duration.

    `6 mos` is 72 months and `5 motors` 60, since only units that begin with `mon` count as months. A unit that touches
    its number is read like any other.
    """
    for pattern in (_RANGE, _YEARS):
        if m := pattern.search(line):
            ends = [month_number(m[k], as_of) for k in (1, 2)]
            bad = next((m[k + 1] for k in (0, 1) if ends[k] is None), None)
            return (m[0], None, [f"Unrecognised date: '{bad}'"]) if bad else (m[0], max(0, ends[1] - ends[0]), [])
    if m := _TIME.search(line):
        return m[0], int(m[1]) * (1 if m[2].lower().startswith("mon") else 12), []
    return None, None, []


def roles_of(text: str, as_of: date) -> tuple[list[dict], int, list[str]]:
    """(roles, total months, warnings) of an experience section.

    A line with a period, or followed by a line with one, opens a role; lines up to the next line with a period or the
    next heading describe it. Overlapping roles count twice. Without any role, year ranges anywhere in the text do.
    """
    lines = [x.strip() for x in text.split("\n")]
    told = [span_of(x, as_of) for x in lines]
    roles: list[dict] = []
    warnings: list[str] = []
    total = k = 0
    role = lambda period, months, said: {"title": "[REDACTED]", "duration_months": months or 0, "period": period or "", "description": said}
    while k < len(lines):
        if not lines[k]:
            k += 1
            continue
        period, months, said = told[k]
        warnings += said
        after = k + 1
        if period is None and after < len(lines):
            period, months, said = told[after]
            warnings += said
            after += period is not None
        if period is None:
            k += 1
            continue
        total += months or 0
        about = [lines[k]]
        while after < len(lines) and (not lines[after] or (told[after][0] is None and lines[after].lower().rstrip(":") not in _HEADINGS)):
            about += [lines[after]] if lines[after] else []
            after += 1
        clean = [c for c in (_MARK.sub("", x).strip() for x in about) if c]
        roles.append(role(period, months, " ".join(clean)[:500]))
        k = after
    if not roles:
        for m in _YEARS.finditer(text):
            months = max(0, month_number(m[2], as_of) - month_number(m[1], as_of))
            total += months
            roles.append(role(m[0], months, ""))
    return roles, total, warnings
