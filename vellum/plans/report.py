"""Text reports, rendered on the driver from a bounded number of rows."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most candidates that a report spells out; the tables hold all.
ROWS = 1000


def _head(title: str, width: int) -> list[str]:
    return ["=" * width, title.center(width).rstrip(), "=" * width]


def summary_report(explanations: DataFrame, width: int = 78, rows: int = ROWS) -> str:
    """Narrative of the first `rows` candidates by rank."""
    lines = _head("CANDIDATE SCREENING SUMMARY", width)
    for x in explanations.orderBy(F.coalesce("rank", F.lit(9999))).limit(rows).collect():
        e = x["explanation"]
        lines += ["", f"#{x['rank']}  {x['candidate_id']}  {x['verdict']}  ({x['final_score']:.4f})"]
        lines += textwrap.wrap(x["headline"].capitalize(), width, initial_indent="  ", subsequent_indent="  ")
        for title, items in (("Strengths", e["strengths"]), ("Gaps", e["gaps"])):
            lines += [f"  {title}:"] + [y for i in items for y in textwrap.wrap(i, width, initial_indent="    - ", subsequent_indent="      ")] if items else []
        lines += textwrap.wrap(f"Recommendation: {e['recommendation']}", width, initial_indent="  ", subsequent_indent="  ")
    return "\n".join(lines) + "\n"


def audit_report(events: DataFrame, gdpr: DataFrame, summary: DataFrame, run: str, digest: str = "hash-unavailable", width: int = 80, rows: int = ROWS) -> str:
    """Counts, articles, warnings (the first `rows`) and the log's digest."""
    lines = [*_head("AUDIT REPORT", width), "", f"Run: {run}", f"SHA-256: {digest}", ""]
    lines += [f"  {k.replace('_', ' ')}: {v}" for k, v in summary.first().asDict().items()]
    lines += ["", "ARTICLES", "-" * width]
    for a in gdpr.orderBy("ord").collect():
        lines += [f"[{'PASS' if a['satisfied'] else 'FAIL'}] {a['article']}: {a['title']}", *textwrap.wrap(a["evidence"], width, initial_indent="    ", subsequent_indent="    ")]
    lines += ["", "WARNINGS", "-" * width]
    for e in events.where("severity = 'WARNING'").orderBy("n").limit(rows).collect():
        lines += textwrap.wrap(f"{e['event_id']} {e['description']}", width, subsequent_indent="    ")
    return "\n".join(lines) + "\n"


def bias_report(checks: DataFrame, width: int = 80) -> str:
    """The seven checks."""
    rows = checks.orderBy("ord").collect()
    flags = sum(r["flagged"] for r in rows)
    lines = [*_head("FAIRNESS REPORT", width), "", f"Flags raised: {flags} of {len(rows)}", ""]
    for r in rows:
        note = r["note"] if len(r["note"]) <= 120 else r["note"][:120] + "…"
        lines += [f"[{r['status']}] {r['label']}", *textwrap.wrap(note, width, initial_indent="    ", subsequent_indent="    ")]
    return "\n".join(lines) + "\n"
