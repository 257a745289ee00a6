"""Results of a screening run as tables in a folder, and which stages of a folder are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.audit import event_summary
from vellum.plans.report import audit_report, bias_report, summary_report
from vellum.plans.screening import Screening
from vellum.sources.sinks import record_digest, write_csv, write_json

#: Stage -> its label and the tables that it writes.
STAGES: dict[str, tuple[str, tuple[str, ...]]] = {
    "anonymization": ("CV Anonymization", ("anonymized", "vault")),
    "parsing": ("Section Parsing", ("parsed",)),
    "ranking": ("Candidate Ranking", ("ranking",)),
    "explainability": ("Explainability Engine", ("explanations",)),
    "audit": ("GDPR Audit Trail", ("events", "gdpr")),
    "bias": ("Bias Detection", ("checks",)),
}


def tables(run: Screening) -> dict[str, DataFrame]:
    """Table name -> rows of a run; tables that it lacks are left out. Redacted texts stand apart from the vault."""
    found = {
        "anonymized": run.vault.select("candidate_id", "text"),
        "vault": run.vault.drop("text"),
        "parsed": run.parsed,
        "ranking": run.ranking,
        "explanations": run.explanations,
        "events": run.events,
        "gdpr": run.gdpr,
        "checks": run.checks,
    }
    return {name: df for name, df in found.items() if df is not None}


def write_screening(run: Screening, folder: str, skip: tuple[str, ...] = ()) -> None:
    """Write each table of the stages not in skip as JSON lines under folder/<table>; tables there are replaced.

    Rankings are exported as CSV too, and events have a table of digests, one for each.
    """
    unknown = set(skip) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    wanted = {table for stage, (_, names) in STAGES.items() if stage not in skip for table in names}
    for name, df in tables(run).items():
        if name in wanted:
            write_json(df, f"{folder}/{name}")
    if run.explanations is not None and "explanations" in wanted:
        write_csv(run.explanations, f"{folder}/ranking_csv")
    if run.events is not None and "events" in wanted:
        digests = run.events.select("event_id", record_digest(F.struct(*run.events.columns)).alias("sha256"))
        write_json(digests, f"{folder}/event_digests")


def stage_status(spark: SparkSession, folder: str) -> dict[str, dict[str, object]]:
    """Stage -> done, path, label. A stage is done when the folders of all its tables hold a file that isn't hidden."""

    def filled(path: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        return files.exists(place) and any(not f.getPath().getName().startswith((".", "_")) for f in files.listStatus(place))

    return {stage: {"done": all(filled(f"{folder}/{n}") for n in names), "path": f"{folder}/{names[0]}", "label": label} for stage, (label, names) in STAGES.items()}


def reports(run: Screening, run_id: str) -> str:
    """The text reports of a run, one after the other; those without rows to tell of are left out."""
    out = [] if run.explanations is None else [summary_report(run.explanations)]
    if run.events is not None and run.gdpr is not None:
        out.append(audit_report(run.events, run.gdpr, event_summary(run.events), run_id))
    if run.checks is not None:
        out.append(bias_report(run.checks))
    return "\n\n".join(out)
