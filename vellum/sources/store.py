"""Run tables over Parquet with a commit log: insert-or-ignore, update, upsert and append, in transactions of one or more tables.

Data lies in folders that are never changed, one for each run and commit; numbered log entries say which folders make up
each run's part of each table. An entry is created only if no one else has created it. A writer that comes second takes
the new state and, where that changed a part it has read, does its work again; so no write is lost and none is done twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import schemas
from vellum.errors import StoreError

TABLES = {
    "pipeline_runs": (schemas.RUNS, ("run_id",)),
    "candidates": (schemas.CANDIDATES, ("run_id", "candidate_id")),
    "ranking_results": (schemas.RANKING_RESULTS, ("run_id", "candidate_id")),
    "audit_events": (schemas.AUDIT_EVENTS, ()),
    "bias_checks": (schemas.BIAS_CHECKS, ("run_id", "check_id")),
}
#: Columns that keep their first value when a row is written again.
FIRST = {"candidates": ("anonymized_at",), "ranking_results": ("ranked_at",), "bias_checks": ("label", "checked_at")}
#: A table of one row a run: all in one part.
WHOLE = ("pipeline_runs",)
#: Commits lost in a row before a writer gives up; entries between full ones; runs that one write may touch.
ATTEMPTS, EVERY, MOST_RUNS = 50, 20, 1000

#: Folders of each run's part of each table.
State = dict[str, dict[str, list[str]]]


def _merged(rows: DataFrame, keys: tuple[str, ...], first: tuple[str, ...], columns: list[str]) -> DataFrame:
    """One row for each key, of rows with an order in _at: the last one's values, but the first not null ones of `first`."""
    values = [c for c in columns if c not in keys and c not in first]
    last = [F.max_by(F.struct(*values), "_at").alias("_last")] if values else []
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in first]
    named = {c: F.col(f"_last.{c}") for c in values}
    return rows.groupBy(*keys).agg(*last, *kept).select(*(named.get(c, F.col(c)).alias(c) for c in columns))


def _ordered(df: DataFrame, batch: int, order: tuple[str, ...]) -> DataFrame:
    """df with _at: earlier batches first, then by `order`, then as the rows come."""
    return df.withColumn("_at", F.struct(F.lit(batch).alias("b"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.monotonically_increasing_id().alias("i")))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], first: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new in place of those with the same keys; columns in `first` keep the values they had first.

    Where new holds a key several times the last row wins: by the columns `order` of new, or as the rows come. Null keys are
    keys like others. One shuffle, with a partial aggregate before it.
    """
    before = old.select("*", *(F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order if c not in old.columns))
    rows = _ordered(before, 0, order).select(*old.columns, "_at").unionByName(_ordered(new, 1, order).select(*old.columns, "_at"))
    return _merged(rows, keys, first, old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """old with those rows of new whose keys it lacks; of several with one key the first."""
    rows = _ordered(new, 1, order)
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*old.columns), "_at").alias("_row")).select("_row.*")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return old.unionByName(one.alias("n").join(old.select(*keys).alias("o"), same, "left_anti").select(*old.columns))


class Transaction:
    """Operations on a store that become visible together. Each sees what the ones before it have done."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self._todo: list[tuple[str, Callable[[State], dict[str, list[str]]]]] = []
        self._read: set[tuple[str, str]] = set()

    def save(self, table: str, new: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Upsert by the table's keys, in parts of the runs that new holds; tables without keys are appended to.

        Of several rows with one key the last one wins: by the columns `order` of new, or as they come.
        """
        ddl, keys = self.store.table(table)

        def work(state: State) -> dict[str, list[str]]:
            runs = [r["run_id"] for r in new.select("run_id").distinct().limit(MOST_RUNS + 1).collect()]
            if None in runs or len(runs) > MOST_RUNS:
                raise StoreError(f"{table}: a write needs run ids, at most {MOST_RUNS}", operation="save")
            parts = {_part(table, r) for r in runs}
            if not keys:
                made = self.store.write(table, new.select(*self.store.columns(table)))
                return {p: state[table].get(p, []) + made.get(p, []) for p in parts}
            self._read |= {(table, p) for p in parts}
            old = self.store.rows(table, state, parts)
            return self.store.write(table, upsert(old, new, keys, FIRST.get(table, ()), order))

        self._todo.append((table, work))

    def change(self, table: str, run_id: str, edit: Callable[[DataFrame], DataFrame]) -> None:
        """Replace a run's part of a table (for tables of one part: all of it) by edit(rows)."""
        part = _part(table, run_id)

        def work(state: State) -> dict[str, list[str]]:
            self._read.add((table, part))
            made = self.store.write(table, edit(self.store.rows(table, state, {part})))
            return made if part in made else {part: []}

        self._todo.append((table, work))

    def commit(self) -> int:
        """The number of the log entry."""
        version, state = self.store.state()
        done: State | None = None
        for _ in range(ATTEMPTS):
            if done is None:
                done, self._read, seen = {}, set(), {t: dict(p) for t, p in state.items()}
                for table, work in self._todo:
                    made = work(seen)
                    seen[table].update(made)
                    done.setdefault(table, {}).update(made)
            if self.store.append_entry(version + 1, state, done):
                return version + 1
            before = state
            version, state = self.store.state()
            if any(before[t].get(p) != state[t].get(p) for t in done for p in done[t]):
                done = None
        raise StoreError(f"{ATTEMPTS} other writes came first", operation="commit")


def _part(table: str, run_id: str) -> str:
    return "" if table in WHOLE else run_id


class Store:
    """The five tables under one folder, which all writers share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @staticmethod
    def table(name: str) -> tuple[str, tuple[str, ...]]:
        if name not in TABLES:
            raise StoreError(f"no table {name}", operation="read")
        return TABLES[name]

    def columns(self, table: str) -> list[str]:
        return [c.split()[0] for c in self.table(table)[0].split(", ")]

    # The log.

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _entry(self, n: int) -> dict:
        fs, p = self._fs(f"{self.root}/_log/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self._names(f"{self.root}/_log") if n.endswith(".json") and not n.startswith(".")]

    def state(self, version: int | None = None) -> tuple[int, State]:
        """(number of the last entry, or of `version`; 0 for none, its state)."""
        out: State = {t: {} for t in TABLES}
        numbers = [n for n in self.versions() if version is None or n <= version]
        if not numbers:
            return 0, out
        entries = []
        for n in reversed(numbers):
            entries.append(self._entry(n))
            if entries[-1]["full"]:
                break
        for entry in reversed(entries):
            for t, parts in entry["parts"].items():
                out[t].update(parts)
        return numbers[-1], {t: {p: f for p, f in parts.items() if f} for t, parts in out.items()}

    def append_entry(self, n: int, state: State, changed: State) -> bool:
        """Create entry n; False if it is there. It appears whole or not at all. Every few entries hold the whole state."""
        full = n % EVERY == 0 or n == 1
        parts = {t: {**(state[t] if full else {}), **changed.get(t, {})} for t in TABLES}
        text = json.dumps({"full": full, "parts": parts}, sort_keys=True)
        at = f"{self.root}/_log/{n:012d}.json"
        fs, temporary = self._fs(f"{self.root}/_log/.{uuid.uuid4().hex}")
        fs.mkdirs(temporary.getParent())
        stream = fs.create(temporary, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            return self._claim(fs, temporary, at)
        finally:
            fs.delete(temporary, False)

    def _claim(self, fs, temporary, at: str) -> bool:
        """Give a finished file its name unless the name is taken, as one step."""
        jvm = self.spark._jvm
        if fs.getUri().getScheme() == "file":  # Hadoop's local rename looks first and renames then; a hard link is one step
            try:
                os.link(temporary.toUri().getPath(), self._fs(at)[1].toUri().getPath())
                return True
            except FileExistsError:
                return False
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._fs(at)[1], kinds)
            return True
        except Exception as e:  # py4j wraps the JVM's exception
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    # Rows.

    def write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows to new folders; the folders by part."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        part = F.lit("all") if table in WHOLE else F.concat(F.lit("-"), F.col("run_id"))
        rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        names = [n for n in self._names(f"{self.root}/{folder}") if n.startswith("_part=")]
        return {"" if table in WHOLE else unquote(n.removeprefix("_part="))[1:]: [f"{folder}/{n}"] for n in names}

    def rows(self, table: str, state: State, parts: set[str] | None = None) -> DataFrame:
        ddl, _ = self.table(table)
        folders = [f"{self.root}/{f}" for p, fs in sorted(state[table].items()) if parts is None or p in parts for f in fs]
        return self.spark.read.schema(ddl).parquet(*folders) if folders else self.spark.createDataFrame([], ddl)

    def read(self, table: str, run_id: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or one run's part of it, as of the last entry or an earlier one that vacuum has left."""
        self.table(table)
        rows = self.rows(table, self.state(version)[1], None if run_id is None else {_part(table, run_id)})
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """All operations of the block in one log entry; none if it raises."""
        t = Transaction(self)
        yield t
        t.commit()

    def save(self, table: str, new: DataFrame, order: tuple[str, ...] = ()) -> None:
        """One Transaction.save."""
        with self.transaction() as t:
            t.save(table, new, order)

    def vacuum(self, keep: int = 10, older_than_s: float = 24 * 3600) -> int:
        """Remove folders that none of the last `keep` states names and that are older than any write in progress; how many."""
        numbers = self.versions()[-keep:]
        named = {f for n in numbers for parts in self.state(n)[1].values() for fs in parts.values() for f in fs}
        fs, gone = self._fs(self.root)[0], 0
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for table in TABLES:
            for name in self._names(f"{self.root}/data/{table}"):
                folder = f"data/{table}/{name}"
                _, p = self._fs(f"{self.root}/{folder}")
                if not any(f.startswith(f"{folder}/") for f in named) and now - fs.getFileStatus(p).getModificationTime() >= 1000 * older_than_s:
                    fs.delete(p, True)
                    gone += 1
        return gone

    # Runs.

    def create_run(self, run_id: str, jd_file: str | None = None, jd_text: str | None = None, at: str = "") -> None:
        """A running run, unless there is one with this id; the first 2000 characters of the description are kept."""
        row = (run_id, jd_file, (jd_text or "")[:2000], "running", at, None, None, None, None)
        new = self.spark.createDataFrame([row], schemas.RUNS)
        with self.transaction() as t:
            t.change("pipeline_runs", run_id, lambda old: insert_or_ignore(old, new, ("run_id",)))

    def finish_run(self, run_id: str, exit_code: int, total_cvs: int = 0, error: str | None = None, at: str = "") -> None:
        status = "completed" if exit_code == 0 else "failed"
        values: dict[str, Column] = {"status": F.lit(status), "finished_at": F.lit(at), "exit_code": F.lit(exit_code), "total_cvs": F.lit(total_cvs), "error_message": F.lit(error).cast("string")}
        own = F.col("run_id") == run_id
        with self.transaction() as t:
            t.change("pipeline_runs", run_id, lambda old: old.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items()}))

    def get_run(self, run_id: str) -> DataFrame:
        return self.read("pipeline_runs", run_id)

    def list_runs(self, n: int = 20) -> DataFrame:
        return self.read("pipeline_runs").orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)

    def rankings(self, run_id: str) -> DataFrame:
        """Ranking rows of a run by rank, skills decoded."""
        skills = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
        return self.read("ranking_results", run_id).withColumns({c: skills(c) for c in ("matched_skills", "missing_skills")}).orderBy("rank")

    def candidates(self, run_id: str) -> DataFrame:
        return self.read("candidates", run_id).orderBy("candidate_id")


def candidate_rows(run_id: str, vault: DataFrame, parsed: DataFrame, at: str) -> DataFrame:
    """Rows of the candidates table from vault and parsed records."""
    total = F.aggregate(F.map_values("pii_categories_found"), F.lit(0), lambda a, b: a + b)
    v = vault.select("candidate_id", F.col("original_filename").alias("original_file"), total.alias("pii_count"), F.coalesce("validation_score.passed", F.lit(False)).cast("int").alias("validation_passed"), F.coalesce("validation_score.confidence_score", F.lit(0.0)).alias("validation_confidence"), F.to_json(F.struct(*vault.columns)).alias("vault_json"))
    s = F.col("sections")
    p = parsed.select("candidate_id", "quality_score", s["total_experience_months"].alias("total_exp_months"), F.to_json(F.flatten(F.map_values(s["skills"]))).alias("skills_json"), F.to_json(s["education"]).alias("education_json"))
    out = v.join(p, "candidate_id", "left").withColumns({"run_id": F.lit(run_id), "anonymized_at": F.lit(at), "quality_score": F.coalesce("quality_score", F.lit(0.0)), "total_exp_months": F.coalesce("total_exp_months", F.lit(0)), "skills_json": F.coalesce("skills_json", F.lit("[]")), "education_json": F.coalesce("education_json", F.lit("[]"))})
    return out


def ranking_rows(run_id: str, ranking: DataFrame, explanations: DataFrame | None, at: str) -> DataFrame:
    """Rows of the ranking_results table; verdict and recommendation are null without explanations."""
    told = explanations.select("candidate_id", "verdict", F.col("explanation.recommendation").alias("recommendation")) if explanations is not None else ranking.sparkSession.createDataFrame([], "candidate_id string, verdict string, recommendation string")
    out = ranking.join(told, "candidate_id", "left")
    return out.withColumns({"run_id": F.lit(run_id), "ranked_at": F.lit(at), "matched_skills": F.to_json("matched_skills"), "missing_skills": F.to_json("missing_skills")})


def event_rows(run_id: str, events: DataFrame) -> DataFrame:
    """Rows of the audit_events table; the legal basis is not stored."""
    return events.select(F.lit(run_id).alias("run_id"), "event_id", "event_type", "stage", "candidate_id", "severity", "description", F.col("extra").alias("extra_json"), "timestamp")


def check_rows(run_id: str, checks: DataFrame, at: str) -> DataFrame:
    return checks.select(F.lit(run_id).alias("run_id"), "check_id", "label", F.col("flagged").cast("int").alias("flagged"), "status", "note", F.col("detail").alias("detail_json"), F.lit(at).alias("checked_at"))
