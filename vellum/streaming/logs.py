"""The log of a run: stages and streams write to it, readers follow it, a rotating file keeps it."""

from __future__ import annotations

import json
import logging
import logging.handlers
import queue
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Bytes of a log file before it is rotated, files that are kept, lines that wait for a reader, seconds until a silent log ends.
MAX_BYTES, BACKUPS, WAITING, IDLE_S = 5_000_000, 5, 1000, 30.0
DONE = "__DONE__"


class JsonLines(logging.Formatter):
    """One JSON object a record."""

    def format(self, record: logging.LogRecord) -> str:
        told = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            told["error"] = self.formatException(record.exc_info)
        return json.dumps(told, ensure_ascii=False)


class LineQueue(logging.Handler):
    """A bounded queue of lines. When it is full the oldest line goes, and is counted: a slow reader never holds up the run."""

    def __init__(self, most: int = WAITING) -> None:
        super().__init__()
        self.lines: queue.Queue[str] = queue.Queue(most)
        self.lost = 0

    def put(self, line: str) -> None:
        while True:
            try:
                return self.lines.put_nowait(line)
            except queue.Full:
                try:
                    self.lines.get_nowait()
                    self.lost += 1
                except queue.Empty:
                    continue

    def emit(self, record: logging.LogRecord) -> None:
        self.put(self.format(record))

    def done(self) -> None:
        """Readers end after what is waiting."""
        self.put(DONE)

    def follow(self, idle: float = IDLE_S) -> Iterator[str]:
        """Lines as they come, until the log is done or silent for `idle` seconds; the last line then says which lines were lost."""
        while True:
            try:
                line = self.lines.get(timeout=idle)
            except queue.Empty:
                yield "[TIMEOUT]"
                break
            if line == DONE:
                break
            yield line
        if self.lost:
            yield f"[{self.lost} lines lost]"


class StreamProgress(StreamingQueryListener):
    """Writes starts, progress, idle ends and failures of streaming queries to a logger."""

    def __init__(self, logger: logging.Logger) -> None:
        self.logger = logger

    def onQueryStarted(self, event) -> None:
        self.logger.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.logger.info("stream %s batch %s: %s rows", p.name or p.id, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.logger.debug("stream %s idle", event.id)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.logger.error("stream %s failed: %s", event.id, event.exception.splitlines()[0])
        else:
            self.logger.info("stream %s ended", event.id)


def run_log(spark: SparkSession | None, path: str | None = None, name: str = "vellum", waiting: int = WAITING, max_bytes: int = MAX_BYTES) -> tuple[logging.Logger, LineQueue]:
    """A logger with a queue to follow, on the driver; streams of the session tell it of themselves, and path keeps it as JSON lines.

    Called again for one name it replaces what was there, so nothing is written twice.
    """
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    out = LineQueue(waiting)
    out.setLevel(logging.INFO)
    out.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    logger.addHandler(out)
    if path:
        kept = logging.handlers.RotatingFileHandler(path, maxBytes=max_bytes, backupCount=BACKUPS, encoding="utf-8")
        kept.setFormatter(JsonLines())
        logger.addHandler(kept)
    if spark is not None:
        if old := _LISTENING.pop(name, None):
            spark.streams.removeListener(old)
        _LISTENING[name] = StreamProgress(logger)
        spark.streams.addListener(_LISTENING[name])
    return logger, out


_LISTENING: dict[str, StreamProgress] = {}


def timed(logger: logging.Logger, what: str):
    """A context that logs the start of a stage and its end, with its seconds, or its failure."""
    from contextlib import contextmanager

    @contextmanager
    def stage() -> Iterator[None]:
        began = time.time()
        logger.info("%s started", what)
        try:
            yield
        except Exception:
            logger.exception("%s failed after %.1f s", what, time.time() - began)
            raise
        logger.info("%s done in %.1f s", what, time.time() - began)

    return stage()
