"""Sessions, lineage and tables between steps."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def get_session(name: str = "vellum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and ANSI left on; further settings as keyword arguments with _ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**settings, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset (tests on one machine), a temporary folder is set; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _OWN[app], True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return spark.sparkContext.getCheckpointDir() or _OWN[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends at files in the shared folder, which survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one run in the shared folder. As a context, all of them go at its end: results must not read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        jvm, path = self.spark._jvm, f"{self.root}/{name}".rstrip("/")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to executors that could not import it otherwise (it is neither installed nor on PYTHONPATH)."""
    root = Path(__file__).resolve().parents[1]
    reach = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":"), *(p for p in sys.path if "site-packages" in p)]
    app = f"zip-{spark.sparkContext.applicationId}"
    if str(root) in reach or app in _OWN:
        return
    folder = tempfile.mkdtemp(prefix="vellum-zip-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/vellum.zip", "w") as z:
        for f in (root / "vellum").rglob("*"):
            if f.is_file() and "__pycache__" not in f.parts:
                z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/vellum.zip")
    _OWN[app] = folder


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores where its files give fewer: steps over texts would leave cores idle.

    Large tables have more partitions than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
