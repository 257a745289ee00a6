"""Readers: folders of documents, job descriptions and JSON records, as DataFrames. Failures are columns, not exceptions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import is_blank
from vellum.operators.rank import global_rank
from vellum.sources.sinks import LOOKUP_BUCKETS, lookup_bucket

EXTENSIONS = (".txt", ".pdf", ".docx")
MAX_BYTES = 10 * 1024 * 1024
READ = "path string, file_name string, extension string, text string, status string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, joined by line ends; tables are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    runs = lambda p: "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "" for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
    return "\n".join(runs(p) for p in (body if body is not None else []) if p.tag == f"{_W}p")


def ocr_text(content: bytes, dpi: int = 300) -> str:
    """Text of a scanned PDF; empty where a tool is missing, and for a page that fails."""
    try:
        import pytesseract
        from pdf2image import convert_from_bytes

        pages = convert_from_bytes(content, dpi=dpi)
    except Exception:
        return ""
    out = []
    for page in pages:
        try:
            out.append(pytesseract.image_to_string(page))
        except Exception:
            out.append("")
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    """Embedded text, pages joined by line ends; OCR where there is none. Needs a PDF library on the executors."""
    try:
        from pypdf import PdfReader
    except ImportError:
        from PyPDF2 import PdfReader
    text = "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    return text if text.strip() else ocr_text(content)


def decode(name: str, content: bytes) -> tuple[str | None, str, str | None]:
    """(text, status, error) of one file."""
    ext = name[name.rfind(".") :].lower() if "." in name else ""
    try:
        if ext == ".txt":
            text = content.decode("utf-8")
        elif ext == ".docx":
            text = docx_text(content)
        elif ext == ".pdf":
            text = pdf_text(content)
        elif ext == ".doc":
            return None, "FAILED", "Legacy .doc format is not supported; convert to .docx"
        else:
            return None, "FAILED", f"Unsupported file format: {ext}"
    except Exception as e:  # a broken file is a row, not a failed job
        return None, "FAILED", f"{type(e).__name__}: {e}"
    return (text, "OK", None) if text.strip() else (text, "SKIPPED", "empty")


def list_files(spark: SparkSession, folder: str, extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """path, file_name, extension, length, content (read only if selected) of a folder's files with these extensions."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))
    return files.select("path", name.alias("file_name"), ext.alias("extension"), "length", "content").where(F.col("extension").isin(*extensions))


def count_files(spark: SparkSession, folder: str) -> int:
    """Files that a reader takes; 0 for a folder that isn't there."""
    try:
        return list_files(spark, folder).select("path").count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def accepts_upload(name: F.Column, length: F.Column) -> F.Column:
    """A plain file name with a known extension, of at most MAX_BYTES."""
    return F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).isin(*EXTENSIONS) & (length <= MAX_BYTES) & ~name.rlike(r"[/\\]|^\.")


def read_documents(spark: SparkSession, folder: str, extensions: Iterable[str] = (*EXTENSIONS, ".doc")) -> DataFrame:
    """READ rows of a folder, one for each file; status OK, SKIPPED (empty) or FAILED with error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decode(n, bytes(c)) for n, c in zip(batch["file_name"], batch["content"], strict=True)]
            out = batch[["path", "file_name", "extension"]].copy()
            out["text"], out["status"], out["error"] = zip(*got, strict=True) if got else ([], [], [])
            yield out

    return list_files(spark, folder, extensions).select("path", "file_name", "extension", "content").mapInPandas(read, READ)


def with_candidate_ids(files: DataFrame) -> DataFrame:
    """candidate_id by place in the order of file names (Candidate_01 on); empty and failed files keep their number."""
    ranked = global_rank(files, F.col("file_name"), F.col("path"), name="place")
    return ranked.withColumn("candidate_id", F.format_string("Candidate_%02d", F.col("place"))).drop("place")


def read_texts(spark: SparkSession, folder: str, skip: Iterable[str] = ("error_log.txt", "index.txt")) -> DataFrame:
    """candidate_id (the file's stem), text of a folder of texts, blank ones left out."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    return df.where(~F.col("file").isin(*skip) & ~is_blank(F.col("text"))).select(F.regexp_replace("file", r"\.txt$", "").alias("candidate_id"), "text")


def read_records(spark: SparkSession, folder: str, schema: str, skip: Iterable[str] = ()) -> DataFrame:
    """JSON records, one file each; candidate_id falls back to the file's stem; malformed files are left out."""
    own = f"{schema}, _corrupt string"
    df = spark.read.schema(own).json(folder, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", pathGlobFilter="*.json")
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = df.withColumn("_file", file).where(F.col("_corrupt").isNull() & ~F.col("_file").isin("", *skip))
    return df.withColumn("candidate_id", F.coalesce("candidate_id", F.regexp_replace("_file", r"\.json$", ""))).drop("_corrupt", "_file")


def lookup(spark: SparkSession, path: str, schema: str, candidate_id: str | None, buckets: int = LOOKUP_BUCKETS) -> DataFrame:
    """The records of one candidate from what write_lookup wrote with as many buckets; no rows for an id that is not there or null.

    One folder is read, and of its files the row groups that may hold the id.
    """
    records = spark.read.schema(f"{schema}, lookup_bucket int").parquet(path)
    if candidate_id is None:
        return records.where("false").drop("lookup_bucket")
    bucket = spark.range(1).select(lookup_bucket(F.lit(candidate_id), buckets)).first()[0]
    return records.where((F.col("lookup_bucket") == bucket) & (F.col("candidate_id") == candidate_id)).drop("lookup_bucket")


def read_vault(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Vault records; where a folder has none of its own, those of vault_master.json (a map by candidate)."""
    records = read_records(spark, folder, schema, skip=("vault_master.json", "error_log.json"))
    if not records.isEmpty():
        return records
    master = spark.read.text(f"{folder}/vault_master.json", wholetext=True)
    told = master.select(F.explode(F.from_json("value", f"map<string,struct<{_struct(schema)}>>")).alias("key", "v"))
    return told.select("key", "v.*").withColumn("candidate_id", F.coalesce("candidate_id", "key")).drop("key")


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def read_job(spark: SparkSession, path: str) -> str:
    """The text of one job description; undecodable bytes are replaced."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode("utf-8", "replace")
