"""Files as documents: discovery, loading, CSV rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import file_hash
from docweave.operators.chunking import delimiter_of, text_columns  # noqa: F401
from docweave.session import staged

#: Suffixes that are loaded.
TEXT_SUFFIXES = ["txt", "md", "markdown", "html", "htm", "csv", "tsv", "json", "yaml", "yml", "py", "js", "ts", "java", "cs", "cpp", "c", "go", "rs", "ipynb", "xml", "log", "rst"]
OTHER_SUFFIXES = ["docx"]
MOST_BYTES = 30 * 1024 * 1024


def discovered(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, suffix, length, modificationTime, content) of the files of a folder that can be loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.col("suffix").isin(TEXT_SUFFIXES + OTHER_SUFFIXES))


def docx_text(content: bytes) -> str:
    """Paragraphs, then tables with cells joined by bars, of a Word document."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    parts = [said(p) for p in body.findall(f"{space}p")]
    parts += [" | ".join(said(c) for c in row.findall(f"{space}tc")) for row in body.iter(f"{space}tr")]
    return "\n\n".join(p for p in parts if p.strip())


def load_documents(spark: SparkSession, folder: str, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, path, name, file_type, file_size, hash, status, content): every file once per content.

    Blank files, files over `most_bytes` and files that can't be read have a status that says so
    and no content; files of 0 bytes are not listed, as Spark plans no task for them. Of files with equal
    hashes the first path is decoded, others are `duplicate`; files that are too large have no hash.
    """
    files = discovered(spark, folder, recursive)
    small = F.col("length") <= most_bytes
    # sizes alone say what is too large; hashes and paths alone, which files are copies; only the others are decoded
    hashed = staged(files.where(small).select("path", file_hash("content").alias("hash")), "hashes")
    first = hashed.groupBy("hash").agg(F.min("path").alias("path"))
    fresh = files.where(small).join(first, "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, states = [], []
            for suffix, content, length in zip(batch["suffix"], batch["content"], batch["length"]):
                text, state = None, "loaded"
                if length == 0:
                    state = "empty"
                else:
                    try:
                        text = docx_text(content) if suffix == "docx" else bytes(content).decode("utf-8", errors="replace")
                        text, state = (text, state) if text.strip() else (None, "empty")
                    except Exception:  # a broken file must not end the job
                        text, state = None, "failed"
                texts.append(text)
                states.append(state)
            yield pd.DataFrame({"path": batch["path"], "name": batch["name"], "file_type": batch["suffix"], "file_size": batch["length"], "hash": batch["hash"], "status": states, "content": texts})

    columns = "path string, name string, file_type string, file_size long, hash string, status string, content string"
    found = fresh.mapInPandas(read, columns)
    none = F.lit(None).cast("string")
    of = [F.col("path"), F.col("name"), F.col("suffix").alias("file_type"), F.col("length").alias("file_size")]
    copies = files.where(small).drop("content").join(hashed.join(first, ["path", "hash"], "left_anti"), "path").select(*of, "hash", F.lit("duplicate").alias("status"), none.alias("content"))
    large = files.where(~small).select(*of, none.alias("hash"), F.lit("too_large").alias("status"), none.alias("content"))
    name = F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws("::", "path", "hash")), 1, 16))
    return found.unionByName(copies).unionByName(large).select(name.alias("id"), "path", "name", "file_type", "file_size", "hash", "status", "content")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of texts with its delimiter found from the header; broken lines are left out."""
    head = spark.read.text(path).limit(1).collect()
    sep = delimiter_of(head[0][0]) if head else ","
    return spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED", multiLine=False)
