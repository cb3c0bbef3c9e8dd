"""Reading document files by extension into (document_name, content), distributed over files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import basename

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(content: bytes) -> str:
    return content.decode("utf-8")


def read_docx(content: bytes) -> str:
    """The paragraphs' texts, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


#: Readers by extension; others, as for PDF, are passed to read_documents().
READERS: dict[str, Callable[[bytes], str]] = {"md": read_text, "txt": read_text, "docx": read_docx}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(document_name, content) of every file; an extension without a reader is an error, and so is a file that fails."""
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["document_name"], batch["content"]):
                extension = name.rpartition(".")[2].lower()
                if extension not in known:
                    raise ValueError(f"no reader for {name!r}; extensions known: {sorted(known)}")
                out.append(known[extension](content))
            yield pd.DataFrame({"document_name": batch["document_name"], "content": out})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(basename("path").alias("document_name"), "content").mapInPandas(run, "document_name string, content string")


def pdf_reader(pages: Callable[[bytes], list[str]]) -> Callable[[bytes], str]:
    """A PDF reader from an injected function that gives the texts of a file's pages: joined in order, nothing between."""
    return lambda content: "".join(pages(content))


def safe_name(name: str) -> str:
    """A collection's name as a folder name."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)
