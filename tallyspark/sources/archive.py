"""Archives of invoice files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "arquivo string, xml string, erro string"


def members(name: str, data: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    """(path, text, error) of each .xml in an archive, archives within it included."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for inner in z.namelist():
                if inner.lower().endswith(".zip"):
                    yield from members(f"{name}/{inner}", z.read(inner))
                elif inner.lower().endswith(".xml"):
                    yield f"{name}/{inner}", z.read(inner).decode("utf-8", "replace"), None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
        yield name, None, f"arquivo invalido: {e}"


def unzip(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) to SCHEMA, one row a member, in the archive's order; one row with erro for an archive
    that can't be read.  Rows go out member by member, so a task holds one archive and one member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for row in members(path.rsplit("/", 1)[-1], bytes(content)):
                    yield pd.DataFrame([row], columns=["arquivo", "xml", "erro"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All archives of a folder."""
    return unzip(spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder))
