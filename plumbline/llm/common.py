"""What the operators share: batches of bounded size, an order over all rows, files in the shared folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.words import Texts, texts_of
from plumbline.session import fresh_folder

#: Rows of an Arrow batch, and bytes of text worked on at once inside it.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for tables with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch whose texts hold at most ``limit`` bytes; a longer text is a slice of its own."""
    offsets = texts_of(batch.column(column)).offsets
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        part = batch.slice(at, stop - at)
        yield part, texts_of(part.column(column))
        at = stop


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, Texts], dict], schema: str, column: str = "text") -> DataFrame:
    """Rows made by ``fn`` from slices of ``df``: a dictionary of columns for each."""
    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, column):
                yield pa.RecordBatch.from_pydict(fn(part, texts))

    return df.mapInArrow(run, schema)


# ---- files ----------------------------------------------------------------

def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder in the shared store and the path inside it."""
    if "://" not in uri and not re.match(r"^\w+:/", uri):
        uri = "file://" + os.path.abspath(uri)
    return pa.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri))


class AtomicFile:
    """A file that is there whole or not at all: written beside its place, then moved over it.

    A task that runs twice writes the same bytes twice, and readers see one of them.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def exists(folder: str, name: str) -> bool:
    fs, root = filesystem(folder)
    return fs.get_file_info(f"{root}/{name}").type == pa.fs.FileType.File


def remove(folder: str, name: str) -> None:
    fs, root = filesystem(folder)
    if exists(folder, name):
        fs.delete_file(f"{root}/{name}")


def open_file(folder: str, name: str):
    fs, root = filesystem(folder)
    return fs.open_input_file(f"{root}/{name}")


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver next collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep_table(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table that is read several times to the shared folder and read it back.

    With ``release`` the shuffle files of the write are deleted when it is done.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, str(release).lower())
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(folder)
