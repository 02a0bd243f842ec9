"""Where blobs come from and go to: (blob_id BIGINT, data BINARY), with other columns as they are."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import octets
from ..operators.template import Template, load


def from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("blob_id"), F.encode(text, "UTF-8").alias("data"))


def from_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files as (path, data), read by executors."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", F.col("content").alias("data"))


def from_bytes(spark: SparkSession, *values: bytes) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in enumerate(values)], "blob_id bigint, data binary")


def from_hex(df: DataFrame, key: str, digits: str) -> DataFrame:
    """Hex text to blobs; characters that are no hex digits are dropped, and an odd count gives null."""
    clean = F.regexp_replace(digits, "[^0-9a-fA-F]", "")
    return df.select(F.col(key).alias("blob_id"), F.when(F.length(clean) % 2 == 0, F.unhex(clean)).alias("data"))


def packed(*columns: tuple[str, int], little: bool = False):
    """Whole numbers as fixed-width bytes, one after the other."""
    parts = []
    for name, width in columns:
        piece = F.unhex(F.lpad(F.hex(F.col(name).cast("bigint")), 2 * width, "0"))
        parts.append(octets.reversed_bytes(piece, width) if little else piece)
    return F.concat(*parts)


def template_file(path: str) -> Template:
    with open(path, encoding="utf-8") as f:
        return load(f.read())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; in local mode only, a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="octoplex-")


def write_blobs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_text(df: DataFrame, path: str, column: str = "line", mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def from_stream(spark: SparkSession, stream: BinaryIO, name: str = "stdin") -> DataFrame:
    """(path, data): one blob of all that the driver reads from a byte stream, such as sys.stdin.buffer, to its end."""
    return spark.createDataFrame([(name, bytearray(stream.read()))], "path string, data binary")


def write_raw(df: DataFrame, folder: str, name: str = "path", only_changed: bool = False, backup: str | None = None) -> DataFrame:
    """(name, size, status): each blob as a file of its own bytes in a folder that all executors have mounted.

    The files are written when the result is read. A file is moved into place whole, so a task that runs again does no
    harm. only_changed leaves files alone that hold the same bytes; backup is a suffix under which what was there before
    is kept. Names may not lead out of the folder. A null blob writes nothing.
    """
    if not os.path.isabs(folder):
        raise ValueError("an absolute path of a folder that all executors have mounted is needed")

    def put(value: str, data: bytes | None) -> str:
        path = os.path.normpath(os.path.join(folder, value))
        if not path.startswith(os.path.join(os.path.normpath(folder), "")):
            return "refused"
        if data is None:
            return "null"
        old = None
        if os.path.exists(path):
            with open(path, "rb") as f:
                old = f.read()
        if old == data and only_changed:
            return "unchanged"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        kept = [(path + backup, old)] if backup and old is not None and old != data else []
        for target, content in (*kept, (path, data)):
            made = f"{target}.{uuid.uuid4().hex}"
            with open(made, "wb") as f:
                f.write(content)
            os.replace(made, target)
        return "written"

    def rows(batches):
        for batch in batches:
            names = [str(x) for x in batch.column(0).to_pylist()]
            values = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(v or b"") for v in values], pa.int64()), pa.array([put(n, v) for n, v in zip(names, values, strict=True)])], names=["name", "size", "status"])

    return df.select(F.col(name).cast("string").alias("name"), "data").mapInArrow(rows, "name string, size bigint, status string")
