"""Entropy, byte histograms and index of coincidence, whole or by blocks.

Bytes are counted by an Arrow kernel in one pass over the blobs, which gives few rows to the aggregation after it; the
same measures as plain DataFrame plans (`native=True`) shuffle a row a byte value and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import octets
from ..functions.literals import Unsupported
from .edit import read


def _measures(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy and index of coincidence of rows of 256 counts."""
    n = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / n
        entropy = -np.where(counts > 0, p * np.log2(p), 0.0).sum(1)
        ic = (counts * (counts - 1)).sum(1) / (n * (n - 1))[:, 0]
    return np.where(n[:, 0] > 0, entropy + 0.0, 0.0), np.where(n[:, 0] > 1, ic, 0.0)


def _block_counts(data: bytes, block: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8)
    rows = max(1, -(-len(values) // block)) if block else 1
    at = np.arange(len(values)) // block if block else 0
    return np.bincount(values + 256 * at, minlength=256 * rows).reshape(rows, 256)


def blocks(df: DataFrame, block_size: int = 0, key: str = "blob_id") -> DataFrame:
    """(key, offset, size, entropy, ic): a row for each block of each blob (0: the whole). An empty blob has one, of zeros."""

    def rows(batches):
        for batch in batches:
            keys, offsets, sizes, measures = [], [], [], ([], [])
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                counts = _block_counts(data, block_size)
                keys += [k] * len(counts)
                offsets += [r * block_size for r in range(len(counts))]
                sizes += counts.sum(1).tolist()
                for out, got in zip(measures, _measures(counts), strict=True):
                    out += got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(m, pa.float64()) for m in measures]], names=[key, "offset", "size", "entropy", "ic"])

    kind = dict(df.dtypes)[key]
    return df.select(key, "data").mapInArrow(rows, f"{key} {kind}, offset bigint, size bigint, entropy double, ic double")


def native_blocks(df: DataFrame, block_size: int = 0, key: str = "blob_id") -> DataFrame:
    """As blocks, by exploding and grouping bytes."""
    b = F.coalesce("data", F.lit(bytearray()))
    at = F.floor(F.col("pos") / block_size) * block_size if block_size else F.lit(0).cast("bigint")
    each = df.select(key, F.posexplode(octets.values(b)).alias("pos", "v")).withColumn("offset", at.cast("bigint"))
    n = each.groupBy(key, "offset", "v").count().withColumn("n", F.sum("count").over(Window.partitionBy(key, "offset")))
    p = F.col("count") / F.col("n")
    made = n.groupBy(key, "offset").agg(F.max("n").alias("size"), F.sum(-p * F.log2(p)).alias("entropy"), F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)) / F.nullif(F.max(F.col("n") * (F.col("n") - 1)), F.lit(0)), F.lit(0.0)).alias("ic"))
    empty = df.where(F.octet_length(b) == 0).select(key, F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("entropy"), F.lit(0.0).alias("ic"))
    return made.union(empty)


def summary(found: DataFrame, measure: str = "entropy") -> DataFrame:
    return found.agg(F.count("*").alias("blocks"), F.min(measure).alias("least"), F.max(measure).alias("most"), F.avg(measure).alias("mean"))


def byte_counts(df: DataFrame) -> DataFrame:
    """(byte, count) over all blobs: at most 256 rows a task are shuffled."""

    def rows(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            for piece in column:
                total += np.bincount(np.frombuffer(piece.as_py() or b"", np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["byte", "n"])

    return df.select("data").mapInArrow(rows, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("count"))


def histogram(df: DataFrame, full: bool = False) -> DataFrame:
    """(byte, count, percentage), 0 to 100; full has all 256 bytes. Order by count desc, byte for the usual listing."""
    counts = byte_counts(df)
    if full:
        counts = df.sparkSession.range(256).select(F.col("id").cast("int").alias("byte")).join(counts, "byte", "left").na.fill(0, ["count"])
    total = counts.agg(F.sum("count").alias("total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.select("byte", "count", F.coalesce(F.col("count") * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("percentage"))


def top(found: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent bytes with a bar of half their percentage, 25 at most."""
    bar = F.expr("repeat('█', cast(least(round(percentage / 2), 25) as int))")
    return found.orderBy(F.desc("count"), "byte").limit(n).withColumn("bar", bar)


# The classes and their bounds.
def entropy_class(entropy: Column) -> Column:
    return (
        F.when(entropy < 1, "highly repetitive/uniform").when(entropy < 4, "structured data/text/code").when(entropy < 6, "mixed content")
        .when(entropy < 7.5, "likely compressed").otherwise("encrypted or random")
    )


def ic_class(ic: Column) -> Column:
    return F.when(ic < 0.006, "random/encrypted").when(ic < 0.02, "possibly compressed").when(ic < 0.05, "structured binary").otherwise("text-like patterns")


# The names of the analyses.
KINDS = {"entropy": "entropy", "histogram": "histogram", "hist": "histogram", "ic": "ic", "ioc": "ic", "index-of-coincidence": "ic"}
#: The block size of an analysis that names none; 0 takes each blob whole.
DEFAULT_BLOCK = 256


def analyze(df: DataFrame, kind: str, block_size: int = DEFAULT_BLOCK, where: str | None = None, key: str = "blob_id") -> DataFrame:
    """An analysis by its name, of a byte range of each blob if one is given; blobs that it does not fit are left out."""
    name = KINDS.get(kind.lower())
    if not name:
        raise Unsupported(f"unknown analysis: {kind}")
    if where is not None:
        df = read(df, where).where("error is null").drop("error")
    if name == "histogram":
        return histogram(df)
    return blocks(df, block_size, key).select(key, "offset", "size", name)


def rendered(found: DataFrame, measure: str, form: str) -> DataFrame:
    """A line for each block as csv or json, entropy to 6 places and ic to 8; of a histogram for each byte."""
    places = {"entropy": 6, "ic": 8, "percentage": 4}[measure]
    shown = F.format_string(f"%.{places}f", measure)
    first, second = ("byte", "count") if measure == "percentage" else ("offset", "size")
    if form == "csv":
        line = F.concat_ws(",", F.col(first).cast("string"), F.col(second).cast("string"), shown)
    elif form == "json":
        line = F.format_string(f'{{"{first}":%d,"{second}":%d,"{measure}":%s}}', first, second, shown)
    else:
        raise Unsupported(f"unknown form: {form}")
    return found.select(*[c for c in found.columns if c not in ("entropy", "ic", "percentage")], line.alias("line"))


def document(found: DataFrame, measure: str, form: str, key: str = "blob_id") -> DataFrame:
    """(key, text): the whole of a blob's analysis: csv with a head, or json, an object for one block, else a list of them."""
    made = rendered(found, measure, form)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("offset", "line"))), lambda x: x["line"])
    head = f"offset,size,{measure}\n"
    whole = F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n"))
    if form == "json":
        whole = F.when(F.size("lines") == 1, F.get("lines", F.lit(0))).otherwise(F.concat(F.lit('{"blocks":['), F.array_join("lines", ","), F.lit("]}")))
    return made.groupBy(key).agg(lines.alias("lines")).select(key, whole.alias("text"))


def histogram_document(found: DataFrame, form: str) -> DataFrame:
    """(text) of a histogram of 256 rows at most, the most frequent bytes first: csv with a head, or json with the total."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "byte", "line"))), lambda x: x["line"])
    made = rendered(found.withColumn("total", F.col("count")), "percentage", form).groupBy().agg(lines.alias("lines"), F.sum("total").alias("total"))
    if form == "csv":
        return made.select(F.concat(F.lit("byte,count,percentage\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
    return made.select(F.concat(F.lit('{"total":'), F.coalesce("total", F.lit(0)).cast("string"), F.lit(',"histogram":['), F.array_join("lines", ","), F.lit("]}")).alias("text"))
