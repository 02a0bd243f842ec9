"""Pattern search in blobs: exact bytes, masks and regular expressions. The sequential left-to-right result defines all.

Counts and first matches of fixed patterns are JVM expressions. Lists of matches come from an Arrow kernel, which takes a
batch of blobs as one run of bytes, so that the time is linear in the bytes and the matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions import kernels, octets
from ..functions.literals import Exact, Mask, Pattern, Regex, Unsupported


def _byte_source(pattern: Exact | Mask, overlapping: bool) -> str:
    """A Java regex over a character for each byte; overlapping matches are looked ahead at."""
    inner = "".join("." if x is None else rf"\x{x:02x}" for x in pattern.data)
    return f"(?s)(?={inner})" if overlapping else f"(?s){inner}"


def compiled(pattern: Regex):
    """The regex as executors run it. Mode text has Unicode classes and $ as the very end; mode bytes reads bytes."""
    import regex

    if pattern.mode == "bytes":
        return re.compile(re.sub(r"(?<!\\)((?:\\\\)*)\$", r"\1\\Z", pattern.source).encode("latin-1"))
    return regex.compile(re.sub(r"(?<!\\)((?:\\\\)*)\$", r"\1\\Z", pattern.source))


def _regex_hits(column: pa.Array, pattern: Regex, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, stop) in bytes of the matches in each value, about kernels.ROWS at a time; invalid UTF-8 counts as the replacement character."""
    source, held, n = compiled(pattern), [], 0

    def joined():
        spans = np.concatenate([x[1] for x in held])
        return np.concatenate([x[0] for x in held]), spans[:, 0], spans[:, 1]

    for k, value in enumerate(column):
        data = value.as_py()
        if data is None:
            continue
        subject, edges = data, None
        if pattern.mode != "bytes":
            subject = data.decode("utf-8", "replace")
            if len(data) != len(subject):
                edges = np.concatenate(([0], np.cumsum(_widths(subject) if "�" not in subject else _byte_widths(data))))
        for part in islice(kernels.spans(source, subject, 1 if first else kernels.ROWS), 1 if first else None):
            held.append((np.full(len(part), k), part if edges is None else edges[part]))
            n += len(part)
            if n >= kernels.ROWS:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _widths(text: str) -> np.ndarray:
    """Of each character, how many bytes it has in UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


def _byte_widths(data: bytes) -> np.ndarray:
    """Of each character of the leniently decoded bytes, how many bytes it stands for."""
    import codecs

    widths: list[int] = []
    decoder, at = codecs.getincrementaldecoder("utf-8")("strict"), 0
    while at < len(data):
        decoder.reset()
        try:
            text = data[at:].decode("utf-8")
            widths += [len(c.encode()) for c in text]
            break
        except UnicodeDecodeError as e:
            widths += [len(c.encode()) for c in data[at : at + e.start].decode("utf-8")]
            widths.append(e.end - e.start)
            at += e.end
    return np.array(widths, np.int64)


def search(df: DataFrame, pattern: Pattern, find_all: bool = True, no_overlap: bool = False, context: int = 0, key: str = "blob_id") -> DataFrame:
    """(key, offset, match): a row for each match, or for the first of each blob. With context, before and after too.

    Bytes are searched some MB at a time and matches are given back as they are found, so memory does not hold them all.
    Blobs that cannot match are dropped before any bytes leave the JVM. A null blob has no match. Without context, the
    first match of a fixed pattern never leaves it.
    """
    fixed = not isinstance(pattern, Regex)
    if fixed and not pattern.data:
        raise Unsupported("an empty pattern")
    if isinstance(pattern, Exact):
        df = df.where(F.contains("data", octets.literal(pattern.data)))
    if fixed and not find_all:
        at = F.regexp_instr(octets.latin1(F.col("data")), F.lit(_byte_source(pattern, False))).cast("bigint") - 1
        start, b = F.col("offset"), F.col("data")
        found = df.select(F.col(key), "data", at.alias("offset")).where("offset >= 0")
        return found.select(key, "offset", octets.cut(b, start, len(pattern.data)).alias("match"), *_around(b, start, len(pattern.data), context))

    def hits(data):
        if not fixed:
            yield from _regex_hits(data, pattern, not find_all)
            return
        row, start = kernels.find(data, pattern.data, no_overlap)
        for a in range(0, len(row), kernels.ROWS):
            s = start[a : a + kernels.ROWS]
            yield row[a : a + kernels.ROWS], s, s + len(pattern.data)

    def rows(batches):
        for batch in (piece for batch in batches for piece in kernels.pieces(batch, 1)):
            keys, data = batch.columns
            held = kernels.buffer(data)
            for r, s, e in hits(data):
                out = [keys.take(pa.array(r)), pa.array(s), kernels.slices(held, r, s, e)]
                if context:
                    size = held[1][r + 1] - held[1][r]
                    out += [kernels.slices(held, r, np.maximum(s - context, 0), s), kernels.slices(held, r, e, np.minimum(e + context, size))]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    kept = df.select(key, "data")
    binary = ["match", "before", "after"] if context else ["match"]
    schema = StructType([kept.schema[0], StructField("offset", LongType()), *(StructField(c, BinaryType()) for c in binary)])
    return kept.mapInArrow(rows, schema)


def _around(b: Column, start: Column, width: int, context: int) -> list[Column]:
    lead = F.least(start, F.lit(context).cast("bigint"))
    return [octets.cut(b, start - lead, lead).alias("before"), octets.cut(b, start + width, context).alias("after")] if context else []


def count(df: DataFrame, pattern: Exact | Mask, no_overlap: bool = False, key: str = "blob_id") -> DataFrame:
    return df.select(key, F.regexp_count(octets.latin1(F.coalesce("data", F.lit(bytearray()))), F.lit(_byte_source(pattern, not no_overlap))).cast("bigint").alias("matches"))


def search_chunked(df: DataFrame, pattern: Exact | Mask, chunk: int = 1 << 20, key: str = "blob_id") -> DataFrame:
    """All, also overlapping, matches of blobs too large for one task: pieces that overlap by a pattern less one byte.

    Each match belongs to the piece in which it starts, so none is found twice.
    """
    width, n = len(pattern.data), octets.size(F.col("data"))
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(chunk).cast("bigint")))
    pieces = df.select(key, "data", F.explode(starts).alias("base")).select(key, "base", octets.cut(F.col("data"), F.col("base"), chunk + width - 1).alias("data"))
    named = pieces.repartition(key, "base").select(F.struct(key, "base").alias("piece"), "data")
    hits = search(named, pattern, key="piece").where(F.col("offset") < chunk)
    return hits.select(F.col(f"piece.{key}").alias(key), (F.col("piece.base") + F.col("offset")).alias("offset"))


def context_text(kind: str = "hex") -> Column:
    """Four lines for a row of search with context; the last has no line end but where nothing follows the match."""
    after = octets.display(F.col("after"), kind, 8, 0)
    return F.concat(
        F.lit("Match at "), octets.offset8(F.col("offset")), F.lit("\n"),
        F.when(octets.size(F.col("before")) > 0, F.concat(F.lit("Before: "), octets.display(F.col("before"), kind, 8, 0), F.lit("\n"))).otherwise(""),
        F.lit("Match:  "), octets.display(F.col("match"), kind, 8, 0), F.lit("\n"), F.when(octets.size(F.col("after")) > 0, F.concat(F.lit("After:  "), after)).otherwise(""),
    )
