"""Text encodings, line ends and byte-order marks of blobs."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import octets
from ..functions.literals import Unsupported

NAMES = {
    "utf-8": "utf-8", "utf8": "utf-8", "utf-16le": "utf-16le", "utf16le": "utf-16le", "utf-16be": "utf-16be", "utf16be": "utf-16be",
    "windows-1252": "windows-1252", "cp1252": "windows-1252", "latin-1": "windows-1252", "latin1": "windows-1252", "iso-8859-1": "windows-1252",
}
BOMS = {"utf-8": b"\xef\xbb\xbf", "utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}
# Windows-1252 where it differs from ISO-8859-1: bytes 80 to 9F; the five unused ones stay control characters.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))
_CP1252 = "".join(bytes([c]).decode("cp1252", "replace").replace("�", chr(c)) for c in range(0x80, 0xA0))


def name_of(encoding: str) -> str:
    try:
        return NAMES[encoding.lower()]
    except KeyError:
        raise Unsupported(f"unknown encoding: {encoding}") from None


def detect_bom(b: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, mark in BOMS.items():
        out = F.when(F.startswith(b, octets.literal(mark)), name).otherwise(out)
    return out


def strip_bom(b: Column) -> Column:
    """Without a leading mark of any of the encodings."""
    found = detect_bom(b)
    return F.when(found == "utf-8", octets.cut(b, 3, octets.size(b))).when(found.isNotNull(), octets.cut(b, 2, octets.size(b))).otherwise(b)


_DECODED = StructType([StructField("text", StringType()), StructField("valid", BooleanType())])


def _utf16(encoding: str):
    """Text, and whether the bytes were valid, decoded a few values at a time, so that few are held as Python objects."""
    codec = encoding.replace("utf-16", "utf-16-")

    def one(value: bytes | None) -> tuple[str | None, bool | None]:
        if value is None:
            return None, None
        try:
            return value.decode(codec), True
        except UnicodeDecodeError:
            return value.decode(codec, "replace"), False

    @F.arrow_udf(_DECODED)
    def decode(data: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(len(data), 1), 64):
            made = [one(x.as_py()) for x in data.slice(start, 64)]
            parts.append(pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())], names=["text", "valid"]))
        return pa.concat_arrays(parts)

    return decode


def decode(b: Column, encoding: str, on_error: str = "replace", made: Column | None = None) -> tuple[Column, Column]:
    """Text, and whether the bytes were valid. replace writes U+FFFD, ignore takes it out again. made: UTF-16 decoded already."""
    if encoding == "windows-1252":
        return F.translate(octets.latin1(b), _C1, _CP1252), F.lit(True)
    if encoding == "utf-8":
        raw = b.cast("string")
        text, valid = F.make_valid_utf8(raw), F.is_valid_utf8(raw)
    else:
        made = _utf16(encoding)(b) if made is None else made
        text, valid = made["text"], made["valid"]
    if on_error == "ignore":
        text = F.when(valid, text).otherwise(F.replace(text, F.lit("�"), F.lit("")))
    return text, valid


def newlines(text: Column, style: str) -> Column:
    """unix, windows, mac or keep."""
    if style == "keep":
        return text
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    mark = {"unix": "\n", "windows": "\r\n", "mac": "\r"}.get(style)
    if not mark:
        raise Unsupported(f"unknown line ends: {style}")
    if style == "mac":
        return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\r")), F.lit("\n"), F.lit("\r"))
    return unix if style == "unix" else F.replace(unix, F.lit("\n"), F.lit(mark))


@F.pandas_udf(StringType())
def _char_refs(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x.translate(_Referenced()), na_action="ignore")


class _Referenced(dict):
    """Characters outside Windows-1252 as decimal references."""

    def __missing__(self, code: int):
        self[code] = code if code < 0x80 or 0xA0 <= code <= 0xFF or chr(code) in _CP1252 else f"&#{code};"
        return self[code]


def encode(text: Column, encoding: str) -> Column:
    if encoding == "windows-1252":
        outside = f"[^\\x00-\\x7F\\xA0-\\xFF{_CP1252}]"
        safe = F.when(text.rlike(outside), _char_refs(text)).otherwise(text)
        return F.encode(F.translate(safe, _CP1252, _C1), "ISO-8859-1")
    return F.encode(text, encoding.upper().replace("UTF-16LE", "UTF-16LE"))


def convert(df: DataFrame, source: str = "utf-8", target: str = "utf-8", line_ends: str = "keep", bom: str = "keep", on_error: str = "strict", fail_fast: bool = False) -> DataFrame:
    """data re-encoded: mark off, decoded, line ends, encoded, mark on.

    strict gives a null and an error for invalid bytes (or fails the query, with fail_fast) and for characters that the
    target lacks. bom: add, remove, or keep, which marks the target if the source was marked.
    """
    source, target = name_of(source), name_of(target)
    if bom not in ("add", "remove", "keep") or on_error not in ("strict", "replace", "ignore"):
        raise Unsupported(f"bom={bom}, on_error={on_error}")
    b = F.col("data")
    held = "_decoded"
    while held.lower() in map(str.lower, df.columns):
        held += "_"
    if source.startswith("utf-16"):  # a column of its own, so that it is decoded once
        df = df.withColumn(held, _utf16(source)(strip_bom(b)))
    text, valid = decode(strip_bom(b), source, on_error, F.col(held))
    text = newlines(text, line_ends)
    error = F.when(~valid, F.lit(f"invalid {source}")) if on_error == "strict" else F.lit(None).cast("string")
    if target == "windows-1252" and on_error == "strict":
        error = F.when(error.isNull() & text.rlike(f"[^\\x00-\\x7F\\xA0-\\xFF{_CP1252}]"), F.lit("a character is not in windows-1252")).otherwise(error)
    made = encode(text, target)
    mark = BOMS.get(target)
    if mark and bom != "remove":
        marked = F.concat(octets.literal(mark), made)
        made = marked if bom == "add" else F.when(detect_bom(b).isNotNull(), marked).otherwise(made)
    if fail_fast:
        return df.withColumn("data", F.when(error.isNull(), made).otherwise(F.raise_error(error))).drop(held)
    out = df.withColumn("error", error)
    return out.withColumn("data", F.when(F.col("error").isNull(), made)).drop(held)
