"""The byte functions under SQL names: register(spark) once, then use them in spark.sql."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import analyze, digest
from . import kernels
from .literals import Regex, pattern


def _measure(which: int):
    @F.pandas_udf(DoubleType())
    def made(data: pd.Series) -> pd.Series:
        return data.map(lambda x: float(analyze._measures(np.bincount(np.frombuffer(bytes(x), np.uint8), minlength=256)[None])[which][0]), na_action="ignore")

    return made


class SearchBytes:
    """octo_search(data, pattern, format): a row (offset, match) for each place of a pattern; not for regular expressions."""

    def eval(self, data: bytes, text: str, kind: str):
        if data is not None:
            found = pattern(text, kind)
            if isinstance(found, Regex):
                raise ValueError("use octoplex.operators.search for regular expressions")
            width = len(found.data)
            for at in kernels.places(np.frombuffer(bytes(data), np.uint8), found.data).tolist():
                yield at, bytes(data[at : at + width])


class DiffBytes:
    """octo_diff(a, b): a row (offset, byte1, byte2) for each place at which two values differ."""

    def eval(self, a: bytes, b: bytes):
        a, b = bytes(a or b""), bytes(b or b"")
        for at in kernels.differences(a, b).tolist():
            yield at, a[at] if at < len(a) else None, b[at] if at < len(b) else None


def register(spark: SparkSession) -> list[str]:
    """Registers the functions of the session and returns their names."""
    scalar = {"octo_xxh64": digest.xxh64, "octo_blake3": digest.blake3, "octo_entropy": _measure(0), "octo_ic": _measure(1)}
    tables = {"octo_search": (SearchBytes, "offset: bigint, match: binary"), "octo_diff": (DiffBytes, "offset: bigint, byte1: int, byte2: int")}
    for name, made in scalar.items():
        spark.udf.register(name, made)
    for name, (made, schema) in tables.items():
        spark.udtf.register(name, F.udtf(made, returnType=schema))
    return [*scalar, *tables]
