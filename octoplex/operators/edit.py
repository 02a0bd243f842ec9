"""Byte ranges read and edited: projections of a blob column `data` that give a new one.

A range that does not fit a blob leaves data null and says why in `error`; with fail_fast the query fails instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import octets
from ..functions.literals import InvalidRange, byte_range


def guarded(df: DataFrame, made: Column, problem: Column, fail_fast: bool) -> DataFrame:
    """data becomes `made` where `problem` is null."""
    if fail_fast:
        return df.withColumn("data", F.when(problem.isNull(), made).otherwise(F.raise_error(problem)))
    return df.withColumn("error", problem).withColumn("data", F.when(F.col("error").isNull(), made))


def _outside(n: Column, start: int, end: int | None) -> Column:
    stop = F.lit(end) if end is not None else n
    return F.when((n <= start) | (stop > n) | (stop <= start), F.concat(F.lit(f"range {start}..{'' if end is None else end} does not fit "), n.cast("string"), F.lit(" bytes")))


def read(df: DataFrame, where: str = "..", fail_fast: bool = False) -> DataFrame:
    """The bytes of a range such as '4..0x10'. An empty blob has no range at all."""
    start, end = byte_range(where)
    n = octets.size(F.col("data"))
    return guarded(df, octets.cut(F.col("data"), start, (F.lit(end) if end is not None else n) - start), _outside(n, start, end), fail_fast)


def write(df: DataFrame, at: int, value: bytes, fail_fast: bool = False) -> DataFrame:
    """Overwrites bytes in place; the value must end within the blob."""
    n = octets.size(F.col("data"))
    problem = F.when(n < at + len(value), F.lit(f"{len(value)} bytes at {at} end beyond the blob"))
    return guarded(df, F.overlay("data", octets.literal(value), F.lit(at + 1)), problem, fail_fast)


def insert(df: DataFrame, at: int, value: bytes, fail_fast: bool = False) -> DataFrame:
    problem = F.when(octets.size(F.col("data")) < at, F.lit(f"position {at} is beyond the blob"))
    return guarded(df, F.overlay("data", octets.literal(value), F.lit(at + 1), F.lit(0)), problem, fail_fast)


def _span(where: str, cli_compat: bool) -> tuple[int, int | None]:
    start, end = byte_range(where)
    return start, start + 1 if end is None and cli_compat else end


def remove(df: DataFrame, where: str, fail_fast: bool = False, cli_compat: bool = False) -> DataFrame:
    """Takes a range out. With cli_compat an open end means one byte."""
    start, end = _span(where, cli_compat)
    n = octets.size(F.col("data"))
    rest = F.overlay("data", octets.literal(b""), F.lit(start + 1), ((F.lit(end) if end is not None else n) - start).cast("int"))
    return guarded(df, rest, _outside(n, start, end), fail_fast)


def replace(df: DataFrame, where: str, value: bytes, fail_fast: bool = False, cli_compat: bool = False) -> DataFrame:
    """Puts a value, of any length, in the place of a range."""
    start, end = _span(where, cli_compat)
    if end is not None and end <= start:
        raise InvalidRange(where)
    n = octets.size(F.col("data"))
    made = F.overlay("data", octets.literal(value), F.lit(start + 1), ((F.lit(end) if end is not None else n) - start).cast("int"))
    return guarded(df, made, _outside(n, start, end), fail_fast)


def chain(df: DataFrame, *steps) -> DataFrame:
    """Applies DataFrame functions in turn, as one lazy plan; a step that fails to plan names its number."""
    for k, step in enumerate(steps, 1):
        try:
            df = df.transform(step)
        except Exception as e:
            raise type(e)(f"step {k}: {e}") if isinstance(e, ValueError) else RuntimeError(f"step {k}: {e}") from e
    return df
