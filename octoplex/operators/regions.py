"""Address regions: parsing of memory maps, lookups and sparse reads over gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Addresses to a block: requests of up to a few blocks, and regions, are listed once for each that they cover.
BLOCK = 2**28
_LINE = r"^([0-9a-f]+)-([0-9a-f]+)\s+(\S+)\s+([0-9a-f]+)\s+(\S+)\s+(\d+)\s*(.*)$"


def parse_maps(lines: DataFrame, column: str = "value") -> DataFrame:
    """(start, end, perms, offset, dev, inode, path) of `start-end perms offset dev inode path` lines; others are skipped."""
    part = lambda k: F.regexp_extract(column, _LINE, k)
    wide = lambda k: F.conv(part(k), 16, 10).cast("decimal(20,0)")
    good = lines.where(F.col(column).rlike(_LINE))
    return good.select(wide(1).alias("start"), wide(2).alias("end"), part(3).alias("perms"), wide(4).alias("offset"), part(5).alias("dev"), part(6).cast("bigint").alias("inode"), F.nullif(F.trim(part(7)), F.lit("")).alias("path"))


def with_flags(regions: DataFrame) -> DataFrame:
    flag = lambda k, c: (F.substring("perms", k, 1) == c)
    return regions.withColumn("readable", flag(1, "r")).withColumn("writable", flag(2, "w")).withColumn("executable", flag(3, "x"))


def lookup(requests: DataFrame, regions: DataFrame, at: str = "address") -> DataFrame:
    """requests with the region that holds each address, or nulls.

    They are joined on address blocks: a region takes part in each block that it covers, an address in its own.
    """
    cells = regions.where("start < end").withColumn("_b", _blocks(F.col("start"), F.col("end")))
    hit = (_block(F.col(at)) == F.col("_b")) & (F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))
    return requests.join(cells, hit, "left").drop("_b")


def _block(address) -> Column:
    return F.floor(address / F.lit(BLOCK)).cast("bigint")


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(_block(start), _block(end - 1)))


def check_bounds(requests: DataFrame, regions: DataFrame, flag: str = "readable", key: str = "request_id") -> DataFrame:
    """(key, problem): why a request [start, end) can't be served, or null: no region, no permission, or past its end."""
    held = lookup(requests.select(key, F.col("start").alias("_at"), F.col("end").alias("_to")), with_flags(regions).select("start", "end", flag), "_at")
    problem = (
        F.when(F.col("start").isNull(), "no region at the address").when(~F.col(flag), f"the region is not {flag}").when(F.col("_to") > F.col("end"), "past the end of the region")
    )
    return held.select(key, problem.alias("problem"))


def sparse_read(requests: DataFrame, regions: DataFrame, fill: str = "error", key: str = "request_id") -> DataFrame:
    """(key, start, end, kind) pieces of each request [start, end): data, or zeros for a gap with fill `zero`.

    Gaps are left out with fill `skip`; with `error` a request that has any is one row of kind `error`. Only readable
    regions count.
    """
    if fill not in ("error", "zero", "skip"):
        raise ValueError(fill)
    r, q = with_flags(regions).where("readable").select(F.col("start").alias("rs"), F.col("end").alias("re")), requests.select(key, F.col("start").alias("qs"), F.col("end").alias("qe"))
    # Requests and regions meet by the blocks that both cover; a pair counts in the first of these only.
    asked = q.where("qs < qe").withColumn("_b", _blocks(F.col("qs"), F.col("qe")))
    cells = r.where("rs < re").withColumn("_b", _blocks(F.col("rs"), F.col("re")))
    data = asked.join(cells, "_b").where((F.col("rs") < F.col("qe")) & (F.col("re") > F.col("qs")) & (F.col("_b") == F.greatest(_block(F.col("rs")), _block(F.col("qs")))))
    data = data.select(key, "qs", "qe", F.greatest("rs", "qs").alias("s"), F.least("re", "qe").alias("e"))
    order = Window.partitionBy(key).orderBy("s")
    known = data.where(F.col("s") < F.col("e")).withColumn("next", F.coalesce(F.lead("s").over(order), F.col("qe"))).withColumn("row", F.row_number().over(order))
    pieces = known.select(key, F.col("s").alias("start"), F.col("e").alias("end"), F.lit("data").alias("kind"))
    after = known.where(F.col("e") < F.col("next")).select(key, F.col("e").alias("start"), F.col("next").alias("end"), F.lit("zeros").alias("kind"))
    before = known.where((F.col("row") == 1) & (F.col("qs") < F.col("s"))).select(key, F.col("qs").alias("start"), F.col("s").alias("end"), F.lit("zeros").alias("kind"))
    none = q.join(known.select(key).distinct(), key, "left_anti").select(key, F.col("qs").alias("start"), F.col("qe").alias("end"), F.lit("zeros").alias("kind"))
    gaps = after.union(before).union(none)
    if fill == "skip":
        return pieces
    if fill == "zero":
        return pieces.union(gaps)
    failed = gaps.select(key).distinct()
    return pieces.join(failed, key, "left_anti").union(q.join(failed, key, "left_semi").select(key, F.col("qs").alias("start"), F.col("qe").alias("end"), F.lit("error").alias("kind")))


def formatted(regions: DataFrame) -> DataFrame:
    wide = lambda c: F.lpad(F.lower(F.conv(F.col(c).cast("string"), 10, 16)), 16, "0")
    return regions.select(F.concat(F.lit("0x"), wide("start"), F.lit("-0x"), wide("end"), F.lit(" "), F.col("perms"), F.lit(" "), F.coalesce("path", F.lit("[anonymous]"))).alias("line"))
