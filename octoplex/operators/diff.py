"""Positional comparison of two blobs, and patches made of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..functions import kernels, octets
from ..functions.literals import ParseError, Unsupported, ignore_ranges


#: The two hex digits of each byte, and what a character counts as a hex digit; -1 for others.
_DIGITS = np.frombuffer("".join(f"{x:02x}" for x in range(256)).encode(), np.uint8).reshape(256, 2)
_VALUES = np.array([int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else -1 for c in range(256)], np.int16)


def _places(batch: pa.RecordBatch, ignored: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, offset, byte1, byte2) of the differences of pairs in columns 1 and 2, about kernels.ROWS at a time; -1 is past an end.

    Differences in the ignored ranges are left out.
    """
    (one, bounds1), (two, bounds2) = (kernels.buffer(batch.column(c)) for c in (1, 2))
    held, n = [], 0
    for k in range(batch.num_rows):
        sides = one[bounds1[k] : bounds1[k + 1]], two[bounds2[k] : bounds2[k + 1]]
        at = kernels.differences(*sides)
        for first, end in ignored:
            at = at[(at < first) | (at >= end)]
        for start in range(0, len(at), kernels.ROWS):
            part = at[start : start + kernels.ROWS]
            cells = []
            for side in sides:
                inside = int(np.searchsorted(part, len(side)))
                cells.append(np.concatenate((side[part[:inside]].astype(np.int16), np.full(len(part) - inside, -1, np.int16))))
            held.append((np.full(len(part), k), part, *cells))
            n += len(part)
            if n >= kernels.ROWS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _split(batches) -> Iterator[pa.RecordBatch]:
    return (piece for batch in batches for piece in kernels.pieces(batch, 1, 2))


def _ranges(ignore: str | list[tuple[int, int]]) -> list[tuple[int, int]]:
    return ignore_ranges(ignore) if isinstance(ignore, str) else ignore


def _entry_rows(ignored: list[tuple[int, int]], names: list[str]):
    def rows(batches):
        for batch in _split(batches):
            for row, at, *cells in _places(batch, ignored):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), *(pa.array(c.astype(np.int32), mask=c < 0) for c in cells)], names=names)

    return rows


def entries(pairs: DataFrame, ignore: str | list[tuple[int, int]] = "", key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """(key, offset, byte1, byte2) for each place at which two blobs differ; null is past an end. Ranges can be ignored.

    The blobs of a row are compared in place, by an Arrow kernel, so nothing is shuffled and no array of cells is made.
    A null blob is empty.
    """
    kept = pairs.select(key, left, right)
    schema = kept.select(key).schema.add("offset", "long").add("byte1", "integer").add("byte2", "integer")
    return kept.mapInArrow(_entry_rows(_ranges(ignore), schema.names), schema)


def _grid(form: str, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines as rows of characters, and which of these are there."""
    shape = "0x--------:--:--" if form == "patch" else "0x--------: 0x-- != 0x--"
    cells = np.tile(np.frombuffer(shape.encode(), np.uint8), (len(at), 1))
    there = np.ones(cells.shape, bool)
    low, high = int(at.min()), int(at.max())
    each = np.arange(low, high + 1) if high - low < len(at) else at
    shown = np.stack([_DIGITS[each >> shift & 255] for shift in (24, 16, 8, 0)], 1).reshape(-1, 8)
    cells[:, 2:10] = shown if each is at else shown[at - low]
    for side, place in ((one, 11), (two, 14)) if form == "patch" else ((one, 14), (two, 22)):
        cells[:, place : place + 2] = _DIGITS[side & 255]
        missing = np.flatnonzero(side < 0)
        if form == "patch":
            there[missing, place : place + 2] = False
        else:
            cells[missing, place - 2 : place + 1] = np.frombuffer(b"EOF", np.uint8)
            there[missing, place + 1] = False
    return cells, there


def _line_rows(form: str, ignored: list[tuple[int, int]], names: list[str]):
    if form not in ("patch", "simple"):
        raise Unsupported(f"unknown form: {form}")

    def rows(batches):
        for batch in _split(batches):
            for row, at, one, two in _places(batch, ignored):
                cells, there = _grid(form, at, one, two)
                ends = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(cells[there].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), text], names=names)

    return rows


def lines(pairs: DataFrame, form: str = "patch", ignore: str | list[tuple[int, int]] = "", key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """(key, offset, line): as patch_lines, or simple_lines (form simple), of entries, made where the pairs are."""
    kept = pairs.select(key, left, right)
    schema = kept.select(key).schema.add("offset", "long").add("line", "string")
    return kept.mapInArrow(_line_rows(form, _ranges(ignore), schema.names), schema)


def line_totals(pairs: DataFrame, form: str = "patch", ignore: str | list[tuple[int, int]] = "", key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """(key, total, places, first, last) of the lines of each pair: how many, the sum of their offsets, the least and the greatest.

    For the least and the greatest text Spark would sort all lines; here they are summed up where they are made.
    """
    kept = pairs.select(key, left, right)
    schema = kept.select(key).schema.add("total", "long").add("places", "long").add("first", "string").add("last", "string")
    made = _line_rows(form, _ranges(ignore), ["k", "offset", "line"])

    def rows(batches):
        for batch in made(batches):
            got = pa.Table.from_batches([batch]).group_by("k", use_threads=False).aggregate([("line", "count"), ("offset", "sum"), ("line", "min"), ("line", "max")])
            yield from got.select(["k", "line_count", "offset_sum", "line_min", "line_max"]).rename_columns(schema.names).to_batches()

    return kept.mapInArrow(rows, schema).groupBy(key).agg(F.sum("total").alias("total"), F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))


def kind(byte1: str = "byte1", byte2: str = "byte2") -> Column:
    return F.when(F.col(byte1).isNull(), "addition").when(F.col(byte2).isNull(), "deletion").otherwise("change")


def summary(found: DataFrame, key: str = "pair_id") -> DataFrame:
    k = kind()
    return found.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(k == n).alias(f"{n}s") for n in ("change", "addition", "deletion")])


def auto_format(total: Column, longest: Column) -> Column:
    ratio = total / F.greatest(longest, F.lit(1))
    return F.when((total == 0) | (ratio < 0.01), "simple").when(ratio < 0.5, "unified").otherwise("summary")


def assessment(percent: Column) -> Column:
    return (
        F.when(percent > 80, "completely different").when(percent > 50, "mostly different").when(percent > 10, "partly different")
        .when(percent > 0, "nearly equal").otherwise("equal")
    )


def _segments(key: np.ndarray, *breaks: np.ndarray) -> np.ndarray:
    """Where rows begin that no longer go with the row before: at another key, or where one of `breaks` (a row less) says so."""
    new = key[1:] != key[:-1]
    for x in breaks:
        new = new | x
    return np.flatnonzero(np.concatenate(([True], new)))


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal keys of a batch."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def hunks(found: DataFrame, context: int = 3, key: str = "pair_id") -> DataFrame:
    """(key, hunk, first, last, entries): neighbouring differences, by a gap that widens with what the hunk holds.

    The gap may be 64, or 2 context + 1; 128 once the hunk has over 20 differences, and 256 over 100. Differences that
    the smallest gap joins are made runs where they are, in each batch, so no difference is shuffled by itself; only
    runs are gone through in order, in one pass. The order of the differences does not matter.
    """
    return _hunks(found.select(key, "offset"), None, context, key)


def pair_hunks(pairs: DataFrame, context: int = 3, ignore: str | list[tuple[int, int]] = "", key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """As hunks of entries, with the runs made where the pairs are."""
    return _hunks(pairs.select(key, left, right), _entry_rows(_ranges(ignore), ["k", "offset", "byte1", "byte2"]), context, key)


def _hunks(held: DataFrame, made, context: int, key: str) -> DataFrame:
    near = max(2 * context + 1, 64)

    def runs(batches):
        for batch in made(batches) if made else batches:
            if not batch.num_rows:
                continue
            at = batch.column(1).to_numpy()
            gap = np.diff(at)
            start = _segments(_codes(batch.column(0)), gap < 0, gap > near)
            stop = np.append(start[1:], len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start)), pa.array(at[start]), pa.array(at[stop - 1]), pa.array(stop - start)], names=[key, "first", "last", "entries"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        out: list[list[int]] = []
        for first, last, entries in zip(*(table.column(c).to_pylist() for c in ("first", "last", "entries")), strict=True):
            if out and first - out[-1][1] <= max(near, 256 if out[-1][2] > 100 else 128 if out[-1][2] > 20 else 64):
                out[-1][1:] = [max(last, out[-1][1]), out[-1][2] + entries]
            else:
                out.append([first, last, entries])
        same = pa.chunked_array([table.column(key).combine_chunks().take(pa.array([0] * len(out), pa.int64()))])
        return pa.table([same, pa.array(range(len(out)), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=schema.names)

    schema = held.select(key).schema.add("hunk", "integer").add("first", "long").add("last", "long").add("entries", "long")
    kept = held.select(key).schema.add("first", "long").add("last", "long").add("entries", "long")
    return held.mapInArrow(runs, kept).groupBy(key).applyInArrow(joined, schema)


def _hex2(byte: str, missing: str) -> Column:
    return F.when(F.col(byte).isNull(), F.lit(missing)).otherwise(F.lpad(F.lower(F.hex(F.col(byte).cast("bigint"))), 2, "0"))


def simple_lines(found: DataFrame, key: str = "pair_id") -> DataFrame:
    side = lambda b: F.when(F.col(b).isNull(), "EOF").otherwise(F.concat(F.lit("0x"), _hex2(b, "")))
    return found.select(key, "offset", F.concat(octets.offset8(F.col("offset")), F.lit(": "), side("byte1"), F.lit(" != "), side("byte2")).alias("line"))


def patch_lines(found: DataFrame, key: str = "pair_id") -> DataFrame:
    return found.select(key, "offset", F.concat(octets.offset8(F.col("offset")), F.lit(":"), _hex2("byte1", ""), F.lit(":"), _hex2("byte2", "")).alias("line"))


def unified(pairs: DataFrame, made: DataFrame, context: int = 3, key: str = "pair_id", left: str = "a", right: str = "b", beside: bool = False, width: int = 16) -> DataFrame:
    """(key, hunk, text): each hunk with context, in lines of 16 bytes; `--` is past an end. beside: both in one line."""
    start = F.greatest(F.col("first") - context, F.lit(0).cast("bigint"))
    if beside:
        start = F.floor(start / width) * width
    end = F.least(F.col("last") + context + 1, F.greatest(octets.size(F.col(left)), octets.size(F.col(right))))
    rows = made.join(pairs, key).withColumn("_s", start.cast("bigint")).withColumn("_e", end)
    lines = F.sequence(F.col("_s"), F.greatest(F.col("_e") - 1, F.col("_s")), F.lit(width).cast("bigint"))

    def shown(b: str, s: Column) -> Column:
        count = F.least(F.lit(width).cast("bigint"), F.col("_e") - s)
        held = octets.display(octets.cut(F.col(b), s, count), "hex", 8, 0)
        return F.rtrim(F.rpad(F.concat_ws(" ", F.nullif(held, F.lit("")), F.lit("-- " * width)), (count * 3 - 1).cast("int"), F.lit(" ")))

    def line(s: Column) -> Column:
        a, b, where = shown(left, s), shown(right, s), F.concat(octets.offset8(s), F.lit(": "))
        if beside:
            return F.concat(where, F.rpad(a, 3 * width - 1, " "), F.when(a == b, " | ").otherwise(" ! "), b)
        return F.when(a == b, F.concat(F.lit(" "), where, a)).otherwise(F.concat(F.lit("-"), where, a, F.lit("\n+"), where, b))

    def span(b: str) -> Column:
        n = F.greatest(F.least(F.col("_e"), octets.size(F.col(b))) - F.col("_s"), F.lit(0).cast("bigint"))
        return F.concat(F.lit("0x"), F.lower(F.hex("_s")), F.lit(",0x"), F.lower(F.hex(n)))

    body = F.array_join(F.transform(lines, line), "\n")
    head = F.lit("") if beside else F.concat(F.lit("@@ -"), span(left), F.lit(" +"), span(right), F.lit(" @@\n"))
    return rows.select(key, "hunk", F.concat(head, body).alias("text"))


def parse_patch(lines: DataFrame, column: str = "value") -> DataFrame:
    """(position, offset, old, new, error) of lines OFFSET:OLD:NEW, all in hex; blank lines and # comments are skipped.

    Lines are numbered by the column `position` if there is one, else all by 0.
    """
    numbered = "position" in lines.columns
    listed = lines.select((F.col("position") if numbered else F.lit(0)).alias("position"), F.col(column).alias("_line"))
    return _parsed(listed.mapInArrow(_parse_rows, _parse_schema(listed.schema[0])))


def parse_pairs(pairs: DataFrame, ignore: str | list[tuple[int, int]] = "", key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """(position, offset, old, new, error): the patch lines of each pair are made and parsed again; position is the pair's key."""
    kept = pairs.select(key, left, right)
    made = _line_rows("patch", _ranges(ignore), ["k", "offset", "line"])
    schema = _parse_schema(kept.schema[0])

    def rows(batches):
        return _parse_rows(batch.select(["k", "line"]) for batch in made(batches))

    return _parsed(kept.mapInArrow(rows, schema))


def _parse_schema(position: StructField) -> StructType:
    return StructType([StructField("position", position.dataType), StructField("_line", StringType()), StructField("_at", LongType()), StructField("_old", BinaryType()), StructField("_new", BinaryType())])


def _parse_rows(batches) -> Iterator[pa.RecordBatch]:
    """Lines with what the plain ones hold; of these the text itself is left out."""
    for batch in batches:
        at, old, new = _plain_lines(batch.column(1))
        rest = pc.if_else(pc.is_null(at), batch.column(1), pa.scalar(None, batch.column(1).type))
        yield pa.RecordBatch.from_arrays([batch.column(0), rest, at, old, new], names=["position", "_line", "_at", "_old", "_new"])


def _parsed(listed: DataFrame) -> DataFrame:
    line, plain = F.trim(F.col("_line")), F.col("_at").isNotNull()
    kept = listed.where(plain | ((line != "") & ~line.startswith("#")))
    part = lambda k: F.trim(F.get(F.split(line, ":", 3), F.lit(k)))
    place, old, new = F.regexp_replace(part(0), "^0[xX]", ""), part(1), part(2)
    wrong = (
        F.when(plain, None).when(F.size(F.split(line, ":", 3)) != 3, "not OFFSET:OLD:NEW").when(~place.rlike("^[0-9a-fA-F]{1,15}$"), "bad offset")
        .when(~(old.rlike("^([0-9a-fA-F]{2})*$") & new.rlike("^([0-9a-fA-F]{2})*$")), "bad hex").when((old == "") & (new == ""), "both sides are empty")
    )
    other = lambda c, value: F.when(plain, F.col(c)).when(wrong.isNull(), value)
    return kept.select("position", other("_at", F.conv(place, 16, 10).cast("bigint")).alias("offset"), other("_old", F.unhex(old)).alias("old"), other("_new", F.unhex(new)).alias("new"), wrong.alias("error"))


def _plain_lines(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Offset, old and new of the lines that read as patch_lines writes them, 0x and eight digits and at most a byte a side; null for others."""
    data, bounds = kernels.buffer(column.cast(pa.binary()))
    start, size = bounds[:-1], np.diff(bounds)
    fits = (size == 16) | (size == 14)
    cells = np.concatenate((data, np.zeros(16, np.uint8)))[np.where(fits, start, len(data))[:, None] + np.arange(16)]
    digit = _VALUES[cells]
    colon = cells == ord(":")
    added = (size == 14) & colon[:, 11]
    byte = lambda k: np.where((digit[:, k] >= 0) & (digit[:, k + 1] >= 0), digit[:, k] * 16 + digit[:, k + 1], -1)
    old, new = np.where(added, 0, byte(11)), np.where(added, byte(12), np.where(size == 14, 0, byte(14)))
    at = np.zeros(len(size), np.int64)
    for k in range(2, 10):
        at = at * 16 + digit[:, k]
    good = fits & (cells[:, 0] == ord("0")) & ((cells[:, 1] | 32) == ord("x")) & (digit[:, 2:10] >= 0).all(1) & colon[:, 10] & (added | colon[:, 13]) & (old >= 0) & (new >= 0)

    def single(value: np.ndarray, none: np.ndarray) -> pa.Array:
        there = good & ~none
        ends = np.concatenate(([0], np.cumsum(there))).astype(np.int32)
        made = pa.BinaryArray.from_buffers(pa.binary(), len(value), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(value[there].astype(np.uint8).tobytes())])
        return pc.if_else(pa.array(good), made, pa.scalar(None, pa.binary()))

    return pa.array(at, mask=~good), single(old, added), single(new, (size == 14) & ~added)


_PATCH = ArrayType(StructType([StructField("offset", LongType()), StructField("old", BinaryType()), StructField("new", BinaryType())]))


def grouped(found: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, patch): a blob's differences as an array of (offset, old, new), in order; neighbours of a kind are one entry.

    Neighbours are joined where they are, in each batch, then by key. `patches` does the same to pairs without a shuffle.
    """

    def runs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(1).to_numpy()
            one, two = (pc.fill_null(batch.column(c), -1).to_numpy() for c in (2, 3))
            kinds = np.where(one < 0, 1, np.where(two < 0, 2, 0))
            start = _segments(_codes(batch.column(0)), np.diff(at) != 1, np.diff(kinds) != 0)
            sides = []
            for side in (one, two):
                ends = np.append(np.concatenate(([0], np.cumsum(side >= 0)))[start], (side >= 0).sum()).astype(np.int32)
                sides.append(pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(side[side >= 0].astype(np.uint8).tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start)), pa.array(at[start]), *sides], names=[key, "offset", "old", "new"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        out: list[tuple[int, list[bytes], list[bytes]]] = []
        end, last = -1, None
        for at, old, new in zip(*(table.column(c).to_pylist() for c in ("offset", "old", "new")), strict=True):
            if at != end or (not old, not new) != last:
                out.append((at, [], []))
            out[-1][1].append(old)
            out[-1][2].append(new)
            end, last = at + max(len(old), len(new)), (not old, not new)
        patch = pa.array([[{"offset": at, "old": b"".join(old), "new": b"".join(new)} for at, old, new in out]], pa.list_(pa.struct([("offset", pa.int64()), ("old", pa.binary()), ("new", pa.binary())])))
        return pa.table([table.column(key).combine_chunks()[:1], patch], names=schema.names)

    kept = found.select(key, "offset", "byte1", "byte2")
    parts = found.select(key).schema.add("offset", "long").add("old", "binary").add("new", "binary")
    schema = found.select(key).schema.add("patch", _PATCH)
    return kept.mapInArrow(runs, parts).groupBy(key).applyInArrow(joined, schema)


def patches(pairs: DataFrame, key: str = "pair_id", left: str = "a", right: str = "b") -> DataFrame:
    """(key, left, right, patch): pairs with what changes the left blob into the right one; as grouped, but in place.

    A null blob is empty, and equal blobs have an empty patch.
    """

    def rows(batches):
        for batch in _split(batches):
            sides = [kernels.buffer(batch.column(c)) for c in (1, 2)]
            row, first, stop, counts = [], [], [], []
            for k in range(batch.num_rows):
                a, b = (data[bounds[k] : bounds[k + 1]] for data, bounds in sides)
                n, m = min(len(a), len(b)), max(len(a), len(b))
                at = np.flatnonzero(a[:n] != b[:n])
                cuts = np.flatnonzero(np.diff(at) > 1)
                first += [at[:1], at[cuts + 1], [n] * (m > n)]
                stop += [at[cuts] + 1, at[-1:] + 1, [m] * (m > n)]
                counts.append((len(cuts) + 1) * bool(len(at)) + (m > n))
            row = np.repeat(np.arange(batch.num_rows), counts)
            first, stop = (np.concatenate(x).astype(np.int64) for x in (first, stop))
            values = []
            for held in sides:
                size = np.diff(held[1])[row]
                values.append(kernels.slices(held, row, np.minimum(first, size), np.minimum(stop, size)))
            listed = pa.StructArray.from_arrays([pa.array(first), *values], names=["offset", "old", "new"])
            bounds = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, listed)], names=schema.names)

    kept = pairs.select(key, left, right)
    schema = StructType([*kept.schema.fields, StructField("patch", _PATCH)])
    return kept.mapInArrow(rows, schema)


def reverted(patch: Column) -> Column:
    return F.transform(patch, lambda e: F.struct(e["offset"].alias("offset"), e["new"].alias("old"), e["old"].alias("new")))


def _judged(data: bytes, patch: list[tuple[int, bytes, bytes]]) -> list[str | None]:
    """A message, or None, for each entry, judged on the blob before any change.

    Additions are judged by where the blob will end by then, and so may follow one another.
    """
    out, n, added = [], len(data), 0
    for offset, old, new in patch:
        held = data[offset : offset + len(old)]
        if not old:
            out.append("Addition beyond end of file" if offset > n + added else None)
            added += len(new)
        elif offset >= n:
            out.append("Offset beyond end of file")
        elif offset + len(old) > n:
            out.append("Old bytes extend past end of file")
        else:
            out.append(None if held == old else f"Mismatch: expected {old.hex()}, found {held.hex()}")
    return out


def _patched(data: bytes, patch: list[tuple[int, bytes, bytes]]) -> tuple[bytes | None, str | None]:
    """The changed blob, or the first problem. Changes and additions ascend; deletions shorten the end, last first."""
    problem = next((m for m in _judged(data, patch) if m), None)
    if problem:
        return None, problem
    made = bytearray(data)
    for offset, old, new in sorted(e for e in patch if e[2]):
        made[offset : offset + len(old)] = new
    for offset, old, _ in sorted((e for e in patch if not e[2]), reverse=True):
        if offset + len(old) != len(made):
            return None, "deletion before the end"
        del made[offset:]
    return bytes(made), None


def _entries(value: pa.Scalar) -> list[tuple[int, bytes, bytes]]:
    return [(e["offset"], e["old"] or b"", e["new"] or b"") for e in value.as_py() or []]


def validate(blobs: DataFrame, key: str = "pair_id", data: str = "a", patch: str = "patch") -> DataFrame:
    """(key, offset, success, message) for each entry of each blob's patch. A null blob is empty."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                listed = _entries(batch.column(2)[k])
                found = _judged(batch.column(1)[k].as_py() or b"", listed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(found), pa.int64())), pa.array([e[0] for e in listed], pa.int64()), pa.array([m is None for m in found], pa.bool_()), pa.array([m or "ok" for m in found], pa.string())],
                    names=schema.names,
                )

    kept = blobs.select(key, data, patch)
    schema = kept.select(key).schema.add("offset", "long").add("success", "boolean").add("message", "string")
    return kept.mapInArrow(rows, schema)


def apply(blobs: DataFrame, key: str = "pair_id", data: str = "a", patch: str = "patch", revert: bool = False) -> DataFrame:
    """(key, data, error): the patched blob, or null and the first problem, all or nothing. A null blob stays null.

    Changes and additions are made in ascending order; deletions, which may only shorten the end, from the last on.
    """

    def rows(batches):
        for batch in (piece for batch in batches for piece in kernels.pieces(batch, 1)):
            made = []
            for k in range(batch.num_rows):
                listed, value = _entries(batch.column(2)[k]), batch.column(1)[k].as_py()
                listed = [(at, new, old) for at, old, new in listed] if revert else listed
                made.append((None, None) if value is None else _patched(value, listed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], names=schema.names)

    kept = blobs.select(key, data, patch)
    schema = kept.select(key).schema.add("data", "binary").add("error", "string")
    return kept.mapInArrow(rows, schema)


def summary_text(pairs: DataFrame, found: DataFrame, key: str = "pair_id", left: str = "a", right: str = "b", width: int = 50) -> DataFrame:
    """(key, text): sizes and their change, how many bytes differ, the assessment, and a bar of where they do.

    Each mark of the bar stands for an equal stretch of the longer blob: a blank without differences, then . : + # by
    quarters of the stretch.
    """
    n, m = octets.size(F.coalesce(left, F.lit(bytearray()))), octets.size(F.coalesce(right, F.lit(bytearray())))
    sizes = pairs.select(key, n.alias("_n"), m.alias("_m"), F.greatest(n, m, F.lit(1)).alias("_long"))
    step = F.ceil(F.col("_long") / width)
    cells = found.join(sizes, key).groupBy(key, F.floor(F.col("offset") / step).cast("int").alias("_cell")).agg((F.count("*") / F.first(step)).alias("_share"), F.count("*").alias("_count"))
    mark = F.when(F.col("_share") <= 0.25, ".").when(F.col("_share") <= 0.5, ":").when(F.col("_share") <= 0.75, "+").otherwise("#")
    bars = cells.groupBy(key).agg(F.sum("_count").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_cell", mark.alias("_mark")))).alias("_marks"))
    rows = sizes.join(bars, key, "left").withColumn("_total", F.coalesce("_total", F.lit(0)))
    used = F.ceil(F.col("_long") / step).cast("int")
    bar = F.array_join(F.transform(F.sequence(F.lit(0), used - 1), lambda k: F.coalesce(F.element_at("_marks", k), F.lit(" "))), "")
    percent = F.col("_total") * 100 / F.col("_long")
    return rows.select(
        key,
        F.concat(
            F.format_string("%d and %d bytes (%+d)\n", "_n", "_m", F.col("_m") - F.col("_n")), F.format_string("%d bytes differ (%.2f%%): ", "_total", percent),
            assessment(percent), F.lit("\n["), bar, F.lit("]"),
        ).alias("text"),
    )


def report(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def literal_patch(text: str) -> list[tuple[int, bytes, bytes]]:
    """A patch file read on the driver; mistakes raise."""
    out = []
    for k, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = line.split(":")
        if len(parts) != 3:
            raise ParseError(f"line {k}: not OFFSET:OLD:NEW")
        try:
            old, new = (bytes.fromhex(p.strip()) for p in parts[1:])
            out.append((int(parts[0].strip(), 16), old, new))
        except ValueError as e:
            raise ParseError(f"line {k}: {e}") from None
        if not old and not new:
            raise ParseError(f"line {k}: both sides are empty")
    return out
