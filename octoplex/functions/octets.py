"""Column builders for BINARY values that stay in the JVM. `reverse`, `instr`, `right` and `repeat` are not byte-safe there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import InvalidChunkSize, Unsupported


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def literal(data: bytes) -> Column:
    return F.lit(bytearray(data))


def size(b: Column) -> Column:
    return F.octet_length(b).cast("bigint")


def cut(b: Column, start, count) -> Column:
    """count bytes from start (0-based)."""
    start = F.lit(start) if isinstance(start, int) else start
    count = F.lit(count) if isinstance(count, int) else count
    return F.substring(b, (start + 1).cast("int"), count.cast("int"))


def pairs(b: Column) -> Column:
    """Lower-case hex pairs of the bytes, in order."""
    return F.regexp_extract_all(F.lower(F.hex(b)), F.lit(".."), F.lit(0))


def values(b: Column) -> Column:
    """The bytes as integers from 0 to 255."""
    return F.transform(pairs(b), lambda x: F.conv(x, 16, 10).cast("int"))


def reversed_bytes(b: Column, width: int | None = None) -> Column:
    """With a width, that of `b` at most, byte by byte: far cheaper than by hex text."""
    if width is not None:
        return F.concat(*[F.substring(b, k, 1) for k in range(width, 0, -1)])
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))), ""))


def latin1(b: Column) -> Column:
    """A character for each byte; exact both ways."""
    return F.decode(b, "ISO-8859-1")


def bits(b: Column) -> Column:
    """'0101…', eight characters for each byte, the highest bit first."""
    return F.array_join(F.transform(values(b), lambda v: F.lpad(F.bin(v), 8, "0")), "")


def _rendered(piece: Column, count: Column, kind: str) -> Column:
    """A chunk, given as up to 64 bits in text, in the format."""
    if kind == "bin":
        return piece
    if kind == "hex":
        return F.lpad(F.lower(F.conv(piece, 2, 16)), F.ceil(count / 4).cast("int"), F.lit("0"))
    return F.conv(piece, 2, {"dec": 10, "oct": 8}[kind])


def display(b: Column, kind: str = "hex", chunk: int = 8, width: int = 16) -> Column:
    """Chunks of bits in hex, dec, oct, bin or ascii, `width` to a line (0: one line). An empty blob gives ''.

    A chunk of over 64 bits reads as zero, and the last, shorter chunk is not shifted.
    """
    if chunk <= 0:
        raise InvalidChunkSize("chunks have one bit at least")
    if kind == "ascii":
        if chunk != 8:
            raise Unsupported("ascii shows chunks of 8 bits")
        text = F.regexp_replace(latin1(b), r"[^\x20-\x7E]", ".")
        return text if not width else F.array_join(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), "\n")
    if kind not in ("hex", "dec", "oct", "bin"):
        raise Unsupported(f"unknown format: {kind}")
    if chunk == 8 and kind == "hex":
        # By two passes over the text: a blank between pairs, then a line end for each blank after `width` pairs.
        text = F.regexp_replace(F.lower(F.hex(b)), "(..)(?=.)", "$1 ")
        return F.regexp_replace(text, f"((?:.. ){{{width - 1}}}..) ", "$1\n") if width else text
    if chunk == 8 and kind == "dec":
        cells = F.transform(values(b), lambda v: v.cast("string"))
    else:
        n = size(b) * 8
        starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(chunk).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))

        def cut_bits(held: Column) -> Column:
            def cell(s: Column) -> Column:
                count = F.least(F.lit(chunk).cast("bigint"), n - s)
                piece = F.when(count > 64, F.lit("0")).otherwise(F.substring(held, (s + 1).cast("int"), count.cast("int")))
                return _rendered(piece, count, kind)

            return F.transform(starts, cell)

        # By bytes no bit string is needed.
        cells = F.transform(pairs(b), lambda x: _rendered(F.lpad(F.conv(x, 16, 2), 8, "0"), F.lit(8), kind)) if chunk == 8 else let(bits(b), cut_bits)
    if not width:
        return F.array_join(cells, " ")

    def lined(c: Column) -> Column:
        starts = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1, F.lit(width))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.array_join(F.transform(starts, lambda s: F.array_join(F.slice(c, s + 1, F.lit(width)), " ")), "\n")

    return let(cells, lined)


def offset_text(offset: Column, last: Column) -> Column:
    """0x and 4, 8 or 16 digits, by how large `last` is."""
    digits = F.lower(F.hex(offset))
    return F.concat(F.lit("0x"), F.when(last > 0xFFFFFFFF, F.lpad(digits, 16, "0")).when(last > 0xFFFF, F.lpad(digits, 8, "0")).otherwise(F.lpad(digits, 4, "0")))


def offset8(offset: Column) -> Column:
    digits = F.lower(F.hex(offset))
    return F.concat(F.lit("0x"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def dump_lines(b: Column, kind: str = "hex", chunk: int = 8, width: int = 16, base: int = 0) -> Column:
    """ARRAY<STRUCT<offset, line>>: a line of `width` chunks each; in hex by bytes with the text beside it, padded."""
    width = width or 16
    step = -(-width * chunk // 8)
    n = size(b)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(step).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def line(s: Column) -> Column:
        part = cut(b, s, step)
        shown = display(part, kind, chunk, 0)
        if kind == "hex" and chunk == 8:
            shown = F.concat(F.rpad(shown, 3 * width - 1, " "), F.lit("  |"), display(part, "ascii", 8, 0), F.lit("|"))
        return F.struct((s + base).alias("offset"), F.concat(offset_text(s + base, n + base), F.lit(": "), shown).alias("line"))

    return F.transform(starts, line)


def match_line(offset: Column, data: Column, kind: str = "hex") -> Column:
    return F.concat(offset8(offset), F.lit(": "), display(data, kind, 8, 0))


def unsigned(b: Column, little: bool, width: int | None = None) -> Column:
    """Up to 8 bytes, or `width`, as an unsigned number, DECIMAL(20,0)."""
    return F.conv(F.hex(reversed_bytes(b, width) if little else b), 16, 10).cast("decimal(20,0)")


def signed(b: Column, width: int, little: bool) -> Column:
    value = unsigned(b, little, width // 8)
    half, whole = (F.lit(str(2**k)).cast("decimal(20,0)") for k in (width - 1, width))  # 2**63 is no BIGINT
    return F.when(value >= half, value - whole).otherwise(value).cast("bigint")
