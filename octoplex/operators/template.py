"""Structure templates: a YAML layout compiled, field by field, to columns over the blob. No Python runs on executors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import octets
from ..functions.literals import InvalidRange, ParseError, Unsupported

# The integer types by width and sign.
INTEGERS = {"u8": (8, False), "u16": (16, False), "u32": (32, False), "u64": (64, False), "i8": (8, True), "i16": (16, True), "i32": (32, True), "i64": (64, True)}
WIDE = "decimal(38,0)"
_TOKEN = re.compile(r"\s*(?:(0x[0-9a-fA-F]+|\d+)|\$(@?\w+(?:\.\w+)?)|(and|or|not)\b|(\*\*|&&|\|\||==|!=|<=|>=|[-+*/%<>()]))", re.I)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at:].strip()[:8]!r} in {text!r}")
        number, name, word, sign = m.groups()
        if number:
            out.append(("number", number))
        elif name:
            out.append(("name", name))
        else:
            out.append(("op", {"&&": "and", "||": "or"}.get((word or sign).lower(), (word or sign).lower())))
        at = m.end()
    return out


class Expression:
    """or < and < not < one comparison < + - < * / % < one ** < sign. Values are whole numbers; tests give 0 or 1.

    A division by zero gives null, and so does what is computed from a field that is not there.
    """

    def __init__(self, text: str, scope: dict[str, Column]):
        self.text, self.scope, self.left = text, scope, tokens(text)

    def column(self) -> Column:
        out = self._or()
        if self.left:
            raise ParseError(f"unexpected {self.left[0][1]!r} in {self.text!r}")
        return out

    def _take(self, *wanted: str) -> str | None:
        if self.left and self.left[0][0] == "op" and self.left[0][1] in wanted:
            return self.left.pop(0)[1]
        return None

    @staticmethod
    def _flag(test: Column) -> Column:
        return test.cast("int").cast(WIDE)

    def _or(self):
        out = self._and()
        while self._take("or"):
            out = self._flag((out != 0) | (self._and() != 0))
        return out

    def _and(self):
        out = self._not()
        while self._take("and"):
            out = self._flag((out != 0) & (self._not() != 0))
        return out

    def _not(self):
        return self._flag(self._not() == 0) if self._take("not") else self._compare()

    def _compare(self):
        out = self._sum()
        sign = self._take("==", "!=", "<=", ">=", "<", ">")
        if sign:
            other = self._sum()
            out = self._flag({"==": out == other, "!=": out != other, "<=": out <= other, ">=": out >= other, "<": out < other, ">": out > other}[sign])
        return out

    def _sum(self):
        out = self._product()
        while sign := self._take("+", "-"):
            other = self._product()
            out = (out + other if sign == "+" else out - other).cast(WIDE)
        return out

    def _product(self):
        out = self._power()
        while sign := self._take("*", "/", "%"):
            other = self._power()
            if sign == "*":
                out = (out * other).cast(WIDE)
            else:
                safe = F.nullif(other, F.lit(0).cast(WIDE))  # null, which gives the blob its error
                rest = (out % safe).cast(WIDE)
                out = rest if sign == "%" else ((out - rest) / safe).cast(WIDE)
        return out

    def _power(self):
        out = self._sign()
        if self._take("**"):
            if not self.left or self.left[0][0] != "number":
                raise Unsupported("an exponent that is not a plain number")
            exponent = int(self.left.pop(0)[1], 0)
            base, out = out, F.lit(1).cast(WIDE)
            for _ in range(exponent):
                out = (out * base).cast(WIDE)
        return out

    def _sign(self):
        if self._take("-"):
            return (-self._sign()).cast(WIDE)
        if self._take("+"):
            return self._sign()
        if self._take("("):
            out = self._or()
            if not self._take(")"):
                raise ParseError(f"an open parenthesis in {self.text!r}")
            return out
        if not self.left:
            raise ParseError(f"{self.text!r} ends too soon")
        kind, value = self.left.pop(0)
        if kind == "number":
            return F.lit(int(value, 16 if value.startswith("0x") else 10)).cast(WIDE)
        if kind == "name":
            if value not in self.scope:
                raise ParseError(f"unknown variable ${value}")
            return self.scope[value]
        raise ParseError(f"unexpected {value!r} in {self.text!r}")


@dataclass
class Bits:
    name: str
    start: int
    end: int  # inclusive
    enum: dict[str, str] = field(default_factory=dict)


@dataclass
class Field:
    name: str
    type: str
    offset: str | None = None
    size: str | None = None
    bit_offset: int | None = None
    bit_size: int | None = None
    expected: str | None = None
    enum: dict[str, str] = field(default_factory=dict)
    description: str = ""
    when: str | None = None
    count: str | None = None
    value: str | None = None
    element: Template | None = None
    bitfields: list[Bits] = field(default_factory=list)


@dataclass
class Template:
    name: str
    fields: list[Field]
    endian: str = "little"
    description: str = ""


def _bits(raw: dict) -> Bits:
    text = str(raw["bits"])
    start, _, end = text.partition("..")
    return Bits(raw["name"], int(start), int(end or start), raw.get("enum") or {})


def load(text: str) -> Template:
    """A template from YAML text. Scalars are read raw, so enum keys stay as they are written."""
    return _template(yaml.load(text, Loader=yaml.BaseLoader))


def _template(raw: dict) -> Template:
    fields = []
    for r in raw.get("fields") or []:
        element = r.get("element_template")
        fields.append(
            Field(
                r["name"], r.get("type", "u8"), r.get("offset"), r.get("size"), int(r["bit_offset"]) if "bit_offset" in r else None, int(r["bit_size"]) if "bit_size" in r else None,
                r.get("assert"), r.get("enum") or {}, r.get("description", ""), r.get("when"), r.get("count"), r.get("value"),
                _template(element) if isinstance(element, dict) else None, [_bits(b) for b in r.get("bitfields") or []],
            )
        )
    out = Template(raw.get("name", ""), fields, raw.get("endian", "little"), raw.get("description", ""))
    validate(out)
    return out


def validate(t: Template) -> None:
    names = [f.name for f in t.fields]
    if len(set(names)) < len(names):
        raise ParseError(f"repeated field names in {t.name}")
    if t.endian not in ("little", "big"):
        raise ParseError(f"unknown byte order: {t.endian}")
    for f in t.fields:
        if f.type not in INTEGERS and f.type not in ("hex_string", "string", "bytes", "computed"):
            raise ParseError(f"{f.name}: unknown type {f.type}")
        width = INTEGERS.get(f.type, (0, False))[0]
        if width and f.size and not f.size.startswith("$") and int(f.size, 0) * 8 != width:
            raise ParseError(f"{f.name}: size does not fit {f.type}")
        if f.bit_offset is not None and not 0 <= f.bit_offset <= 7:
            raise ParseError(f"{f.name}: bit_offset must be 0 to 7")
        if f.bit_size is not None and (not 1 <= f.bit_size <= 64 or not width or f.bit_size > width or f.count or f.value):
            raise ParseError(f"{f.name}: bit_size does not fit")
        if f.type == "computed" and not f.value:
            raise ParseError(f"{f.name}: a computed field needs a value")


def total_size(t: Template) -> int:
    """Where the literal fields end."""
    ends = [int(f.offset, 0) + (INTEGERS[f.type][0] // 8 if f.type in INTEGERS else int(f.size or "0", 0)) for f in t.fields if f.offset and not f.offset.startswith("$") and not (f.size or "").startswith("$")]
    return max(ends, default=0)


def describe(spark, t: Template) -> DataFrame:
    return spark.createDataFrame([(f.name, f.type, f.offset or "auto", f.size or "", f.description) for f in t.fields], "name string, type string, offset string, size string, description string")


def _amount(text: str | None, scope: dict[str, Column], what: str) -> Column | None:
    """A literal, or an expression that starts with $."""
    if text is None:
        return None
    text = text.strip()
    if text.startswith("$"):
        return Expression(text, scope).column().cast("bigint")  # checked per blob, by _wrong
    try:
        value = int(text, 0)
    except ValueError:
        raise ParseError(f"bad {what}: {text!r}") from None
    if value < 0:
        raise InvalidRange(f"negative {what}")
    return F.lit(value).cast("bigint")


def _wrong(f: Field, **amounts: Column) -> Column:
    """A message where an offset, size or count is negative or can't be computed."""
    found = [F.when(x.isNull(), F.lit(f"{f.name}: the {what} can't be computed")).when(x < 0, F.lit(f"{f.name}: negative {what}")) for what, x in amounts.items()]
    return F.coalesce(*found)


def _named(number: Column, enum: dict[str, str]) -> Column:
    shown = number.cast("string")
    if not enum:
        return shown
    known = F.element_at(F.create_map(*[F.lit(x) for pair in enum.items() for x in pair]), shown)
    return F.when(known.isNull(), shown).otherwise(F.concat(shown, F.lit(" ("), known, F.lit(")")))


def _bit_value(raw: Column, shift: int, size: int, big: bool, signed: bool) -> Column:
    """size bits from bit `shift`: from the highest bit on in big-endian order, from the lowest in little-endian."""
    if big:
        text = F.substring(octets.bits(raw), F.lit(shift + 1), F.lit(size))
    else:
        text = F.reverse(F.substring(F.reverse(octets.bits(octets.reversed_bytes(raw))), F.lit(shift + 1), F.lit(size)))
    value = F.conv(text, 2, 10).cast(WIDE)
    return F.when(value >= F.lit(str(2 ** (size - 1))).cast(WIDE), value - F.lit(str(2**size)).cast(WIDE)).otherwise(value).cast(WIDE) if signed else value


def _decoded(f: Field, b: Column, at: Column, size: Column, big: bool) -> tuple[Column, Column | None, Column]:
    """The shown value, the number if it is one, and the bytes read."""
    if f.type in INTEGERS:
        width, signed = INTEGERS[f.type]
        if f.bit_size is not None:
            shift = f.bit_offset or 0
            raw = octets.cut(b, at, -(-(shift + f.bit_size) // 8))
            number = _bit_value(raw, shift, f.bit_size, big, signed)
        else:
            raw = octets.cut(b, at, width // 8)
            number = (octets.signed(raw, width, not big) if signed else octets.unsigned(raw, not big, width // 8)).cast(WIDE)
        return _named(number, f.enum), number, raw
    raw = octets.cut(b, at, size)
    if f.type == "string":
        before_nul = F.split_part(octets.latin1(raw), F.lit("\x00"), F.lit(1))
        text = F.make_valid_utf8(F.encode(before_nul, "ISO-8859-1").cast("string"))
        return F.concat(F.lit('"'), text, F.lit('"')), None, raw
    return octets.display(raw, "hex", 8, 0), None, raw


def _width(f: Field, scope: dict[str, Column]) -> Column:
    if f.type in INTEGERS:
        bits = (f.bit_offset or 0) + f.bit_size if f.bit_size is not None else INTEGERS[f.type][0]
        return F.lit(-(-bits // 8)).cast("bigint")
    size = _amount(f.size, scope, "size")
    if size is None:
        raise ParseError(f"{f.name} needs a size")
    return size


def _parsed(name: str | Column, at: Column, size: Column, value: Column, number: Column | None, passed: Column | None, present: Column) -> Column:
    none = F.lit(None)
    entry = F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"), at.alias("offset"), size.cast("bigint").alias("size"), value.alias("value"),
        (number if number is not None else none).cast(WIDE).alias("number"), (passed if passed is not None else none).cast("boolean").alias("passed"),
    )
    return F.when(present, entry)


def parse(df: DataFrame, t: Template, fields: list[str] | None = None, key: str = "blob_id", base: int = 0) -> DataFrame:
    """(key, name, offset, size, value, number, passed, error, position): a row for each field of each blob, in order.

    Fields are compiled in order; each may refer to the numbers before it. All are evaluated whichever are asked for,
    and the others are pruned. A field past the end, a negative offset, size or count, or one that can't be computed gives
    the blob a single row with an error. Bit fields follow their parent as parent.name, elements as name[i] and
    name[i].part. After an array, what follows starts at its end. A null blob has no rows.
    """
    b, n = F.col("data"), octets.size(F.col("data"))
    rows = df.select(key, "data")
    scope: dict[str, Column] = {"@file_size": n.cast(WIDE), "@base": F.lit(base).cast(WIDE)}
    previous: Column = F.lit(0).cast("bigint")
    parts: list[Column] = []
    bad: list[Column] = []
    for k, f in enumerate(t.fields):
        names = {x: f"_f{k}_{x}" for x in ("at", "size", "number", "value", "raw", "here")}
        scope |= {"@prev_end": previous.cast(WIDE), "@current": previous.cast(WIDE)}
        here = Expression(f.when, scope).column() != 0 if f.when else F.lit(True)
        at = _amount(f.offset, scope, "offset")
        at = previous if at is None else at + base
        rows = rows.withColumn(names["here"], F.coalesce(here, F.lit(False))).withColumn(names["at"], at.cast("bigint"))
        here, at = F.col(names["here"]), F.col(names["at"])
        if f.type == "computed" or f.value:
            rows = rows.withColumn(names["number"], F.when(here, Expression(f.value, scope).column()))
            number = F.col(names["number"])
            bad.append(F.when(here & number.isNull(), F.lit(f"{f.name}: the value can't be computed")))
            parts.append(F.array(_parsed(f.name, at, F.lit(0), _named(number, f.enum), number, None, here)))
            scope[f.name] = number
            continue
        if f.count:
            made, end, wrong = _array(f, t, b, n, at, scope)
            rows = rows.withColumn(names["number"], F.when(here, wrong))
            bad.append(F.col(names["number"]))
            rows = rows.withColumn(names["value"], F.when(here & F.col(names["number"]).isNull(), made))
            parts.append(F.coalesce(F.col(names["value"]), F.expr("cast(array() as array<struct<name:string,offset:bigint,size:bigint,value:string,number:decimal(38,0),passed:boolean>>)")))
            rows = rows.withColumn(names["size"], F.when(here, end).otherwise(previous))
            previous = F.col(names["size"])
            continue
        rows = rows.withColumn(names["size"], _width(f, scope))
        size = F.col(names["size"])
        inside = here & (at >= 0) & (size >= 0) & (at + size <= n)
        value, number, raw = _decoded(f, b, at, size, t.endian == "big")
        rows = rows.withColumn(names["value"], F.when(inside, value))
        bad.append(F.when(here, F.coalesce(_wrong(f, offset=at, size=size), F.when(at + size > n, F.lit(f"{f.name} ends beyond the data")))))
        passed = None
        if f.expected is not None:
            digits = re.sub(r"0[xX]|\s", "", f.expected)
            passed = F.lit(False) if not re.fullmatch(r"(?:[0-9a-fA-F]{2})*", digits) else raw == octets.literal(bytes.fromhex(digits))
        if f.bit_size is not None:
            passed = None
        if number is not None:
            rows = rows.withColumn(names["number"], F.when(inside, number))
            scope[f.name] = number = F.col(names["number"])
        listed = [_parsed(f.name, at, size, F.col(names["value"]), number, passed, inside)]
        for bit in f.bitfields if number is not None else []:
            if bit.end >= (f.bit_size or INTEGERS[f.type][0]):
                continue
            cut, shown = _bit_field(number, bit)
            scope[f"{f.name}.{bit.name}"] = cut
            listed.append(_parsed(f"{f.name}.{bit.name}", at, size, shown, cut, None, inside))
        parts.append(F.array(*listed))
        rows = rows.withColumn(f"_f{k}_end", F.when(here, at + size).otherwise(previous))
        previous = F.col(f"_f{k}_end")
    error = F.coalesce(*bad) if bad else F.lit(None).cast("string")
    listed = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    failed = F.array(F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in (("name", "string"), ("offset", "bigint"), ("size", "bigint"), ("value", "string"), ("number", WIDE), ("passed", "boolean"))]))
    out = rows.withColumn("error", error).select(key, "error", F.posexplode(F.when(F.col("error").isNull(), listed).otherwise(failed)).alias("position", "p"))
    out = out.select(key, "p.*", "error", "position")
    if fields is not None:
        out = out.where(F.col("error").isNotNull() | F.col("name").isin(fields) | F.regexp_replace("name", r"[\[.].*$", "").isin(fields))
    return out


def _array(f: Field, t: Template, b: Column, n: Column, at: Column, scope: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The elements as parsed entries, where they end, and what is wrong with them.

    An element template has a fixed size, up to where its literal fields end; its fields are compiled in a scope of
    their own, with the element's place as @base and as the start of their offsets.
    """
    count = Expression(f.count, scope).column().cast("bigint")
    inner = f.element or Template("", [Field("", f.type, size=f.size, enum=f.enum)], t.endian)
    width = F.lit(total_size(f.element)).cast("bigint") if f.element else _width(inner.fields[0], scope)
    if f.element and not total_size(f.element):
        raise ParseError(f"{f.name}: the element template has no size")
    places = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    end = at + count * width
    wrong = F.coalesce(_wrong(f, offset=at, size=width, count=count), F.when(end > n, F.lit(f"{f.name} ends beyond the data")))

    def element(i: Column) -> Column:
        label = F.concat(F.lit(f"{f.name}["), i.cast("string"), F.lit("]" if not f.element else "]."))
        if not f.element:
            value, number, _ = _decoded(inner.fields[0], b, at + i * width, width, inner.endian == "big")
            return F.array(_parsed(label, at + i * width, width, value, number, None, F.lit(True)))
        return octets.let(at + i * width, lambda place: _nested(inner, b, n, place, scope, label))

    return F.flatten(F.transform(places, element)), end, wrong


def _nested(t: Template, b: Column, n: Column, base: Column, outer: dict[str, Column], label: Column) -> Column:
    """The entries of one element. Each field is bound once, and the next is compiled inside that binding."""

    def step(k: int, previous: Column, scope: dict[str, Column], parts: list[Column]) -> Column:
        if k == len(t.fields):
            return F.filter(F.concat(*parts), lambda x: x.isNotNull())
        f = t.fields[k]
        scope = scope | {"@prev_end": previous.cast(WIDE), "@current": previous.cast(WIDE), "@base": base.cast(WIDE)}
        here = F.coalesce(Expression(f.when, scope).column() != 0, F.lit(False)) if f.when else F.lit(True)
        at = _amount(f.offset, scope, "offset")
        at = previous if at is None else at + base
        name = F.concat(label, F.lit(f.name))
        if f.type == "computed" or f.value:
            bound = F.struct(here.alias("here"), at.alias("at"), F.when(here, Expression(f.value, scope).column()).alias("number"))
            return octets.let(bound, lambda x: step(k + 1, previous, scope | {f.name: x["number"]}, [*parts, F.array(_parsed(name, x["at"], F.lit(0), _named(x["number"], f.enum), x["number"], None, x["here"]))]))
        if f.count:
            raise Unsupported(f"{f.name}: an array inside an element")
        bound = F.struct(here.alias("here"), at.cast("bigint").alias("at"), _width(f, scope).alias("size"))

        def placed(x: Column) -> Column:
            inside = x["here"] & (x["at"] >= 0) & (x["size"] >= 0) & (x["at"] + x["size"] <= n)
            value, number, raw = _decoded(f, b, x["at"], x["size"], t.endian == "big")
            passed = raw == octets.literal(bytes.fromhex(re.sub(r"0[xX]|\s", "", f.expected))) if f.expected is not None and f.bit_size is None else None
            listed = [_parsed(name, x["at"], x["size"], value, number, passed, inside)]
            after = F.when(x["here"], x["at"] + x["size"]).otherwise(previous)
            names = {f.name: F.when(inside, number)} if number is not None else {}
            for bit in f.bitfields if number is not None else []:
                if bit.end < (f.bit_size or INTEGERS[f.type][0]):
                    cut, shown = _bit_field(number, bit)
                    names[f"{f.name}.{bit.name}"] = cut
                    listed.append(_parsed(F.concat(name, F.lit(f".{bit.name}")), x["at"], x["size"], shown, cut, None, inside))
            return step(k + 1, after, scope | names, [*parts, F.array(*listed)])

        return octets.let(bound, placed)

    return step(0, base, {k: v for k, v in outer.items() if k == "@file_size"}, [])


def _bit_field(number: Column, bit: Bits) -> tuple[Column, Column]:
    """The bits' number, and how it is shown: a single bit without names as true or false."""
    cut = F.pmod(F.floor(number / F.lit(str(2**bit.start)).cast(WIDE)).cast(WIDE), F.lit(str(2 ** (bit.end - bit.start + 1))).cast(WIDE)).cast(WIDE)
    return cut, F.when(cut == 1, "true").otherwise("false") if bit.start == bit.end and not bit.enum else _named(cut, bit.enum)


def wide(parsed: DataFrame, names: list[str], key: str = "blob_id") -> DataFrame:
    """A row for each blob with its fields' shown values as columns."""
    return parsed.groupBy(key).pivot("name", names).agg(F.first("value"))


def assertions(parsed: DataFrame, key: str = "blob_id") -> DataFrame:
    return parsed.groupBy(key).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def rendered(parsed: DataFrame, form: str = "json", key: str = "blob_id") -> DataFrame:
    """(key, text): a blob's fields as a JSON object, as YAML lines, or as a table with offsets and sizes.

    A failed assertion is marked; a blob with an error has its message only.
    """
    entry = F.struct("position", F.col("offset").alias("at"), "name", "size", "value", "number", "passed")
    grouped = parsed.groupBy(key).agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), entry))).alias("f"))
    if form == "json":
        body = F.to_json(F.map_from_entries(F.transform("f", lambda x: F.struct(x["name"], x["value"]))))
        failed = F.to_json(F.struct("error"))
    elif form == "yaml":
        line = lambda x: F.concat(x["name"], F.lit(": "), F.when(x["number"].isNotNull() | x["value"].startswith('"'), x["value"]).otherwise(F.concat(F.lit("'"), x["value"], F.lit("'"))))
        body = F.array_join(F.transform("f", line), "\n")
        failed = F.concat(F.lit("error: "), F.col("error"))
    elif form == "table":
        wide = F.greatest(F.lit(4), F.array_max(F.transform("f", lambda x: F.char_length(x["name"]))))
        mark = lambda x: F.when(x["passed"], " ok").when(~x["passed"], " FAILED").otherwise("")
        line = lambda x: F.concat(octets.offset8(x["at"]), F.lit("  "), F.lpad(x["size"].cast("string"), 5, " "), F.lit("  "), F.rpad(x["name"], wide, F.lit(" ")), F.lit("  "), x["value"], mark(x))
        body = F.array_join(F.transform("f", line), "\n")
        failed = F.concat(F.lit("error: "), F.col("error"))
    else:
        raise Unsupported(f"unknown form: {form}")
    return grouped.select(key, F.when(F.col("error").isNull(), body).otherwise(failed).alias("text"))
