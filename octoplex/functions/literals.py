"""Plan-time grammars: ranges, numbers, byte literals, masks and search patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass


class OctoplexError(ValueError):
    """Any mistake that is found while a plan is built."""


class ParseError(OctoplexError):
    pass


class InvalidRange(OctoplexError):
    pass


class InvalidChunkSize(OctoplexError):
    pass


class Unsupported(OctoplexError):
    pass


_HEX = re.compile(r"[0-9a-fA-F]")
END = 2**63 - 1


def number(text: str) -> int:
    """0x… is hex, and so is a leading zero followed by hex digits only; else decimal."""
    text = text.strip()
    try:
        if text[:2] in ("0x", "0X"):
            return int(text[2:], 16)
        if len(text) > 1 and text[0] == "0" and re.fullmatch(r"[0-9a-fA-F]+", text[1:]):
            return int(text, 16)
        if not text.isdigit():
            raise ValueError
        return int(text)
    except ValueError:
        raise ParseError(f"not a number: {text!r}") from None


def byte_range(text: str) -> tuple[int, int | None]:
    """a..b, a.., ..b, .. or n as a half-open range; None is an open end."""
    parts = text.strip().split("..")
    if len(parts) > 2:
        raise ParseError(f"too many '..': {text!r}")
    if len(parts) == 1:
        n = number(parts[0])
        return n, n + 1
    start = number(parts[0]) if parts[0].strip() else 0
    end = number(parts[1]) if parts[1].strip() else None
    if end is not None and start >= end:
        raise InvalidRange(f"start {start} is not before end {end}")
    return start, end


def ignore_ranges(text: str) -> list[tuple[int, int]]:
    """Comma-separated ranges. An open end takes a single byte."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        start, end = byte_range(part)
        found.append((start, start + 1 if end is None else end))
    return found


def byte_size(text: str) -> int:
    """64K, 128M, 2G or 5B, by 1024."""
    found = re.fullmatch(r"\s*(\d+)\s*([bBkKmMgG]?)\s*", text)
    if not found:
        raise ParseError(f"not a size: {text!r}")
    size = int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2].lower()]
    if size > END:
        raise ParseError(f"size too large: {text!r}")
    return size


def address(text: str) -> int:
    try:
        return int(text[2:], 16) if text.startswith("0x") else int(text)
    except ValueError:
        raise ParseError(f"not an address: {text!r}") from None


def byte_literal(text: str, kind: str) -> bytes:
    """Bytes written as hex, dec, oct, bin or ascii."""
    if kind == "ascii":
        return text.encode()
    if kind == "hex":
        digits = "".join(_HEX.findall(text))
        if len(digits) % 2:
            raise ParseError("odd number of hex digits")
        return bytes.fromhex(digits)
    base = {"dec": 10, "oct": 8, "bin": 2}.get(kind)
    if not base:
        raise ParseError(f"unknown format: {kind}")
    out = []
    for token in text.split():
        if base == 2 and len(token) > 8 or not re.fullmatch({10: r"\d+", 8: "[0-7]+", 2: "[01]+"}[base], token) or int(token, base) > 255:
            raise ParseError(f"not a byte: {token!r}")
        out.append(int(token, base))
    if not out:
        raise ParseError("no bytes given")
    return bytes(out)


def mask(text: str) -> tuple[int | None, ...]:
    """Hex pairs, with ?? or XX for any byte. Half wildcards are an error."""
    marks = [c for c in text if _HEX.match(c) or c in "?xX"]
    if not marks or len(marks) % 2:
        raise ParseError("a mask needs pairs of hex digits or wildcards")
    out: list[int | None] = []
    for a, b in zip(marks[::2], marks[1::2], strict=True):
        wild = [c in "?xX" for c in (a, b)]
        if all(wild):
            out.append(None)
        elif any(wild):
            raise ParseError(f"half a wildcard: {a}{b}")
        else:
            out.append(int(a + b, 16))
    return tuple(out)


def hex_regex(text: str) -> str:
    r"""A regex over hex pairs: pairs become \xHH, operators pass, white space goes."""
    out, at = [], 0

    def pair(at: int) -> str:
        if at + 1 >= len(text) or not _HEX.match(text[at + 1]):
            raise ParseError("half a hex pair in the pattern")
        return rf"\x{text[at : at + 2].upper()}"

    while at < len(text):
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] == "x":
            out.append(text[at : at + 4])
            at += 4
        elif c == "\\":
            out.append(text[at : at + 2])
            at += 2
        elif c == "{":
            end = text.find("}", at)
            if end < 0:
                raise ParseError("an open brace in the pattern")
            out.append(text[at : end + 1])
            at = end + 1
        elif c == "[":
            end = text.find("]", at)
            if end < 0:
                raise ParseError("an open class in the pattern")
            inner = re.sub(r"\\x[0-9a-fA-F]{2}|[0-9a-fA-F]{2}", lambda m: m[0] if m[0][0] == "\\" else rf"\x{m[0].upper()}", text[at + 1 : end])
            out.append(f"[{inner}]")
            at = end + 1
        elif _HEX.match(c):
            out.append(pair(at))
            at += 2
        elif c.isspace():
            at += 1
        elif c in ".*+?^$|()":
            out.append(c)
            at += 1
        else:
            raise ParseError(f"unexpected {c!r} in the pattern")
    return "".join(out)


@dataclass(frozen=True)
class Exact:
    data: bytes


@dataclass(frozen=True)
class Mask:
    data: tuple[int | None, ...]


@dataclass(frozen=True)
class Regex:
    """mode text: Unicode, on the text of the blob; mode bytes: each byte is one character."""

    source: str
    mode: str = "text"


Pattern = Exact | Mask | Regex


def pattern(text: str, kind: str) -> Pattern:
    if kind == "mask":
        return Mask(mask(text))
    if kind in ("regex", "hex-regex", "hexregex"):
        source = text if kind == "regex" else hex_regex(text)
        if re.search(r"\(\?<?[=!]|\\[1-9]|[*+?}]\+", source):
            raise ParseError("look-around, back references and possessive repeats are not supported")
        try:
            re.compile(source)
        except re.error as e:
            raise ParseError(f"invalid regex: {e}") from None
        return Regex(source, "text" if kind == "regex" else "bytes")
    data = byte_literal(text, kind)
    if not data:
        raise ParseError("an empty pattern")
    return Exact(data)


def pattern_warnings(text: str, kind: str) -> list[str]:
    """Advice on patterns that are valid but probably not what was meant."""
    out = []
    if kind == "hex" and re.search(r"[^0-9a-fA-F\s]", text):
        out.append("characters other than hex digits are dropped")
    if kind == "hex" and re.search(r"[.*+?\[\](){}|^$]", text):
        out.append("this looks like a regex; use the format regex or hex-regex")
    if kind == "ascii" and re.fullmatch(r"(?:[0-9a-fA-F]{2}\s*){2,}", text):
        out.append("this looks like hex; use the format hex")
    if kind == "regex" and re.search(r"\\x[89a-fA-F][0-9a-fA-F]", text):
        out.append(r"\xHH above 7F means a code point here; use hex-regex for bytes")
    if kind == "mask" and "?" not in text and "x" not in text.lower():
        out.append("a mask without wildcards; use the format hex")
    return out
