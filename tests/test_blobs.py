import random

import pytest
from pyspark.sql import functions as F

from octoplex.functions import literals, octets
from octoplex.operators import analyze, convert, diff, digest, edit, search, template
from octoplex.sources import blobs


def one(df):
    return df.collect()[0]


def offsets(spark, data, text, kind, **options):
    found = search.search(blobs.from_bytes(spark, data), literals.pattern(text, kind), **options)
    return sorted(r["offset"] for r in found.collect())


def test_literals():
    assert literals.byte_range("10..20") == (10, 20) and literals.byte_range("10..") == (10, None) and literals.byte_range("0x10..0x20") == (16, 32)
    assert literals.number("0100") == 256 and literals.number("09") == 9
    assert literals.byte_literal("DE AD be-ef", "hex") == bytes.fromhex("deadbeef")
    assert literals.hex_regex("7F.4C46") == r"\x7F.\x4C\x46"
    assert literals.ignore_ranges("1..3,7..") == [(1, 3), (7, 8)]
    assert literals.byte_size("64K") == 65536
    for bad in (lambda: literals.byte_literal("DEA", "hex"), lambda: literals.mask("F?"), lambda: literals.byte_range("1..2..3"), lambda: literals.hex_regex("DEA")):
        with pytest.raises(literals.OctoplexError):
            bad()


@pytest.mark.parametrize(
    ("data", "text", "kind", "options", "expected"),
    [
        ("DEADBEEFCAFE", "BEEF", "hex", {}, [2]), ("0001000200", "00", "hex", {}, [0, 2, 4]), ("00000000", "0000", "hex", {"no_overlap": True}, [0, 2]),
        ("00DEADBEEF00", "DE ?? BE ??", "mask", {}, [1]), ("AA00BB00CC00", "?? 00", "mask", {}, [0, 2, 4]), ("AA" * 12, "AAAAAA", "hex", {"no_overlap": True}, [0, 3, 6, 9]),
        ("AAAAAAAA", "AAAA", "hex", {}, [0, 1, 2]), ("AA", "?? 00", "mask", {}, []),
    ],
)
def test_search_vectors(spark, data, text, kind, options, expected):
    assert offsets(spark, bytes.fromhex(data), text, kind, **options) == expected


def test_search_matches_python_on_high_bytes(spark):
    rng = random.Random(5)
    needle = b"\xaa\xaa\xff"
    values = [bytes(rng.choice([0xAA, 0xAA, 0xFF]) for _ in range(rng.randrange(60))) for _ in range(40)]
    df = blobs.from_bytes(spark, *values)
    want = {(k, i) for k, v in enumerate(values) for i in range(len(v)) if v.startswith(needle, i)}
    assert {(r[0], r[1]) for r in search.search(df, literals.Exact(needle)).collect()} == want
    assert {(r[0], r[1]) for r in search.search_chunked(df, literals.Exact(needle), chunk=7).collect()} == want


def test_display(spark):
    df = blobs.from_bytes(spark, bytes.fromhex("DEADBEEF"))
    shown = lambda *a: one(df.select(octets.display(F.col("data"), *a)))[0]
    assert shown("hex", 8, 16) == "de ad be ef" and shown("hex", 16, 16) == "dead beef" and shown("dec", 8, 16) == "222 173 190 239"
    assert shown("bin", 8, 2) == "11011110 10101101\n10111110 11101111"


def test_edits_and_errors(spark):
    df = blobs.from_bytes(spark, b"\x80abc\xff")
    assert bytes(one(edit.write(df, 1, b"\xfe"))["data"]) == b"\x80\xfebc\xff"
    assert bytes(one(edit.insert(df, 5, b"!"))["data"]) == b"\x80abc\xff!"
    assert bytes(one(edit.remove(df, "1.."))["data"]) == b"\x80" and bytes(one(edit.remove(df, "1..", cli_compat=True))["data"]) == b"\x80bc\xff"
    failed = one(edit.write(df, 5, b"x"))
    assert failed["data"] is None and failed["error"]


def test_analysis(spark):
    df = blobs.from_bytes(spark, b"\x00" * 1000, b"\x00" * 500 + b"\xff" * 500, bytes(range(256)) * 100, b"")
    for make in (analyze.blocks, analyze.native_blocks):
        got = {r["blob_id"]: r for r in make(df).collect()}
        assert [round(got[k]["entropy"], 9) for k in range(4)] == [0, 1, 8, 0] and got[0]["ic"] == 1 and got[3]["size"] == 0
    assert [(r[0], r[1]) for r in analyze.histogram(blobs.from_bytes(spark, bytes.fromhex("0000000101FF"))).orderBy(F.desc("count"), "byte").collect()] == [(0, 3), (1, 2), (255, 1)]


def test_digests(spark):
    df = blobs.from_bytes(spark, b"hello", b"123456789")
    made = lambda k, *a: df.select(digest.digest(F.col("data"), *a)).collect()[k][0]
    assert made(0, "sha1") == "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d" and made(1, "crc32") == "cbf43926" and made(0, "xxh64") == "26c7827d889f6da3"
    assert made(0, "blake3") == "ea8f163db38682925e4491c5e58d4bb3506ef8c14eb78a86e908c5624a67200f" and made(0, "md5", "base64") == "XUFAKrxLKna5cZ2REBfFkg=="


def test_diff_then_patch_gives_the_other(spark):
    rng = random.Random(3)
    rows = [(k, bytearray(rng.choices(range(256), k=rng.randrange(40))), bytearray(rng.choices(range(256), k=rng.randrange(40)))) for k in range(20)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, a binary, b binary")
    whole = pairs.join(diff.grouped(diff.entries(pairs)), "pair_id", "left")
    for data, revert, want in (("a", False, 2), ("b", True, 1)):
        got = {r["pair_id"]: (r["data"], r["error"]) for r in diff.apply(whole, data=data, revert=revert).collect()}
        assert got == {r[0]: (r[want], None) for r in rows}


def test_hunks(spark):
    for places, expected in (([0, 1, 100], 2), ([0, 10, 20], 1), ([0, 50], 1), ([0, 500], 2)):
        found = spark.createDataFrame([(1, p) for p in places], "pair_id bigint, offset bigint")
        assert diff.hunks(found, 2).count() == expected


def test_convert(spark):
    df = blobs.from_bytes(spark, b"\xff\xfeA\x00\r\x00\n\x00")
    assert bytes(one(convert.convert(df, "utf-16le", "utf-8", "unix", "remove"))["data"]) == b"A\n"
    bad = blobs.from_bytes(spark, bytes.fromhex("48656CFF6F"))
    assert bytes(one(convert.convert(bad, on_error="ignore"))["data"]) == b"Helo" and one(convert.convert(bad))["error"]
    euro = blobs.from_bytes(spark, "€ŋ".encode())
    assert bytes(one(convert.convert(euro, target="latin-1", on_error="replace"))["data"]) == b"\x80&#331;"


def test_template(spark):
    t = template.load("{name: t, fields: [{name: n, type: u16}, {name: body, type: hex_string, size: $n}, {name: sum, type: computed, value: $n * 2 + -2 ** 2}, {name: x, type: u8, count: $n, offset: 2}]}")
    got = {r["name"]: r["value"] for r in template.parse(blobs.from_bytes(spark, bytes.fromhex("0400deadbeef")), t).collect()}
    assert got["body"] == "de ad be ef" and got["sum"] == "12" and got["x[3]"] == "239"
    assert template.parse(blobs.from_bytes(spark, b"\x04\x00"), t).collect()[0]["error"]
