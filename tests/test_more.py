import hashlib
import io
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from octoplex.functions import kernels, literals, octets, sql
from octoplex.operators import analyze, convert, diff, digest, regions, search, template
from octoplex.sources import blobs
from octoplex.streaming import blobs as streams
from octoplex.streaming import progress


def found(spark, data, text, kind, **options):
    got = search.search(blobs.from_bytes(spark, data), literals.pattern(text, kind), **options).collect()
    return [(r["offset"], bytes(r["match"])) for r in got]


def test_regexes_that_match_nothing_at_all(spark):
    assert found(spark, b"baaac", "a*", "regex") == [(0, b""), (1, b"aaa"), (5, b"")]
    assert found(spark, b"baaac", r"\bx?", "regex") == [(0, b""), (5, b"")]
    assert found(spark, b"ab", "$|a", "regex") == [(0, b"a"), (2, b"")]
    assert found(spark, "éaé".encode(), "a|$", "regex") == [(2, b"a"), (5, b"")]
    assert found(spark, b"\xffa\xff", "a", "regex") == [(1, b"a")]
    assert found(spark, b"ABCDEF_ABXYZ", "AB.", "regex") == [(0, b"ABC"), (7, b"ABX")]
    assert found(spark, b"\x7fELF\x7fEL", "7F.4C", "hex-regex") == [(0, b"\x7fEL"), (4, b"\x7fEL")]
    assert found(spark, b"aXbX", "X", "regex", find_all=False) == [(1, b"X")]


def test_search_takes_time_in_proportion(spark):
    df = blobs.from_bytes(spark, b"ab" * 500_000, b"\x00" * 300_000)
    search.search(blobs.from_bytes(spark, b"ab"), literals.Exact(b"ab")).count()
    began = time.time()
    assert search.search(df, literals.Exact(b"ab")).count() == 500_000
    assert search.search(df, literals.pattern("?? 00", "mask"), no_overlap=True).count() == 150_000
    assert search.search(df, literals.Regex("b")).count() == 500_000
    assert search.count(df, literals.Exact(b"\x00\x00")).agg(F.sum("matches")).first()[0] == 299_999
    assert time.time() - began < 20


def test_first_match_and_context(spark):
    data = b"\x80needle\n needle\xff"
    assert found(spark, data, "needle", "ascii", find_all=False) == [(1, b"needle")]
    assert found(spark, data, "6E ?? 65", "mask", find_all=False, context=1) == [(1, b"nee")]
    rows = search.search(blobs.from_bytes(spark, data), literals.Exact(b"needle"), context=2)
    text = rows.orderBy("offset").select(search.context_text("ascii").alias("t")).collect()
    assert text[0]["t"] == "Match at 0x00000001\nBefore: .\nMatch:  needle\nAfter:  . " and text[1]["t"].endswith("After:  .")
    assert literals.pattern_warnings("DE?AD", "hex") and literals.pattern_warnings("41 42", "ascii") and not literals.pattern_warnings("4142", "hex")


def test_kernels():
    rng = random.Random(1)
    for _ in range(200):
        data, want = bytes(rng.choices(b"ab", k=rng.randrange(30))), tuple(rng.choice((97, 98, None)) for _ in range(rng.randrange(1, 4)))
        import numpy as np

        at = kernels.places(np.frombuffer(data, np.uint8), want).tolist()
        assert at == [i for i in range(len(data) - len(want) + 1) if all(w is None or data[i + k] == w for k, w in enumerate(want))]
        out, free = [], 0
        for p in at:
            if p >= free:
                out, free = [*out, p], p + len(want)
        assert kernels.greedy(np.array(at, np.int64), len(want)).tolist() == out


def test_display_forms(spark):
    df = blobs.from_bytes(spark, bytes(range(20)), b"", b"\xde\xad")
    shown = lambda *a: [r[0] for r in df.select(octets.display(F.col("data"), *a)).collect()]
    whole = bytes(range(20))
    assert shown("hex", 8, 16) == [whole[:16].hex(" ") + "\n" + whole[16:].hex(" "), "", "de ad"]
    assert shown("hex", 8, 1)[2] == "de\nad" and shown("hex", 8, 0)[0] == whole.hex(" ")
    assert shown("oct", 8, 16)[2] == "336 255" and shown("dec", 16, 16)[2] == "57005" and shown("bin", 4, 3)[2] == "1101 1110 1010\n1101" and shown("hex", 12, 16)[2] == "dea d"
    line = df.select(octets.match_line(F.lit(2).cast("bigint"), F.col("data")).alias("x")).collect()[2]["x"]
    assert line == "0x00000002: de ad"


def test_digests_of_several_chunks(spark):
    sizes = (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000)
    values = [bytes(i % 251 for i in range(n)) for n in sizes]
    got = digest.blake3_all(values)
    assert got == [digest.blake3_all([v])[0] for v in values]
    # Published vectors.
    assert got[0].startswith("af1349b9f5f9a1a6") and got[7].startswith("d00278ae47eb27b3") and got[8].startswith("e776b6028c7cd22a") and got[9].startswith("5f4d72f40d7a5f82") and got[10].startswith("b98cb0ff3623be03")
    df = blobs.from_bytes(spark, *values).unionByName(spark.createDataFrame([(99, None)], "blob_id bigint, data binary"))
    rows = {r["blob_id"]: r["d"] for r in df.select("blob_id", digest.digest(F.col("data"), "blake3-256").alias("d")).collect()}
    assert rows == dict(enumerate(got)) | {99: None}


def test_hunks_match_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(p, o) for p in range(6) for o in sorted(rng.sample(range(30_000 if p % 2 else 9_000), 300))]
    want = []
    for p in range(6):
        groups: list[list[int]] = []
        for o in (o for q, o in rows if q == p):
            n = len(groups[-1]) if groups else 0
            if groups and o - groups[-1][-1] <= (256 if n > 100 else 128 if n > 20 else 64):
                groups[-1].append(o)
            else:
                groups.append([o])
        want += [(p, k, g[0], g[-1], len(g)) for k, g in enumerate(groups)]
    made = diff.hunks(spark.createDataFrame(rows, "pair_id bigint, offset bigint"), 2)
    assert sorted(map(tuple, made.collect())) == want


def test_diff_texts(spark):
    a = bytes(range(64))
    pairs = spark.createDataFrame([(1, bytearray(a), bytearray(a[:5] + b"\xff" + a[6:] + b"\x01\x02"))], "pair_id bigint, a binary, b binary")
    entries = diff.entries(pairs)
    assert sorted(r["line"] for r in diff.simple_lines(entries).collect()) == ["0x00000005: 0x05 != 0xff", "0x00000040: EOF != 0x01", "0x00000041: EOF != 0x02"]
    made = diff.hunks(entries)
    unified = diff.unified(pairs, made, context=1).collect()
    assert len(unified) == 1 and unified[0]["text"].startswith("@@ -0x4,0x3c +0x4,0x3e @@\n") and "-0x00000004: 04 05 06" in unified[0]["text"] and "+0x00000004: 04 ff 06" in unified[0]["text"]
    beside = diff.unified(pairs, made, context=1, beside=True).collect()[0]["text"]
    assert " ! " in beside.split("\n")[0] and " | " in beside.split("\n")[1]
    text = diff.summary_text(pairs, entries).collect()[0]["text"]
    assert text.startswith("64 and 66 bytes (+2)\n3 bytes differ (4.55%): nearly equal\n[") and text.endswith("#]")
    assert pairs.select(diff.auto_format(F.lit(3), F.lit(66))).first()[0] == "unified"


def test_patch_files(spark):
    lines = spark.createDataFrame([("# head",), ("",), ("0x0:de:ff",), ("3:ef:",), ("zz:00:01",), ("1:0:1",), ("2::",), ("1",)], "value string")
    got = [(r["offset"], r["old"] and bytes(r["old"]), r["error"]) for r in diff.parse_patch(lines).collect()]
    assert got == [(0, b"\xde", None), (3, b"\xef", None), (None, None, "bad offset"), (None, None, "bad hex"), (None, None, "both sides are empty"), (None, None, "not OFFSET:OLD:NEW")]
    patch = lambda *e: [{"offset": o, "old": bytearray(x), "new": bytearray(y)} for o, x, y in e]
    data = bytearray.fromhex("deadbeef")
    rows = [(1, data, patch((0, b"\xde", b"\x00"), (3, b"\xef", b"\xff"))), (2, data, patch((0, b"\x00", b"\x01"))), (3, data, patch((100, b"\x00", b"\x01"))), (4, data, patch((4, b"", b"\x01"), (5, b"", b"\x02"))), (5, data, patch((2, b"\xbe\xef", b""))), (6, data, patch((1, b"\xad", b""))), (7, None, patch())]
    df = spark.createDataFrame(rows, "pair_id bigint, a binary, patch array<struct<offset:bigint,old:binary,new:binary>>")
    made = {r["pair_id"]: (r["data"] and bytes(r["data"]).hex(), r["error"]) for r in diff.apply(df).collect()}
    assert made[1] == ("00adbeff", None) and made[2][1].startswith("Mismatch") and "beyond" in made[3][1] and made[4] == ("deadbeef0102", None) and made[5] == ("dead", None) and made[6] == (None, "deletion before the end") and made[7] == (None, None)
    judged = diff.validate(df).collect()
    report = diff.report(diff.validate(df)).first()
    assert len(judged) == 8 and (report["succeeded"], report["failed"]) == (6, 2)
    assert diff.literal_patch("# x\n0:de:ff\n") == [(0, b"\xde", b"\xff")]


def test_regions(spark):
    maps = spark.createDataFrame([("00001000-00003000 r-xp 00000000 08:01 7 /bin/a",), ("00003000-00004000 -w-p 00000000 00:00 0",), ("7f0000000000-7f0040000000 r--p 00000000 08:01 9 /lib/b",), ("junk",)], "value string")
    known = regions.parse_maps(maps)
    asked = spark.createDataFrame([(1, 0x1000, 0x2000), (2, 0x2800, 0x3800), (3, 0x10, 0x20), (4, 0x7F0000000000, 0x7F0030000000), (5, 0x0800, 0x1800)], "request_id int, start bigint, end bigint")
    asked = asked.select("request_id", *[F.col(c).cast("decimal(20,0)").alias(c) for c in ("start", "end")])
    problems = {r["request_id"]: r["problem"] for r in regions.check_bounds(asked, known).collect()}
    assert problems == {1: None, 2: "past the end of the region", 3: "no region at the address", 4: None, 5: "no region at the address"}
    pieces = lambda fill: sorted((r["request_id"], int(r["start"]), int(r["end"]), r["kind"]) for r in regions.sparse_read(asked, known, fill).collect())
    assert (4, 0x7F0000000000, 0x7F0030000000, "data") in pieces("skip") and (2, 0x3000, 0x3800, "zeros") in pieces("zero") and (5, 0x0800, 0x1000, "zeros") in pieces("zero")
    assert [x for x in pieces("error") if x[0] == 3] == [(3, 0x10, 0x20, "error")] and sum(x[3] == "data" for x in pieces("zero")) == 4
    shown = [r["line"] for r in regions.formatted(known).collect()]
    assert shown[0] == "0x0000000000001000-0x0000000000003000 r-xp /bin/a" and shown[1].endswith("[anonymous]")


def test_analyses_by_name(spark):
    df = blobs.from_bytes(spark, bytes(256) + bytes(range(256)), b"ab")
    got = analyze.analyze(df, "entropy").orderBy("blob_id", "offset").collect()
    assert [(r["blob_id"], r["offset"], r["size"], round(r["entropy"], 6)) for r in got] == [(0, 0, 256, 0.0), (0, 256, 256, 8.0), (1, 0, 2, 1.0)]
    assert analyze.analyze(df, "ioc", 0, "0..256").collect()[0]["ic"] == 1.0 and analyze.analyze(df, "hist", where="0..2").count() == 3
    with pytest.raises(literals.OctoplexError):
        analyze.analyze(df, "size")
    text = {r["blob_id"]: r["text"] for r in analyze.document(analyze.blocks(df, 256), "entropy", "json").collect()}
    assert text == {0: '{"blocks":[{"offset":0,"size":256,"entropy":0.000000},{"offset":256,"size":256,"entropy":8.000000}]}', 1: '{"offset":0,"size":2,"entropy":1.000000}'}
    assert analyze.document(analyze.blocks(df.where("blob_id = 1"), 0), "ic", "csv").first()["text"] == "offset,size,ic\n0,2,0.00000000\n"
    top = analyze.histogram(df.where("blob_id = 1"))
    assert analyze.histogram_document(top, "csv").first()["text"] == "byte,count,percentage\n97,1,50.0000\n98,1,50.0000\n"
    assert analyze.histogram_document(top, "json").first()["text"] == '{"total":2,"histogram":[{"byte":97,"count":1,"percentage":50.0000},{"byte":98,"count":1,"percentage":50.0000}]}'


def parsed(spark, text, *values, **options):
    got: dict = {}
    for r in template.parse(blobs.from_bytes(spark, *values), template.load(text), **options).collect():
        got.setdefault(r["blob_id"], {})[r["name"]] = r["error"] or r["value"]
    return got


ITEMS = """
name: t
endian: big
fields:
  - {name: n, type: u8}
  - name: items
    type: u8
    count: $n
    element_template:
      name: item
      endian: big
      fields:
        - {name: kind, type: u8, offset: 0, enum: {1: one}, assert: "01", bitfields: [{name: low, bits: 0}]}
        - {name: size, type: i8, offset: 1}
        - {name: twice, type: computed, value: $size * 2}
        - {name: again, type: u8, offset: $@base - $@base + 1, when: $kind == 1}
  - {name: after, type: u8}
"""


def test_element_templates(spark):
    got = parsed(spark, ITEMS, bytes.fromhex("0201ff0205aa"), bytes.fromhex("0301ff02"), b"\x00\x07")
    assert got[0] == {"n": "2", "items[0].kind": "1 (one)", "items[0].kind.low": "true", "items[0].size": "-1", "items[0].twice": "-2", "items[0].again": "255", "items[1].kind": "2", "items[1].kind.low": "false", "items[1].size": "5", "items[1].twice": "10", "after": "170"}
    assert got[1] == {None: "items ends beyond the data"} and got[2] == {"n": "0", "after": "7"}


def test_template_errors_stay_with_their_blob(spark):
    text = "{name: t, fields: [{name: n, type: i8}, {name: body, type: bytes, size: $n}, {name: d, type: computed, value: 12 / $n}]}"
    got = parsed(spark, text, b"\x02ab", b"\xff", b"\x00", b"\x03a")
    assert got[0] == {"n": "2", "body": "61 62", "d": "6"} and got[1] == {None: "body: negative size"} and got[2] == {None: "d: the value can't be computed"} and got[3] == {None: "body ends beyond the data"}
    for bad in ("{name: t, fields: [{name: a, type: u9}]}", "{name: t, fields: [{name: a, type: u8}, {name: a, type: u8}]}", "{name: t, fields: [{name: a, type: u8, size: '2'}]}", "{name: t, fields: [{name: a, type: computed}]}", "{name: t, fields: [{name: a, type: u8, bit_offset: '9'}]}"):
        with pytest.raises(literals.OctoplexError):
            template.load(bad)
    with pytest.raises(literals.OctoplexError):
        parsed(spark, "{name: t, fields: [{name: a, type: u8, when: $missing}]}", b"a")


@pytest.mark.parametrize(
    ("text", "value"),
    [("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("2 ** 8", 256), ("17 % 5", 2), ("-7 / 2", -3), ("1 < 2 and not 0", 1), ("3 >= 4 or 2 != 2", 0), ("0x10 - 1", 15), ("5 > 4", 1), ("4 <= 3", 0), ("7 - -2", 9)],
)
def test_expressions(spark, text, value):
    assert parsed(spark, f"{{name: t, fields: [{{name: v, type: computed, value: '{text}'}}]}}", b"a")[0]["v"] == str(value)


def test_bits_across_bytes_and_signs(spark):
    big = "{{name: t, endian: {}, fields: [{{name: v, type: {}, bit_offset: {}, bit_size: {}}}]}}"
    for endian, kind, at, size, data, value in (("big", "u16", 4, 12, "1234", 0x234), ("little", "u16", 4, 12, "1234", 833), ("big", "i8", 0, 4, "d0", -3), ("big", "i8", 0, 3, "e0", -1), ("little", "i8", 4, 4, "80", -8)):
        assert parsed(spark, big.format(endian, kind, at, size), bytes.fromhex(data))[0]["v"] == str(value)
    text = "{name: t, endian: little, fields: [{name: a, type: i8}, {name: b, type: i16}, {name: c, type: i32}, {name: d, type: i64}, {name: s, type: string, size: '4'}]}"
    data = (-2).to_bytes(1, "little", signed=True) + (-300).to_bytes(2, "little", signed=True) + (-70_000).to_bytes(4, "little", signed=True) + (-(2**40)).to_bytes(8, "little", signed=True) + b"ab\x00c"
    assert parsed(spark, text, data)[0] == {"a": "-2", "b": "-300", "c": "-70000", "d": str(-(2**40)), "s": '"ab"'}


def test_template_texts(spark):
    t = template.load("{name: t, fields: [{name: a, type: u8, assert: '01', description: first}, {name: raw, type: hex_string, size: '1'}]}")
    rows = template.parse(blobs.from_bytes(spark, b"\x02\xff", b"\x01"), t)
    shown = lambda form: {r["blob_id"]: r["text"] for r in template.rendered(rows, form).collect()}
    assert shown("json") == {0: '{"a":"2","raw":"ff"}', 1: '{"error":"raw ends beyond the data"}'} and shown("yaml")[0] == "a: 2\nraw: 'ff'"
    assert shown("table")[0].split("\n")[0] == "0x00000000      1  a     2 FAILED"
    assert {r["blob_id"]: r["all_passed"] for r in template.assertions(rows).collect()} == {0: False, 1: True}
    assert template.describe(spark, t).first()["description"] == "first" and template.total_size(t) == 0
    assert {r["name"] for r in template.parse(blobs.from_bytes(spark, b"\x01\xff"), t, ["raw"]).collect()} == {"raw"}


def test_conversions(spark):
    one = lambda data, *a, **b: convert.convert(blobs.from_bytes(spark, data), *a, **b).collect()[0]
    raw = lambda r: bytes(r["data"])
    assert raw(one(b"line1\r\nline2\rline3\n", line_ends="unix")) == b"line1\nline2\nline3\n" and raw(one(b"a\nb\r\n", line_ends="mac")) == b"a\rb\r"
    assert raw(one(b"A\n", target="utf-16be", bom="add")) == b"\xfe\xff\0A\0\n" and raw(one(b"\xef\xbb\xbfA", bom="keep")) == b"\xef\xbb\xbfA" and raw(one(b"\xef\xbb\xbfA", bom="remove")) == b"A"
    assert raw(one(b"He\xffo", on_error="replace")) == "He�o".encode() and one(b"He\xffo", on_error="strict")["data"] is None
    for encoding, order in (("utf-16le", "little"), ("utf-16be", "big")):
        pair = "a😀".encode(encoding)
        assert raw(one(pair, encoding)) == "a😀".encode()
        for bad in (pair[:-1], pair[:-2], b"\x00\xdc"[:: 1 if order == "little" else -1] + pair):
            assert raw(one(bad, encoding, on_error="replace")) == bad.decode(encoding, "replace").encode() and one(bad, encoding)["error"]
    assert one("ŋ".encode(), target="latin-1")["error"] and blobs.from_bytes(spark, b"\xff\xfe").select(convert.detect_bom(F.col("data"))).first()[0] == "utf-16le"


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", bytearray(b"\x00\xff")), ("y", bytearray(b"")), ("../out", bytearray(b"1")), ("n", None)], "path string, data binary")
    status = lambda **o: {r["name"]: r["status"] for r in blobs.write_raw(df, str(tmp_path / "raw"), **o).collect()}
    assert status() == {"a/x.bin": "written", "y": "written", "../out": "refused", "n": "null"}
    assert status(only_changed=True)["y"] == "unchanged" and (tmp_path / "raw/a/x.bin").read_bytes() == b"\x00\xff" and not (tmp_path / "out").exists()
    (tmp_path / "raw/y").write_bytes(b"old")
    assert status(backup=".bak")["y"] == "written" and (tmp_path / "raw/y.bak").read_bytes() == b"old"
    read = blobs.from_files(spark, str(tmp_path / "raw"), "*.bin").count()
    assert read == 0 or read == 1
    assert bytes(blobs.from_stream(spark, io.BytesIO(b"\x01\x02")).first()["data"]) == b"\x01\x02"
    hexed = spark.createDataFrame([(1, "de ad"), (2, "abc")], "k int, h string")
    assert [r["data"] and bytes(r["data"]) for r in blobs.from_hex(hexed, "k", "h").collect()] == [b"\xde\xad", None]
    (tmp_path / "t.yaml").write_text("{name: t, fields: [{name: a, type: u8}]}")
    assert blobs.template_file(str(tmp_path / "t.yaml")).fields[0].name == "a"
    blobs.write_blobs(df, str(tmp_path / "p"))
    blobs.write_text(spark.createDataFrame([("x",)], "line string"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4 and spark.read.text(str(tmp_path / "q")).first()[0] == "x"


def test_sql_functions(spark):
    assert "octo_search" in sql.register(spark)
    assert spark.sql("SELECT octo_xxh64(CAST('hello' AS BINARY))").first()[0] == "26c7827d889f6da3" and spark.sql("SELECT octo_entropy(X'0001')").first()[0] == 1.0
    assert [r["offset"] for r in spark.sql("SELECT * FROM octo_search(X'00AA00AA', 'AA', 'hex')").collect()] == [1, 3]
    assert [tuple(r) for r in spark.sql("SELECT * FROM octo_diff(X'0001', X'00')").collect()] == [(1, 1, None)]


def streamed(spark, rows, made, mode, tmp_path, files=4):
    where = str(tmp_path / f"s{random.random()}")
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, data binary, last boolean")
    df.repartition(files).write.parquet(where)
    name = f"t{random.randrange(10**9)}"
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)
    made(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_streams_across_chunks(spark, tmp_path):
    rng = random.Random(2)
    whole = {k: bytes(rng.choices(b"\xaa\xff", k=200)) for k in range(3)}
    rows = []
    for k, data in whole.items():
        cuts = sorted({0, 200, *rng.sample(range(200), 20)})
        rows += [(k, i, bytearray(data[a:b]), i == len(cuts) - 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rng.shuffle(rows)
    watched = progress.watch(spark)
    pattern = literals.Exact(b"\xaa\xaa\xff")
    got = {(r["stream_id"], r["offset"]) for r in streamed(spark, rows, lambda s: streams.search(s, pattern), "append", tmp_path)}
    assert got == {(k, i) for k, v in whole.items() for i in range(198) if v[i : i + 3] == b"\xaa\xaa\xff"}
    blocks = streamed(spark, rows, lambda s: streams.blocks(s, 64), "append", tmp_path)
    assert sorted((r["stream_id"], r["offset"], r["size"]) for r in blocks) == [(k, o, min(64, 200 - o)) for k in range(3) for o in range(0, 200, 64)]
    batch = {(r["blob_id"], r["offset"]): r["entropy"] for r in analyze.blocks(blobs.from_bytes(spark, *whole.values()), 64).collect()}
    assert all(r["entropy"] == pytest.approx(batch[r["stream_id"], r["offset"]]) for r in blocks)
    sums = streamed(spark, rows, streams.crc32, "update", tmp_path)
    assert {r["stream_id"]: r["crc32"] for r in sums if r["size"] == 200} == {k: f"{zlib.crc32(v):08x}" for k, v in whole.items()}
    parts = streamed(spark, rows, lambda s: streams.block_digests(s, "sha-256", 90), "append", tmp_path)
    assert {(r["stream_id"], r["offset"], r["digest"]) for r in parts} == {(k, o, hashlib.sha256(v[o : o + 90]).hexdigest()) for k, v in whole.items() for o in (0, 90, 180)}
    spark.streams.removeListener(watched)
