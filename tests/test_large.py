"""What must not grow: memory by matches, rows that are shuffled by bytes, results by the driver."""

import random
import re
import tracemalloc

import pyarrow as pa
import regex

from octoplex.functions import kernels, literals
from octoplex.operators import diff, search
from octoplex.plans import catalogue
from octoplex.sources import blobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_regex_matches_are_not_all_held():
    column = pa.array([b"x" * 100_000] * 5)
    tracemalloc.start()
    found = [len(row) for row, _, _ in search._regex_hits(column, literals.Regex("q*"), False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found) == 500_005 and max(found) < 2 * kernels.ROWS and peak < 40e6


def test_the_engines_iterator_gives_the_sequential_matches():
    def one_by_one(pattern, subject):
        out, at, last = [], 0, -1
        while at <= len(subject) and (m := pattern.search(subject, at)):
            start, end = m.span()
            if start == end == last:
                at += 1
            else:
                out.append((start, end))
                at = last = end
        return out

    rng = random.Random(5)
    for _ in range(2000):
        source = "".join(rng.choice(("a", "b*?", "a?", "(?:|a)", "(?<=a)", "$", r"\b", "|", "[ab]+")) for _ in range(rng.randrange(1, 4)))
        text = "".join(rng.choices("ab ", k=rng.randrange(8)))
        for pattern in (re.compile(source), regex.compile(source)):
            assert kernels.matches(pattern, text) == one_by_one(pattern, text), (source, text)


def test_pieces_hold_all_rows():
    batch = pa.record_batch({"k": [1, 2, 3, 4], "data": [b"a" * 10, None, b"b" * 30, b""]})
    assert [p.column(0).to_pylist() for p in kernels.pieces(batch, 1, limit=12)] == [[1, 2], [3], [4]]


def pairs(spark, n=60):
    rng = random.Random(7)
    rows = [(0, b"", b""), (1, b"", b"ab"), (2, b"ab", None), (3, b"same", b"same"), (4, b"a" * 200_000, b"b" * 150_000 + b"a" * 70_000)]
    for k in range(5, n):
        a, b = (bytes(rng.choices(b"abc", k=rng.randrange(400))) for _ in range(2))
        rows.append((k, a, a[:200] + b[200:] if k % 2 else b))
    return rows, spark.createDataFrame([(k, bytearray(a), None if b is None else bytearray(b)) for k, a, b in rows], "pair_id bigint, a binary, b binary")


def test_patches_are_made_in_place(spark):
    rows, df = pairs(spark)
    made = diff.patches(df)
    assert "Exchange" not in plan(made) and "Window" not in plan(made)
    assert {r["pair_id"]: bytes(r["data"]) for r in diff.apply(made).collect()} == {k: b or b"" for k, a, b in rows}
    assert {r["pair_id"]: bytes(r["data"]) for r in diff.apply(made.na.fill({"pair_id": 0}).withColumn("b", diff.F.coalesce("b", diff.octets.literal(b""))), data="b", revert=True).collect()} == {k: a for k, a, b in rows}
    assert "Window" not in plan(catalogue.QUERIES["patch_apply"](spark, "/root/testdata/sf0.001"))


def test_grouped_differences_are_those_of_patches(spark):
    _, df = pairs(spark)
    found = diff.entries(df)
    assert "Window" not in plan(diff.grouped(found.repartition(5)))
    want = {r["pair_id"]: r["patch"] for r in diff.patches(df).collect() if r["patch"]}
    for mixed in (found, found.repartition(5)):
        assert {r["pair_id"]: r["patch"] for r in diff.grouped(mixed).collect()} == want


def test_hunks_do_not_depend_on_where_differences_are(spark):
    _, df = pairs(spark)
    found = diff.entries(df).where("offset % 7 = 0 and offset % 1000 < 700 or offset % 90 = 1")
    want = sorted(map(tuple, diff.hunks(found).collect()))
    assert len(want) > 50 and want == sorted(map(tuple, diff.hunks(found.repartition(5)).collect()))
    assert "Window" not in plan(diff.hunks(found))
    assert want == sorted(map(tuple, diff.hunks(diff.entries(df).where("offset % 7 = 0 and offset % 1000 < 700 or offset % 90 = 1")).collect()))
    assert sorted(map(tuple, diff.pair_hunks(df, ignore="0..9,20").collect())) == sorted(map(tuple, diff.hunks(diff.entries(df, "0..9,20")).collect()))


def test_lines_by_the_kernel_are_those_of_the_columns(spark):
    _, df = pairs(spark, 20)
    found = diff.entries(df, "3..5")
    for form, plain in (("patch", diff.patch_lines), ("simple", diff.simple_lines)):
        want = plain(found)
        assert sorted(map(tuple, diff.lines(df, form, "3..5").collect())) == sorted(map(tuple, want.collect()))
        totals = want.groupBy("pair_id").agg(diff.F.count("*"), diff.F.sum("offset"), diff.F.min("line"), diff.F.max("line"))
        assert sorted(map(tuple, diff.line_totals(df, form, "3..5").collect())) == sorted(map(tuple, totals.collect()))
    for name in ("diff_patch_lines", "diff_simple_lines"):  # lines that Spark makes are sorted one by one for their least
        assert "lpad" not in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_plain_and_other_patch_lines(spark):
    texts = ["0x00000010:aa:BB", "0X0000001f::0b", "0xffffffff:0c:", "0x00000010:aa:bg", "0x0000001:0aa:bb", "0x00000010:::", "0x00000010::", "  0x00000010:aa:bb ", "12:aabb:ccdd", "# 0x00:aa:bb..", "#x00000010:aa:bb", "", "0x00000010aaa:bb", None, "0x0000001é:a:bb"]
    got = diff.parse_patch(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    want = [(16, b"\xaa", b"\xbb", None), (31, b"", b"\x0b", None), (2**32 - 1, b"\x0c", b"", None), *[(None, None, None, e) for e in ("bad hex", "bad hex", "bad hex", "both sides are empty")], (16, b"\xaa", b"\xbb", None), (18, b"\xaa\xbb", b"\xcc\xdd", None), (None, None, None, "not OFFSET:OLD:NEW"), (None, None, None, "bad offset")]
    assert [(r["offset"], r["old"] if r["old"] is None else bytes(r["old"]), r["new"] if r["new"] is None else bytes(r["new"]), r["error"]) for r in got] == want
    _, df = pairs(spark, 20)
    again = diff.parse_patch(diff.patch_lines(diff.entries(df)), "line")
    assert sorted(map(str, diff.parse_pairs(df).drop("position").collect())) == sorted(map(str, again.drop("position").collect()))


def test_empty_documents_have_no_blocks_in_the_queries(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "aab"), (3, None), (4, "a" * 300)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, str(tmp_path)).collect())) for n in ("entropy_whole", "ic_whole", "entropy_blocks", "ic_blocks", "entropy_json", "entropy_classes", "ic_classes", "entropy_summary", "display_dec", "display_oct")}
    assert [r[0] for r in got["entropy_whole"]] == [r[0] for r in got["ic_whole"]] == [r[0] for r in got["entropy_json"]] == [r[0] for r in got["display_dec"]] == [r[0] for r in got["display_oct"]] == [2, 4]
    assert [r[:3] for r in got["entropy_blocks"]] == [r[:3] for r in got["ic_blocks"]] == [(2, 0, 3), (4, 0, 256), (4, 256, 44)]
    assert sum(r[1] for r in got["entropy_classes"]) == sum(r[1] for r in got["ic_classes"]) == 2 and got["entropy_summary"][0][0] == 3


def test_results_of_streams_do_not_come_to_the_driver(spark, tmp_path):
    rows = [(1, "the" * 900), (2, ""), (3, "x" * 700 + "the"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.QUERIES["stream_search"](spark, str(tmp_path))
    assert "Scan parquet" in plan(made).replace("FileScan", "Scan")  # before, a table in the driver's memory
    assert sorted(map(tuple, made.collect())) == [(1, 3 * k) for k in range(900)] + [(3, 700)]
    blocks = catalogue.QUERIES["stream_blocks"](spark, str(tmp_path)).collect()
    assert sorted((r["stream_id"], r["offset"], r["size"]) for r in blocks) == sorted((k, o, min(256, len(t) - o)) for k, t in rows if t for o in range(0, len(t), 256))
    assert {r["stream_id"]: r["size"] for r in catalogue.QUERIES["stream_crc32"](spark, str(tmp_path)).collect()} == {1: 2700, 2: 0, 3: 703}


def test_chunks_are_cut_before_there_is_a_row_for_each(spark, tmp_path):
    spark.createDataFrame([(1, "abc" * 500), (2, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue._chunks(spark, str(tmp_path))
    assert "Generate explode(transform" in made._jdf.queryExecution().analyzed().toString()  # before, the document itself went into each row
    got = {}
    sink = made.writeStream.format("memory").queryName("cut_up").trigger(availableNow=True).start()
    sink.awaitTermination()
    for r in spark.table("cut_up").collect():
        got[r["stream_id"], r["seq"]] = (bytes(r["data"]), r["last"])
    assert got == {(1, 0): (b"abc" * 333 + b"a", False), (1, 1): ((b"abc" * 500)[1000:], True), (2, 0): (b"", True)}


def test_bytes_of_known_width_are_reversed_without_text(spark):
    assert "regexp_extract_all" not in plan(catalogue.QUERIES["struct_little"](spark, "/root/testdata/sf0.001"))
    df = blobs.from_bytes(spark, bytes(range(1, 9)), b"\x01\x02", b"", b"\xff" * 8)
    for width in (8, 9):
        assert [bytes(r[0]) for r in df.orderBy("blob_id").select(diff.octets.reversed_bytes(diff.F.col("data"), width)).collect()] == [bytes(range(8, 0, -1)), b"\x02\x01", b"", b"\xff" * 8]


def test_utf16_is_decoded_a_few_values_at_a_time(spark):
    from octoplex.operators import convert

    column = pa.array(["text é".encode("utf-16-be") * 800] * 4000)
    tracemalloc.start()
    got = convert._utf16("utf-16be").func(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(got) == 4000 and got.field("valid").to_pylist() == [True] * 4000
    df = spark.createDataFrame([(1, bytearray(b"\x00a\xd8\x00\x00b")), (2, None), (3, bytearray()), (4, bytearray(b"\x00a\x00"))], "blob_id bigint, data binary").withColumn("_decoded", diff.F.lit(7))
    out = {r["blob_id"]: (r["data"] and bytes(r["data"]), r["error"], r["_decoded"]) for r in convert.convert(df, source="utf-16be").collect()}
    assert out == {1: (None, "invalid utf-16be", 7), 2: (None, None, 7), 3: (bytearray(), None, 7), 4: (None, "invalid utf-16be", 7)}
    kept = {r["blob_id"]: r["data"] and bytes(r["data"]).decode() for r in convert.convert(df, source="utf-16be", on_error="replace").collect()}
    assert kept == {1: "a�b", 2: None, 3: bytearray(), 4: "a�"}


def test_the_prefilter_of_secrets_tells_what_the_rules_tell(spark):
    from octoplex.llm import secrets

    texts = ["passWORD=abc", "Token: x", "API_key='1", "secret x", "akia AKIA1", "AKIA a", "0123456789abcdef01234567", "0123456789abcdef0123456", "", None, "xpasswd:=", "API-key=1", "apikey = b", "Key tOKen=abc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = diff.F.coalesce(diff.F.col("text").rlike("|".join(f"(?:{r.pattern})" for r in secrets.RULES)), diff.F.lit(False))
    got = [tuple(r) for r in df.select(secrets._may_match(secrets.RULES), plain).collect()]
    assert all(a == b for a, b in got) and sum(a for a, _ in got) == 7
    assert secrets.RULES[0].begins and secrets.RULES[1].holds  # before, all rules were tried at each character
