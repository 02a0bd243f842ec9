"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from octoplex.llm import chat, common, decontaminate, licenses, mixing, quality, secrets, simhash, spotsigs, substrings

CLASH = "items array<int>, starts int, ends int, n_words int, `_t` int, `_s` int, `_findings` string, `_blob` int, `_score` int, `_leak` int, `h` int, other int, blob string, epoch int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clashing(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", None if k % 3 == 2 else "s", len(t or ""), [7], 1, 2, 3, 4, 5, "f", 6, 7, 8, 9, 10, "b", 11) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))


def plain_features(text):
    """What quality.FEATURES stand for, without arrays or hashes."""
    data = (text or "").encode()
    tokens, lines = re.findall(rb"[^ \t\r\n\x0b\x0c]+", data), re.findall(rb"[^\n]*\n|[^\n]+", data)
    share = lambda test: sum(map(test, data)) / len(data) if data else 0.0
    kinds = lambda x: len(set(x)) / len(x) if x else 1.0
    return [
        math.log1p(len(data)), math.log1p(len(tokens)), sum(map(len, tokens)) / max(len(tokens), 1), min(1000, max(map(len, tokens), default=0)),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b" \t\r\n\x0b\x0c"), share(lambda c: c == 10), share(lambda c: c >= 128),
        share(lambda c: c in b"!?"), share(lambda c: c in b".,;:"), share(lambda c: c in b"#$%&*@^~+=<>\\/_{}[]"), share(lambda c: c == 124),
        kinds(tokens), kinds(list(zip(tokens, tokens[1:], tokens[2:], strict=False))), kinds(lines),
    ]


def sample_texts(seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab Z9\n\té!?.,;#|", k=rng.randrange(400))) for _ in range(60)]
    return [*texts, None, "", "\n", "  ", "x", "é" * 1500, "a b a b a b\na b\na b\n"]


@pytest.mark.parametrize("piece", [None, 1, 7, 50])
def test_quality_features_match_a_plain_count(piece, monkeypatch):
    texts = sample_texts()
    if piece:
        got = np.concatenate([quality.long_features(np.frombuffer((t or "").encode(), np.uint8), piece) for t in texts])
    else:
        got = quality.text_features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)


def test_quality_scores_are_sums_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.FEATURES)))
    y = (x[:, 0] + (x[:, 1] > 0.5) * (x[:, 2] > 0.5) > 0.8).astype(float)
    model = quality.PairwiseGam(rounds=30, pair_rounds=10).fit(x, y)
    place = lambda i, v: sum(v >= e for e in model.edges[i])
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base + sum(model.tables[i][place(i, v)] for i, v in enumerate(row)) + sum(t[place(i, row[i]), place(j, row[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) >= 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_counts_a_repeated_labelled_id_once(spark):
    texts = [words(random.Random(k), 30) + ("!!" * 9 if k % 2 else "") for k in range(40)]
    docs = clashing(spark, texts * 3, list(range(40)) * 3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    once, thrice = (quality.train(d, labels, rounds=5, pair_rounds=2) for d in (clashing(spark, texts), docs))
    assert once.base == thrice.base and all(np.array_equal(a, b) for a, b in zip(once.tables, thrice.tables, strict=True))
    assert quality.score_documents(docs, once, "_score").count() == 120


MIT = licenses.TEMPLATES[5][1]
PROBES = (
    (MIT, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n" + MIT, "MIT"),
    ("# Copyright 2019-2021 Some Body\n" + "\n".join(f"# {MIT[k : k + 70]}" for k in range(0, len(MIT), 70)), "MIT"),
    ("We thank all. Released under the MIT License. See the file for more of it and other things.", "MIT"),
    (licenses.TEMPLATES[7][1], "ISC"), (licenses.TEMPLATES[9][1], "BSD-2-Clause"), ("int x;\n" + licenses.TEMPLATES[10][1] + "\nint y;", "BSD-3-Clause"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble", "GPL-3.0-only"),
    ("// SPDX-License-Identifier: MIT\nint main;", "MIT"), ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
)


def test_licenses_of_real_texts(spark):
    docs = clashing(spark, [t for t, _ in PROBES] + [None, "", "plain words of no license at all", "Redistribution and use in source and binary forms", "x " * 200_000])
    found = licenses.scan(docs)
    got = {r["doc_id"]: r["license"] for r in licenses.best(found).collect()}
    assert got == {k: name for k, (_, name) in enumerate(PROBES)}
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_simhash_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, n).encode() for n in (1, 2, 3, 4, 50, 400)] + [b"", b" \n"]
    whole = [simhash._fingerprint(t) for t in texts]
    for size in (1, 5, 64):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        assert [simhash._fingerprint(t) for t in texts] == whole


def test_near_duplicates_ignore_other_columns(spark):
    docs = clashing(spark, ["a b c d e f g"] * 3 + [None, "", "x y"], [4, 2, None, 7, 8, 9])
    for threshold in (None, 0.8):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5 if threshold else 3, threshold).collect()}
        assert got == {4: 2, 2: 2, None: 2, 7: 7, 8: 7, 9: 9}


def test_mixture_keeps_clashing_columns_and_rows_without_ids(spark):
    docs = clashing(spark, ["one two", "three", None, "", "five six seven"] * 4, [None] * 8 + list(range(12)))
    out = mixing.mixture(docs, mixing.Mix(block_tokens=4))
    assert [c for c in out.columns if c not in ("epoch", "block", "place")] == [c for c in docs.columns if c not in ("epoch", "block", "place")]
    rows = out.collect()
    assert {r["_t"] for r in rows} == {4} and {r["_s"] for r in rows} == {5} and {r["other"] for r in rows} == {10}
    assert Counter(r["doc_id"] for r in rows if r["epoch"] == 0)[None] == 8
    assert mixing.mixture(docs.where("doc_id < 0")).count() == 0


def test_redact_keeps_clashing_columns(spark):
    docs = clashing(spark, ["token=abcdef99 x", None, "", "plain", "token=abcdef99 x"], [1, None, 2, 2, None])
    out = secrets.redact(docs)
    rows = out.collect()
    assert out.columns == docs.columns and {(r["_findings"], r["_blob"], r["blob"]) for r in rows} == {("f", 6, "b")}
    assert Counter(r["text"] for r in rows) == Counter(["[SECRET] x"] * 2 + [None, "", "plain"])
    assert secrets.redact(docs.where("doc_id < 0")).count() == 0


def test_a_second_scan_reads_new_blobs_only(spark):
    docs = clashing(spark, ["token=abcdef99", "same", "same", None, "AKIA" + "B" * 20], [1, 2, 3, 7, 14])
    first, second = secrets.two_versions(docs)
    _, ledger = secrets.scan_unseen(first, "path")
    ledger = common.cut(ledger)
    found, grown = secrets.scan_unseen(first.union(second), "path", ledger)
    assert grown.count() - ledger.count() == 2  # of the 10 paths only those of 7 and 14 hold new blobs
    spans = {r["path"]: r["spans"] for r in secrets.digests(found, "path").collect()}
    assert len(spans) == 10 and spans["1/1"] == spans["2/1"] == "assign:0:14" and spans["1/7"] == "" and spans["2/7"].startswith("assign:1:")
    _, again = secrets.scan_unseen(first, "path", ledger, version="2")
    assert again.where("rule_version = '2'").count() == ledger.count()  # other rules: everything is scanned again


def test_leaks_with_clashing_columns(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "four five six seven"), (3, None), (None, "x")], "item_id bigint, text string")
    docs = clashing(spark, ["a one two three b four five six seven", None, "", "one two"], [5, None, 6, 6])
    for size in (10**6, 3):
        plain = decontaminate.find_leaks(docs, items, slice_words=size).collect()
        assert sorted(map(str, (r["items"] for r in plain))) == sorted(map(str, [["1", "2"], [], [], []])) and plain[0]["h"] == 9
        inside = decontaminate.find_leaks(docs, items, slice_words=size, into="found")
        assert inside.columns == [*docs.columns, "found"]
        assert {(str(r["items"]), r["starts"], r["h"], r["other"]) for r in inside.collect()} == {("[7]", 1, 9, 10)}
        assert decontaminate.find_leaks(docs.where("doc_id < 0"), items, slice_words=size).count() == 0


def test_leaks_in_pieces(monkeypatch):
    rng = random.Random(9)
    items = [("a", words(rng, 12).encode()), ("b", b"short one")]
    matchers = decontaminate.build(items)
    texts = [f"{words(rng, 9)} {items[0][1].decode()} {words(rng, 3)} short one".encode(), b"", items[0][1] * 3]
    whole = [decontaminate.scan(t, matchers) for t in texts]
    for size in (1, 10, 40):
        monkeypatch.setattr(decontaminate, "PIECE_BYTES", size)
        for (n, a, b, i), t in zip(whole, texts, strict=True):
            m, c, d, j = decontaminate.scan(t, matchers)
            assert (n, a.tolist(), b.tolist(), i) == (m, c.tolist(), d.tolist(), j)


def test_next_documents_over_sparse_ids(spark):
    rng = random.Random(2)
    ids = sorted(list({rng.randrange(-(2**62), 2**62) for _ in range(60)}) + list(range(300, 400)) + [-(2**63), 2**63 - 1, 2**40, 2**40 + 1])
    order = rng.sample(ids, len(ids))
    docs = clashing(spark, [str(i) for i in order] + [None, "n"], [*order, None, None])
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(docs).collect()}
    assert got == {i: str(j) for i, j in zip(ids, [*ids[1:], ids[0]], strict=True)} | {None: ""}
    assert spotsigs.with_next(docs.where("text is null and doc_id is not null")).count() == 0
    one = spotsigs.with_next(docs.where("doc_id = 300")).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("300", "300")]


def test_spotsigs_of_a_long_text(spark):
    docs = clashing(spark, ["the cat and the dog " * 100_000, None, "", "zz"])
    rows = {r["doc_id"]: r for r in spotsigs.signatures(docs, "text", "sig").collect()}
    assert 0 < len(rows[0]["sig"]) <= 8 and rows[1]["sig"] == rows[2]["sig"] == [] and rows[0]["items"] == [7]


def test_repeats_edges(spark):
    text = words(random.Random(7), 30)
    docs = clashing(spark, [text, text, None, "", "x" * 49, "x" * 49, text], [3, 3, 1, 2, 4, 5, None])
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]).decode()) for r in substrings.remove_repeats(docs).collect()]
    assert Counter(got) == Counter([(3, len(text), text)] * 2 + [(1, 0, ""), (2, 0, ""), (4, 49, "x" * 49), (5, 49, "x" * 49), (None, len(text), "")])
    assert substrings.remove_repeats(docs.where("doc_id < 0")).count() == 0


def test_earlier_matches_with_ties():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 12)
        owners, shared = [rng.randrange(4) for _ in range(n)], [0] + [rng.randrange(4) for _ in range(n - 1)]
        common = lambda i, j: min(shared[min(i, j) + 1 : max(i, j) + 1])
        want = [max([common(i, j) for j in range(n) if owners[j] < owners[i]], default=0) for i in range(n)]
        assert substrings.earlier_matches(np.array(owners), np.array(shared)).tolist() == want


def conversation(rng):
    said = [("system", "s" * 40_000)] + [(("user", "assistant")[k % 2], "u\\<" + "x" * rng.choice((0, 10, 4_000, 9_001))) for k in range(40)]
    return [(1, 7 * k, r, t) for k, (r, t) in enumerate(said)] + [(None, None, None, None), (None, 3, "assistant", "a"), (None, 3, "assistant", "a"), (2, 1, "system", ""), (3, 600, "user", "y"), (3, 20, "assistant", "z")]


@pytest.mark.parametrize("budget", [1024, 64])
def test_no_window_is_over_budget(spark, budget):
    turns = spark.createDataFrame(conversation(random.Random(6)), "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns.withColumn("c", F.lit(1)).withColumn("span", F.lit(2)), budget)
    rows = made.collect()
    for r in rows:
        bodies = [s["end"] - s["start"] for s in r["segments"]]
        assert r["tokens"] <= budget and len(r["segments"]) * chat.FRAME <= r["tokens"]
        assert sum(bodies) + sum(s["start"] for s in r["segments"][:1]) <= len(r["formatted"])
    back = [tuple(r) for r in chat.read_back(made).orderBy("conv_id", "position").select("conv_id", "role", "text", "loss").collect()]
    want = sorted(conversation(random.Random(6)), key=lambda x: (x[0] or 0, -1 if x[1] is None else x[1]))
    assert back == [(c, r or "", t or "", r == "assistant") for c, _, r, t in want]
    assert chat.windows(turns.where("conv_id < 0")).count() == 0


def test_stages_pass_clashing_columns_and_null_ids(spark, tmp_path):
    rng = random.Random(8)
    texts = [words(rng, 60) for _ in range(30)] + ["!!#$%9|" * 40] * 30 + [None, ""]
    docs = clashing(spark, texts, [*range(60), None, None]).drop("epoch")
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(60)] + [(None, None)], "doc_id bigint, quality int")
    docs.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[3])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = common.cut(out)
    assert {r["doc_id"] for r in docs.collect()} >= set(range(30)) - {3} and not {3, 40} & {r["doc_id"] for r in docs.collect()}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < -5"), str(tmp_path)).count() == 0
