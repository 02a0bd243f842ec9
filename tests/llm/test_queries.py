"""The registered queries without SQL, and the pipeline, against brute force over a small set of tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import regex
from xxhash import xxh64_intdigest

import corpus_pipeline
from octoplex.llm import mixing, quality, queries, secrets, spotsigs

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block string"
ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"


def sentence(rng, n):
    return " ".join(rng.choice(("the", "of", "le", "und")) if rng.random() < 0.3 else "".join(rng.choices("abcdefgé", k=rng.randrange(2, 8))) for _ in range(n))


def corpus():
    """(doc_id, text, source): prose and junk, copies of 2 to 20, near copies, leaks, secrets, and the empty."""
    rng = random.Random(11)
    texts = [sentence(rng, rng.randrange(30, 120)) + "." for _ in range(60)]
    texts += [texts[0]] * 19 + [texts[1].upper(), texts[2].replace(" ", "\n\t")]
    texts += [texts[k][:-1] + "!" for k in range(3, 9)] + [sentence(rng, 3000)]
    texts += [f"{sentence(rng, 30)} {ITEM} {sentence(rng, 9)}", ITEM.upper()]
    texts += [f'{sentence(rng, 25)} Password: "hunter22" {sentence(rng, 9)} AKIA{"B" * 16} token=abc é {"a1" * 14}']
    texts += ["".join(rng.choices("!!#$%AZ09| ", k=300)) for _ in range(60)]
    texts += [None, "", " ", "one", "one two", None]
    order = rng.sample(range(len(texts)), len(texts))
    return [(3 * k - 20, texts[i], ("web", "web", "web", "books", None)[k % 5]) for k, i in enumerate(order)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where, rows = str(tmp_path_factory.mktemp("tables")), corpus()
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "x") for i, t, s in rows], DOCS).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(t is not None and "#" not in t and "!!" not in t), 0) for i, t, _ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([("7", ITEM), ("8", "one"), (None, None)], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if (x ^ y).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    return prints, root


def test_op4(spark, tables):
    where, rows = tables
    prints, root = components([r[:2] for r in rows])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op4_simhash_pivots"](spark, where).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert len(set(root.values())) < len(rows) - 20


def anchored(text):
    """The chains of a text, as tuples."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    anchors = [k for k, w in enumerate(words) if w in spotsigs.ANCHORS]
    chains = set()
    for k in anchors or range(len(words)):
        after = [w for w in words[k + 1 :] if not anchors or w not in spotsigs.ANCHORS]
        chains.add((words[k], *(after + ["", ""])[:2]))
    return chains


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op7(spark, tables):
    where, rows = tables
    rows = sorted((i, t or "") for i, t, _ in rows)
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_spotsigs"](spark, where).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        other, r, cut = rows[(k + 1) % len(rows)][1], got[i], len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, following = anchored(text), anchored(edited), anchored(other)
        assert r["near_edited"] == pytest.approx(jaccard(own, new)) and r["near_next"] == pytest.approx(jaccard(own, following))
        for f, s in ((r["fingerprint"], own), (r["edited_fingerprint"], new)):
            assert prints.setdefault(frozenset(s), f) == f
    assert len(set(prints.values())) == len(prints)


def test_spotsigs_pairs_match_brute_force(spark):
    rng = random.Random(12)
    base = [sentence(rng, 80).split() for _ in range(8)]
    texts = [" ".join(w if rng.random() < 0.985 else "zz" for w in b) for b in base for _ in range(6)] + ["", None, "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    chains = [anchored(t or "") for t in texts]
    first = {frozenset(s): k for k, s in reversed(list(enumerate(chains))) if s}
    want = {(a, b) for a in first.values() for b in first.values() if a < b and jaccard(chains[a], chains[b]) >= 0.8}
    assert len(want) > 10 and {(r["doc_id"], r["near_id"]) for r in spotsigs.near_duplicates(docs).collect()} == want


def test_op9(spark, tables):
    where, rows = tables
    first: dict = {}
    raw = {i: (t or "").encode() for i, t, _ in sorted(rows)}
    for i, t in raw.items():
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_longest_previous_factor"](spark, where).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert got[i] == (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())


def model_of(rows, labels):
    """The model fitted without Spark, on the same rows."""
    learn = [(t, labels[i]) for i, t, _ in rows if crc32(str(i).encode()) % 3 != 1]
    x, y = quality.text_features(pa.array([t for t, _ in learn], pa.string())), np.array([v for _, v in learn], float)
    order = np.lexsort((*x.T, y))
    return quality.PairwiseGam().fit(x[order], y[order])


def test_op1(spark, tables):
    where, rows = tables
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    scores = model_of(rows, labels).score(quality.text_features(pa.array([t for _, t, _ in rows], pa.string())))
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_quality_gam"](spark, where).collect()}
    assert len(got) == len(rows)
    for (i, _, _), s in zip(rows, scores, strict=True):
        assert got[i]["score"] == pytest.approx(s) and got[i]["predicted"] == (got[i]["score"] >= 0.5) and got[i]["held_out"] == (crc32(str(i).encode()) % 3 == 1)
    unseen = [(labels[i], got[i]["predicted"]) for i in got if got[i]["held_out"]]
    assert sum(a == b for a, b in unseen) >= 0.95 * len(unseen)


def key(*parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def uses(rows, mix):
    """How often each document is used: {(doc_id, epoch)}."""
    size = {i: max(1, -(-len(t or "") // 4)) for i, t, _ in rows}
    groups = defaultdict(list)
    for i, _, s in rows:
        groups["\0" if s is None else s].append(i)
    total = {s: sum(map(size.get, g)) for s, g in groups.items()}
    spread = math.log(max(total.values()) / min(total.values()))
    alpha = max(0.0, 1 - math.log(mix.max_repeats) / spread) if spread else 1.0
    lifted = {s: n**alpha for s, n in total.items()}
    budget = sum(lifted.values()) * max(total[s] / lifted[s] for s in total)
    found = set()
    for s, ids in groups.items():
        mine = round(lifted[s] / sum(lifted.values()) * budget)
        epochs, rest = divmod(mine, total[s])
        found |= {(i, e) for i in ids for e in range(epochs)}
        blocks = defaultdict(list)
        for i in ids:
            blocks[key(mix.seed, "block", s, i) % math.ceil(total[s] / mix.block_tokens)].append(i)
        for b in sorted(blocks, key=lambda b: key(mix.seed, epochs, s, b)):
            for i in sorted(blocks[b], key=lambda i: key(mix.seed, "order", i)):
                if rest > 0:
                    found.add((i, epochs))
                rest -= size[i]
    return found


def test_op5(spark, tables):
    where, rows = tables
    made = [(r["doc_id"], r["epoch"]) for r in queries.QUERIES["op5_temperature_mix"](spark, where).collect()]
    assert len(made) == len(set(made)) and set(made) == uses(rows, mixing.Mix())
    small = mixing.Mix(block_tokens=64, max_repeats=1.5)
    made = [(r["doc_id"], r["epoch"]) for r in mixing.mixture(spark.read.parquet(f"{where}/documents.parquet"), small).collect()]
    assert len(made) == len(set(made)) and set(made) == uses(rows, small)


def similar(rows):
    """The smallest id that links of a Jaccard similarity of 0.8 or more, by five-word shingles, lead to."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if root[a] > root[b] and jaccard(x, y) >= 0.8:
                    root[a], changed = root[b], True
    return root


def redacted(text):
    spans = []
    for rule in secrets.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return None if text is None else out + text[at:]


def test_pipeline(spark, tables):
    where, rows = tables
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    scores = model_of(rows, labels).score(quality.text_features(pa.array([t for _, t, _ in rows], pa.string())))
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    root = similar([r[:2] for r in kept])
    kept = [r for r in kept if root[r[0]] == r[0]]
    kept = [r for r in kept if ITEM not in (r[1] or "").lower() and (r[1] or "").strip() != "one"]
    kept = [(i, redacted(t), s) for i, t, s in kept]
    assert any("[SECRET]" in (t or "") for _, t, _ in kept)
    got = corpus_pipeline.run(spark, where).collect()
    text = {i: t for i, t, _ in kept}
    assert Counter((r["doc_id"], r["epoch"]) for r in got) == Counter(uses(kept, mixing.Mix(max_repeats=2.0)))
    assert all(r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"] or "") for r in got)
