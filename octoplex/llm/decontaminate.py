"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of 8 words of each benchmark item. The search reads a document's words as symbols and
blocks of two of them: a block's entry in the shift table says how far a window can still be moved, a block that is in
no window lets the search jump over all the positions that hold it, a hash of a window's last block selects the windows
to try, and these are compared word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, private, row_groups, table

WINDOW = 8
#: Words of benchmark text that one pass holds in memory; a larger benchmark is searched for in several passes.
SLICE_WORDS = 1_000_000
#: Bytes of text whose words are held at once.
PIECE_BYTES = 1 << 20
#: Code points below U+0080 that are no words: all but digits and letters; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """The windows of one length, with their shift and suffix tables."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.stride = length - self.block + 1
        self.owners: dict[tuple, list[int]] = {}
        self.shift: dict[tuple, int] = {}
        self.suffixes: dict[int, list[tuple]] = defaultdict(list)

    def add(self, window: tuple, item: int) -> None:
        if window in self.owners:
            if self.owners[window][-1] != item:
                self.owners[window].append(item)
            return
        self.owners[window] = [item]
        for at in range(self.stride):
            part = window[at : at + self.block]
            self.shift[part] = min(self.shift.get(part, self.stride), self.stride - 1 - at)
        self.suffixes[hash(window[-self.block :])].append(window)

    def search(self, words: list[bytes]) -> list[tuple[int, tuple]]:
        """(start, window) of all occurrences.

        Of the blocks of an occurrence exactly one stands at a multiple of the stride, so the jumps by the largest
        shift are taken all at once: only around a block of the table are the single positions tried.
        """
        n, length, block, stride, shift = len(words), self.length, self.block, self.stride, self.shift
        if n < length:
            return []
        first = stride - 1
        sampled = zip(words[first::stride], words[first + 1 :: stride], strict=False) if block == 2 else zip(words[first::stride], strict=True)
        found, free = [], 0
        for k in [k for k, part in enumerate(sampled) if part in shift]:
            at = max(first + k * stride - stride + 1, free)
            last = min(first + k * stride, n - length)
            while at <= last:
                tail = tuple(words[at + length - block : at + length])
                step = shift.get(tail, stride)
                if not step:
                    for window in self.suffixes.get(hash(tail), ()):
                        if words[at] == window[0] and tuple(words[at : at + length]) == window:
                            found.append((at, window))
                    step = 1
                at += step
            free = at
        return found


def build(items: list[tuple[str, bytes | None]]) -> list[WuManber]:
    """Matchers of the items' windows by length; owners are indexes into items."""
    matchers: dict[int, WuManber] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        length = min(WINDOW, len(words))
        if length:
            matcher = matchers.setdefault(length, WuManber(length))
            for at in range(len(words) - length + 1):
                matcher.add(tuple(words[at : at + length]), number)
    return list(matchers.values())


def _word_pieces(text: bytes):
    """Lists of the words of the text, PIECE_BYTES of it at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield words_of(text[at:end])
        at = end


def scan(text: bytes | None, matchers: list[WuManber]) -> tuple[int, np.ndarray, np.ndarray, set[int]]:
    """Words of the text, the starts and ends of the word runs that are hit, and the items that occur."""
    spans, windows, words, base = [], set(), [], 0
    for piece in _word_pieces(text or b""):
        kept = words[1 - WINDOW :]  # a window may begin in the piece before
        base += len(words) - len(kept)
        words = kept + piece
        for matcher in matchers:
            for at, window in matcher.search(words):
                spans.append((base + at, base + at + matcher.length))
                windows.add((matcher, window))
    total = base + len(words)
    items = {i for matcher, window in windows for i in matcher.owners[window]}
    if not spans:
        return total, np.zeros(0, np.int64), np.zeros(0, np.int64), items
    spans.sort()
    starts, ends = np.array(spans, np.int64).T
    ends = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return total, starts[new], np.concatenate((ends[:-1][new[1:]], ends[-1:])), items


class _Items(list):
    """A slice of the benchmark; a worker builds its matchers once."""

    _matchers = None

    def matchers(self) -> list[WuManber]:
        if self._matchers is None:
            self._matchers = build(self)
        return self._matchers


#: The added columns.
ADDED = {"n_words": T.LongType(), "starts": T.ArrayType(T.LongType()), "ends": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}


def _slices(benchmark: DataFrame, slice_words: int):
    """The items (id as string, text) in lists of bounded size; null ids and texts without words have no part in it."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (8 * slice_words)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield n, _Items((r["id"], bytes(r["text"])) for r in part.orderBy("id", "text").toLocalIterator())


def _pass(docs: DataFrame, keep: list[str], items: _Items, only_hits: bool, names: list[str]) -> DataFrame:
    """The columns `keep` of docs with those of ADDED, by the given names."""
    back = [k for k, c in enumerate(docs.columns) if c in keep]
    at = docs.columns.index("text")
    fields = docs.select(*[F.col(f"`{docs.columns[k]}`") for k in back]).schema.fields
    schema = T.StructType([*fields, *(T.StructField(name, kind) for name, kind in zip(names, ADDED.values(), strict=True))])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def rows(batches):
        matchers = shared.value.matchers()
        ids = [i for i, _ in shared.value]
        for batch in batches:
            for part in row_groups(batch, at):
                got = [scan(x.as_py(), matchers) for x in part.column(at).cast(pa.large_binary())]
                if only_hits:
                    some = [k for k, x in enumerate(got) if x[3]]
                    part, got = part.take(pa.array(some, pa.int64())), [got[k] for k in some]
                found = [
                    pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array([x[2] for x in got], pa.list_(pa.int64())),
                    pa.array([sorted({ids[i] for i in x[3]}) for x in got], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in back], *found], names=schema.names)

    return docs.mapInArrow(rows, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, slice_words: int = SLICE_WORDS, into: str | None = None) -> DataFrame:
    """docs, or its columns `keep`, with n_words, starts and ends (the word runs hit), and items (ids as strings, sorted).

    Columns of these names are replaced; with `into`, the four are fields of one column of that name instead and all
    others stay. A null or empty text has no words. Repeated rows, null ids and other columns pass through. Repeated
    item ids count once; items without an id or a word are left out. A benchmark of over `slice_words` words is searched
    for in several passes, each with a bounded table; the passes' hits meet by document id and text hash.
    """
    replaced = [into] if into else list(ADDED)
    keep = [c for c in (keep or docs.columns) if c not in replaced]
    names = private(docs, *(f"_{c}" for c in ADDED))
    found = [F.col(name).alias(c) for name, c in zip(names, ADDED, strict=True)]
    shown = [F.struct(*found).alias(into)] if into else found
    kept = [F.col(f"`{c}`") for c in docs.columns if c in keep]
    parts, h = [], private(docs, "_h")[0]
    for n, items in _slices(benchmark, slice_words):
        if n == 1:
            return _pass(docs, keep, items, False, names).select(*kept, *shown)
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        parts.append(cut(_pass(hashed, ["doc_id", "h"], items, True, list(ADDED)).distinct()))
    everything = parts[0]
    for x in parts[1:]:
        everything = everything.union(x)
    merged = everything.groupBy("doc_id", "h").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"), F.array_distinct(F.array_sort(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = F.aggregate(
        "runs",
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda a, r: F.when((F.size(a) > 0) & (F.element_at(a, -1)["ends"] >= r["starts"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["starts"].alias("starts"), F.greatest(F.element_at(a, -1)["ends"], r["ends"]).alias("ends"))))).otherwise(F.concat(a, F.array(r))),
    )
    merged = merged.withColumn("runs", joined).select("doc_id", "h", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items")
    empty = _pass(docs.withColumn(h, F.xxhash64("text")), [*keep, "doc_id", h], _Items(), False, names).drop(*names[1:])
    out = empty.alias("d").join(merged.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col(f"d.{h}") == F.col("m.h")), "left")
    none = "cast(array() as array<{}>)"
    made = [F.coalesce(f"m.{c}", F.expr(none.format("string" if c == "items" else "bigint"))).alias(name) for c, name in zip(list(ADDED)[1:], names[1:], strict=True)]
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns if c in keep], f"d.{names[0]}", *made).select(*kept, *shown)


def with_digests(found: DataFrame, *columns: str) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        *columns, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_digests(find_leaks(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]), "doc_id")


#: A document's words are compared as 8-word joins with the items' windows; n_hit counts words under a matched window.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[p : p + least(len(w), 8) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM hit) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(t.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256,
       coalesce(len(t.items), 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
