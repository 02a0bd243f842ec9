"""Removal of repeated byte strings, by longest-previous-factor arrays over partitioned suffixes.

A byte goes if some string of MIN_BYTES bytes that covers it also starts in a document with a smaller doc_id. Every such
string (a window, the part of a suffix that counts) holds an anchor: of its K-grams the one with the smallest hash, the
leftmost of equals. Equal windows have equal anchors, so windows meet by anchor and the work splits into independent
parts, each with a suffix order, the common prefixes of its neighbours, and the longest previous factors that follow from
previous and next smaller documents in that order:

1. Each batch of documents lists its anchors; counting their hashes over all batches shows which occur more than once.
2. For those only, the stretch of windows around the anchor is sent by its names, two independent hashes of 64 bits, to
   the part of the first. In the order of names, equal stretches are neighbours that have all in common and others have
   nothing, so the longest previous factor tells which stretches stand whole in an earlier document.
3. The first of each kind, where an anchor has several kinds of stretches, is then sent as text. The suffixes of a part
   are sorted by their bytes, and the longest previous factor tells which windows stand in an earlier document.
4. Each batch merges what was found into the removed runs of its documents.

An anchor that occurs HOT times or more could put many kinds of stretches into one part: its windows are sent one by
one, named by two independent hashes of their own. Equal stretches of a batch are sent once, so a part gets one for each
batch at most. Parts are keys and not tasks: their number grows with the input and their size does not.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_groups, shared_dir, table

MIN_BYTES = 50
K = 26
HOT = 4096
BATCH_BYTES = 2 << 20
#: Input bytes, as stored, to a bucket of the batch table; and parts of the hash space to a bucket.
BUCKET_BYTES, PARTS = 4 << 20, 4
_LAST = 2**63 - 1
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTE, _BYTE_2 = np.random.default_rng(50).integers(0, 2**64, (2, 256), np.uint64, endpoint=False)


def _wider(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of the strings that join each string with the one `by` bytes further."""
    out = h[:-by] * _C1
    out ^= h[:-by] >> np.uint64(31)
    out += h[by:]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    h, width = _BYTE[data], 1
    while 2 * width <= size:
        h, width = _wider(h, width), 2 * width
    if width < size:
        h = _wider(h, size - width)
    return _mixed(h)


def runs(data: np.ndarray, bounds: np.ndarray, size: int = MIN_BYTES, k: int = K, own: bool = False, piece: int = 1 << 17) -> list[np.ndarray]:
    """Of each run of windows that share an anchor: its hash, the first and last window start, and if `own` a hash of all.

    bounds are the offsets of the documents in data; windows stay inside a document. A run has size - k + 1 windows at
    most and its first and last overlap, so their hashes and distance stand for its whole text.
    """
    span, total = size - k + 1, len(data) - size + 1
    kinds = (np.uint64, np.int64, np.int64, np.uint64)
    found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in kinds]
    inside = np.zeros(len(data) + 1, np.int8)
    starts, ends = bounds[:-1], bounds[1:] - size + 1
    real = ends > starts
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, ends[real], -1)
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    for at in range(0, total, piece):
        n = min(piece, total - at)
        if not inside[at : at + n].any():
            continue
        text = data[at : at + n + size - 1]
        grams = _gram_hashes(text, k)
        low = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < span:
            low = np.minimum(low[: width - span], low[span - width :])
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        anchor[~inside[at : at + n]] = -1
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((new[1:], [n])) - 1
        good = anchor[new] >= 0
        new, last = new[good], last[good]
        found[0].append(_mixed(grams[anchor[new]] ^ _C2))  # anchors have small hashes; the parts need even ones
        found[1].append(new + at)
        found[2].append(last + at)
        if own:
            whole = _gram_hashes(text, size)
            found[3].append(_mixed(whole[new] * _C1 + (whole[last] ^ _C2) + (last - new).astype(np.uint64)))
    return [np.concatenate(x) for x in found]


def earlier_matches(owners: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, the longest common prefix with one of a smaller owner.

    shared is the common prefix of each suffix with the one before it. A stack holds the suffixes whose next smaller
    owner isn't known yet, with the common prefix with their previous smaller one and with the suffix below them, so
    each meets its previous and its next smaller owner once (after Crochemore and Ilie 2008, who have no ties).
    """
    found = [0] * len(owners)
    stack: list[tuple[int, int, int, int]] = []
    for at, (owner, common) in enumerate(zip([*owners.tolist(), None], [*shared.tolist(), 0], strict=True)):
        while stack and (owner is None or owner < stack[-1][1]):
            top, _, before, below = stack.pop()
            found[top] = max(before, common)
            common = min(below, common)
        same = stack and stack[-1][1] == owner
        stack.append((at, owner, min(stack[-1][2], common) if same else common if stack else 0, common))
    return np.array(found, np.int64)


def longest_previous_factors(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, the longest match with an earlier place; order lists the places in suffix order."""
    found = np.zeros(len(order), np.int64)
    found[order] = earlier_matches(order, shared)
    return found


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space; grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _batch_arrays(ids, texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    parts = [x or b"" for x in texts]
    data = b"".join(parts)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    return data, np.frombuffer(data, np.uint8), bounds, np.array([_LAST if i is None else i for i in ids], np.int64)


def _segments(sorted_parts: np.ndarray):
    if len(sorted_parts):
        edges = np.flatnonzero(np.concatenate(([True], sorted_parts[1:] != sorted_parts[:-1], [True])))
        yield from ((int(sorted_parts[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True))


def _pack(size: int):
    """Documents as rows of about `size` bytes: batch, ids, texts."""

    def rows(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for part in row_groups(batch, 1, size):
                for i, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    if ids and held + len(x or b"") > size:
                        yield _packed(number, ids, texts)
                        number, ids, texts, held = number + 1, [], [], 0
                    ids.append(i)
                    texts.append(x or b"")
                    held += len(x or b"")
        if ids:
            yield _packed(number, ids, texts)

    return rows


def _packed(number, ids, texts):
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["batch", "ids", "texts"])


def _list_anchors(parts: int, size: int):
    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                number, ids, texts = (c[k].as_py() for c in batch.columns)
                _, data, bounds, _ = _batch_arrays(ids, texts)
                keys, counts = np.unique(runs(data, bounds, size)[0], return_counts=True)
                counts = np.minimum(counts, 65535).astype(np.uint16)
                out = [(part, number, keys[a:b].tobytes(), counts[a:b].tobytes()) for part, a, b in _segments(_part(keys, parts))]
                yield from _rows(out, pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])).to_batches()

    return rows


def _count_anchors(group: pa.Table) -> pa.Table:
    """For each batch, a byte for each of its anchors in this part: 0 seen once, 1 repeated, 2 hot. Rows of zeros go."""
    keys, sizes = _joined(group.column("keys"), np.uint64)
    counts, _ = _joined(group.column("counts"), np.uint16)
    _, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, counts)[back]
    return _coded(group, ((total >= 2).astype(np.uint8) + (total >= HOT)).astype(np.uint8), sizes, 1)


class _Stretches:
    """The stretches of a batch around its repeated anchors, in the order of key, kind and doc_id."""

    def __init__(self, batch: pa.Table, codes: pa.Table, parts: int, size: int):
        ids, texts = batch.column("ids")[0].as_py(), batch.column("texts")[0].as_py()
        self.data, array, bounds, docs = _batch_arrays(ids, texts)
        anchors, first, last, kind = runs(array, bounds, size, own=True)
        keys, back = np.unique(anchors, return_inverse=True)
        mine = _decoded(codes, 1, _part(keys, parts))[back]
        warm, hot = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
        key, kind, lo, hi = anchors[warm], kind[warm], first[warm], last[warm]
        if len(hot):
            reach = last[hot] - first[hot] + 1
            each = np.repeat(first[hot] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            windows = np.lib.stride_tricks.sliding_window_view(array, size)
            own, other = (np.concatenate([_gram_rows(windows[each[a : a + 65536]], *x) for a in range(0, len(each), 65536)]) for x in ((_BYTE, _C1), (_BYTE_2, _C3)))
            key, kind = np.concatenate((key, _mixed(own))), np.concatenate((kind, _mixed(other)))
            lo, hi = np.concatenate((lo, each)), np.concatenate((hi, each))
        doc = docs[np.searchsorted(bounds, lo, side="right") - 1]
        order = np.lexsort((lo, doc, kind, key))
        self.key, self.kind, self.lo, self.stop, self.doc = key[order], kind[order], lo[order], hi[order] + size, doc[order]
        same = (self.key[1:] == self.key[:-1]) & (self.kind[1:] == self.kind[:-1])
        self.head = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
        self.group = np.repeat(np.arange(len(self.head)), np.diff(np.concatenate((self.head, [len(order)]))))
        self.part = _part(self.key[self.head], parts)


def _decoded(codes: pa.Table, step: int, part: np.ndarray) -> np.ndarray:
    """A code for each of the keys whose ascending parts are given; parts without a row have zeros."""
    out = np.zeros(len(part), np.uint8)
    where = {p: (a, b) for p, a, b in _segments(part)}
    for k, p, found in zip(*[codes.column(c).to_pylist() for c in ("step", "part", "codes")], strict=True):
        if k == step:
            a, b = where[p]
            out[a:b] = np.frombuffer(found, np.uint8)
    return out


_HASHES = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("kinds", pa.binary()), ("docs", pa.binary())])


def _list_hashes(parts: int, size: int):
    def rows(batch: pa.Table, codes: pa.Table) -> pa.Table:
        if not codes.num_rows or not batch.num_rows:
            return _HASHES.empty_table()
        _freed()
        x, number = _Stretches(batch, codes, parts, size), batch.column("batch")[0].as_py()
        key, kind, doc = x.key[x.head], x.kind[x.head], x.doc[x.head]
        return _rows([(part, number, key[a:b].tobytes(), kind[a:b].tobytes(), doc[a:b].tobytes()) for part, a, b in _segments(x.part)], _HASHES)

    return rows


def _freed() -> None:
    """Gives freed memory back to the system, as a worker lives on for many groups."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CODES = pa.schema([("batch", pa.int64()), ("step", pa.int32()), ("part", pa.int64()), ("codes", pa.binary())])


def _coded(group: pa.Table, codes: np.ndarray, sizes: list[int], step: int) -> pa.Table:
    """codes cut back into the group's rows; rows of zeros go."""
    edges = np.cumsum([0, *sizes])
    pieces = [codes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _rows([(n, step, p, c.tobytes()) for n, p, c in zip(group.column("batch").to_pylist(), group.column("part").to_pylist(), pieces, strict=True) if c.any()], _CODES)


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, list[int]]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind), [len(x) // np.dtype(kind).itemsize for x in blobs]


def _settle(group: pa.Table) -> pa.Table:
    """1: the same stretch stands in an earlier document. 2: it is the first, but its anchor has other kinds of stretches."""
    keys, sizes = _joined(group.column("keys"), np.uint64)
    kinds, _ = _joined(group.column("kinds"), np.uint64)
    docs, _ = _joined(group.column("docs"), np.int64)
    order = np.lexsort((docs, kinds, keys))
    key, kind, doc = keys[order], kinds[order], docs[order]
    other = key[1:] != key[:-1]
    new_key, new = np.concatenate(([True], other)), np.concatenate(([True], other | (kind[1:] != kind[:-1])))
    several = np.bincount(np.cumsum(new_key) - 1, new)[np.cumsum(new_key) - 1] > 1
    codes = np.zeros(len(order), np.uint8)
    codes[order] = np.where(earlier_matches(doc, (~new).astype(np.int64)) > 0, 1, np.where(several, 2, 0))
    return _coded(group, codes, sizes, 2)


_STRETCHES = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("texts", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("done", pa.list_(pa.int64()))])
_STRETCHES_SQL = "part bigint, batch bigint, texts array<binary>, docs array<bigint>, starts array<bigint>, done array<bigint>"
_MARKS = pa.schema([("batch", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _list_texts(parts: int, size: int):
    """The stretches that are still open, and the settled ones as byte ranges, which only pass through a part."""

    def rows(batch: pa.Table, codes: pa.Table) -> pa.Table:
        if not codes.num_rows or not batch.num_rows:
            return _STRETCHES.empty_table()
        _freed()
        x, number = _Stretches(batch, codes, parts, size), batch.column("batch")[0].as_py()
        code = _decoded(codes, 2, x.part)
        done = (code[x.group] == 1) | (x.doc > x.doc[x.head][x.group])
        out = []
        if done.any():
            order = np.argsort(x.lo[done], kind="stable")
            lo, hi = _merged(x.lo[done][order], x.stop[done][order], False)
            out.append((number % parts, number, [], [], [], np.column_stack((lo, hi)).ravel()))
        left = np.flatnonzero(~done & (code[x.group] == 2))
        for part, a, b in _segments(x.part[x.group[left]]):
            some = left[a:b]
            texts = [x.data[s:e] for s, e in zip(x.lo[some].tolist(), x.stop[some].tolist(), strict=True)]
            out.append((part, number, texts, x.doc[some], x.lo[some], []))
        return _rows(out, _STRETCHES)

    return rows


def _gram_rows(rows: np.ndarray, values: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A hash of each row of bytes."""
    h = np.zeros(len(rows), np.uint64)
    for column in range(rows.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * factor + values[rows[:, column]]
    return h


def _one(column: pa.ChunkedArray) -> pa.Array:
    got = column.combine_chunks()
    return got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], column.type)


def _resolve(size: int):
    def rows(group: pa.Table) -> pa.Table:
        columns = {c: _one(group.column(c)) for c in ("batch", "texts", "docs", "starts", "done")}
        batch = columns["batch"].to_numpy()
        owner = np.repeat(np.arange(len(batch)), np.diff(columns["docs"].offsets.to_numpy()))
        docs, starts = (columns[c].flatten().to_numpy() for c in ("docs", "starts"))
        texts = columns["texts"].flatten()
        code = texts.dictionary_encode()  # equal stretches get equal codes
        kind, texts = code.indices.to_numpy().astype(np.int64), code.dictionary
        length = pa.compute.binary_length(texts).cast(pa.int64()).to_numpy()
        marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = columns["done"]
        if len(done.flatten()):
            pairs = done.flatten().to_numpy().reshape(-1, 2)
            marks.append((np.repeat(np.arange(len(batch)), np.diff(done.offsets.to_numpy()) // 2), pairs[:, 0], pairs[:, 1]))
        if len(kind):
            least = np.full(len(texts), _LAST)
            np.minimum.at(least, kind, docs)
            late = docs > least[kind]
            marks.append((owner[late], starts[late], starts[late] + length[kind[late]]))
            mixed = np.arange(len(texts))
            if len(mixed):
                mixed = mixed[np.argsort(least[mixed], kind="stable")]
                pieces = [texts[int(t)].as_py() for t in mixed]
                n = length[mixed] - size + 1
                whole = np.frombuffer(b"".join(pieces), np.uint8)
                base = np.cumsum(length[mixed]) - length[mixed]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rank = np.repeat(np.arange(len(mixed)), n)
                # The suffixes that are a window long or more, in the order of their first `size` bytes.
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, size)[np.repeat(base, n) + inner])
                order = np.argsort(windows.view(f"S{size}").ravel(), kind="stable")
                ordered = windows[order]
                same = ordered[1:] == ordered[:-1]
                common = np.concatenate(([0], np.where(same.all(1), size, same.argmin(1))))
                hit = np.zeros(len(order), bool)
                hit[order] = earlier_matches(least[mixed][rank][order], common) >= size
                holders = np.flatnonzero(~late)
                slot = np.full(len(texts), -1)
                slot[mixed] = np.arange(len(mixed))
                first = np.cumsum(n) - n
                for h in holders.tolist():
                    s = slot[kind[h]]
                    found = np.flatnonzero(hit[first[s] : first[s] + n[s]])
                    if len(found):
                        marks.append((np.full(len(found), owner[h]), starts[h] + found, starts[h] + found + size))
        out = []
        if marks:
            owner, lo, hi = (np.concatenate(x) for x in zip(*marks, strict=True))
            order = np.lexsort((lo, owner))
            owner, lo, hi = owner[order], lo[order], hi[order]
            for o, a, b in _segments(owner):
                out.append((int(batch[o]), *_merged(lo[a:b], hi[a:b], False)))  # runs of neighbouring documents may touch
        return _rows(out, _MARKS)

    return rows


def _merged(lo: np.ndarray, hi: np.ndarray, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    """Intervals sorted by their starts, without overlap and, if so told, without touch."""
    hi = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > hi[:-1] if touching else lo[1:] >= hi[:-1]))
    return lo[new], np.concatenate((hi[:-1][new[1:]], hi[-1:]))


def _cut_documents(batch: pa.Table, marks: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
    if not batch.num_rows:
        return schema.empty_table()
    ids, texts = batch.column("ids")[0].as_py(), batch.column("texts")[0].as_py()
    _, _, bounds, _ = _batch_arrays(ids, texts)
    lo = marks.column("starts").combine_chunks().flatten().to_numpy() if marks.num_rows else np.zeros(0, np.int64)
    hi = marks.column("ends").combine_chunks().flatten().to_numpy() if marks.num_rows else np.zeros(0, np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    at = np.searchsorted(lo, bounds)
    starts, ends, kept = [], [], []
    for k, text in enumerate(texts):
        if at[k] == at[k + 1]:
            starts.append([])
            ends.append([])
            kept.append(text)
            continue
        a, b = _merged(lo[at[k] : at[k + 1]] - bounds[k], hi[at[k] : at[k + 1]] - bounds[k], True)
        starts.append(a)
        ends.append(b)
        edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(text)]
        kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
    return pa.table([pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], schema=schema)


def _stored_bytes(docs: DataFrame) -> int:
    """Bytes of the files behind docs; where a source has no known size, bytes of text, which takes one more scan."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    unknown = int(docs.sparkSession.sparkContext._jvm.java.lang.Long.MAX_VALUE)
    if any(size >= unknown for size in sizes):
        return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(sum(sizes), int(str(plan.stats().sizeInBytes())))  # joins multiply sizes


def remove_repeats(docs: DataFrame, size: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the removed runs and the bytes that are left, for each row of docs.

    A null text is empty. A null doc_id counts as larger than all others. Rows with equal ids never remove from each
    other. The documents are written once, in batches, to the shared folder as a bucketed table, so that the three
    reads of a batch need no shuffle of texts; only anchor hashes and the stretches of repeated ones travel.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    stored = _stored_bytes(docs)
    # Spark makes 100,000 buckets at most. Larger ones take longer, but no more memory: batches and parts keep their size.
    buckets = int(min(max(-(-stored // BUCKET_BYTES), 8), 100_000))
    name = f"octoplex_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(_pack(BATCH_BYTES), "batch bigint, ids array<bigint>, texts array<binary>")
    packed.write.bucketBy(buckets, "batch").option("path", f"{shared_dir(spark)}/octoplex/{name}").format("parquet").saveAsTable(name)
    batches = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    parts = int(max(-(-stored // BUCKET_BYTES), 8)) * PARTS
    anchors = batches.mapInArrow(_list_anchors(parts, size), "part bigint, batch bigint, keys binary, counts binary")
    coded = "batch bigint, step int, part bigint, codes binary"
    repeated = cut(anchors.groupBy("part").applyInArrow(_count_anchors, coded))
    hashes = batches.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInArrow(_list_hashes(parts, size), "part bigint, batch bigint, keys binary, kinds binary, docs binary")
    codes = repeated.union(hashes.groupBy("part").applyInArrow(_settle, coded))
    stretches = batches.groupBy("batch").cogroup(codes.groupBy("batch")).applyInArrow(_list_texts(parts, size), _STRETCHES_SQL)
    marks = stretches.groupBy("part").applyInArrow(_resolve(size), "batch bigint, starts array<bigint>, ends array<bigint>")
    return batches.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(_cut_documents, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def op9_query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
