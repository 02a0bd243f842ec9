"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features gives one lookup table for each feature and one for each of the
strongest feature pairs. A score is the logistic of the sum of the tables' entries, so scoring is vectorised addition.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups

#: Labelled rows that a fit reads at most, chosen by a hash of doc_id. The model has a few thousand table entries.
MAX_TRAIN_ROWS = 20_000
#: Bytes of text whose features are computed at once, also of a longer text. The arrays take about 40 times as much.
GROUP_BYTES = 1 << 20

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "space", "newline", "non_ascii",
    "exclaim", "stop", "symbol", "pipe", "word_kinds", "triple_kinds", "line_kinds",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\n\x0b\x0c", "newline": b"\n",
    "non_ascii": bytes(range(128, 256)), "exclaim": b"!?", "stop": b".,;:", "symbol": b"#$%&*@^~+=<>\\/_{}[]", "pipe": b"|",
}
_SPACE = np.isin(np.arange(256), list(_CLASSES["space"]))
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_M, _M_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (prefix[ends] - prefix[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _raw(data: np.ndarray) -> int:
    """The polynomial hash of a span, before it is mixed."""
    powers = _power_tables(len(data) + 1)[0][: len(data)]
    return int(((data.astype(np.uint64) + np.uint64(1)) * powers).sum(dtype=np.uint64))


def _joined_hash(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of two spans, one after the other."""
    return (left[0] + right[0] * pow(int(_M), left[1], 1 << 64)) % (1 << 64), left[1] + right[1]


def _mixed_hash(span: tuple[int, int]) -> int:
    h = np.array([span[0]], np.uint64) + np.array([span[1]], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return int(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))[0])


def _triples(h: np.ndarray) -> np.ndarray:
    return h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x100000001B3) + h[2:] * np.uint64(0x27D4EB2F165667C5)


class _Distinct:
    """Distinct and all hashes of one kind, gathered piece by piece."""

    def __init__(self):
        self.seen, self.new, self.total = np.zeros(0, np.uint64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.total += len(hashes)
        self.new.append(np.unique(hashes))
        if sum(map(len, self.new)) > max(len(self.seen), 1 << 18):
            self._merge()

    def _merge(self) -> None:
        self.seen, self.new = np.unique(np.concatenate([self.seen, *self.new])), []

    def share(self) -> float:
        self._merge()
        return len(self.seen) / self.total if self.total else 1.0


def long_features(data: np.ndarray, piece: int | None = None) -> np.ndarray:
    """FEATURES of one text, `piece` bytes at a time: the same as of the whole, but for 8 bytes a distinct word and line."""
    piece = piece or GROUP_BYTES
    counts, kinds = dict.fromkeys(_CLASSES, 0), {k: _Distinct() for k in ("word_kinds", "triple_kinds", "line_kinds")}
    words, letters, longest = 0, 0, 0
    word, line, last = (0, 0), (0, 0), np.zeros(0, np.uint64)  # what the pieces so far have left open

    def ended(hashes: np.ndarray) -> np.ndarray:
        """Counts words; gives the last two of all."""
        kinds["word_kinds"].add(hashes)
        run = np.concatenate((last, hashes))
        if len(run) > 2:
            kinds["triple_kinds"].add(_triples(run))
        return run[-2:]

    for at in range(0, len(data), piece):
        part = data[at : at + piece]
        for name, members in _CLASSES.items():
            counts[name] += int(np.isin(np.arange(256), list(members))[part].sum())
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_tables(len(part) + 1)[0][: len(part)], out=prefix[1:])
        solid = np.concatenate(([False], ~_SPACE[part], [False]))
        starts, ends = np.flatnonzero(~solid[:-1] & solid[1:]), np.flatnonzero(solid[:-1] & ~solid[1:])
        if word[1] and not (len(starts) and starts[0] == 0):  # the open word ends here
            words, letters, longest = words + 1, letters + word[1], max(longest, word[1])
            last, word = ended(np.array([_mixed_hash(word)], np.uint64)), (0, 0)
        elif word[1]:
            word = _joined_hash(word, (_raw(part[: ends[0]]), int(ends[0])))
            starts, ends = starts[1:], ends[1:]
            if word[1] and _SPACE[part].any():
                words, letters, longest = words + 1, letters + word[1], max(longest, word[1])
                last, word = ended(np.array([_mixed_hash(word)], np.uint64)), (0, 0)
        if len(ends) and ends[-1] == len(part):
            word = (_raw(part[starts[-1] :]), int(ends[-1] - starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            sizes = ends - starts
            words, letters, longest = words + len(starts), letters + int(sizes.sum()), max(longest, int(sizes.max()))
            last = ended(_span_hashes(prefix, starts, ends))
        stops = np.flatnonzero(part == 10) + 1
        if len(stops):
            line = _joined_hash(line, (_raw(part[: stops[0]]), int(stops[0])))
            kinds["line_kinds"].add(np.concatenate((np.array([_mixed_hash(line)], np.uint64), _span_hashes(prefix, stops[:-1], stops[1:]))))
            line = (0, 0)
        rest = part[stops[-1] if len(stops) else 0 :]
        line = _joined_hash(line, (_raw(rest), len(rest)))
    if word[1]:
        words, letters, longest = words + 1, letters + word[1], max(longest, word[1])
        ended(np.array([_mixed_hash(word)], np.uint64))
    if line[1]:
        kinds["line_kinds"].add(np.array([_mixed_hash(line)], np.uint64))
    found = {"log_bytes": np.log1p(len(data)), "log_words": np.log1p(words), "word_bytes": letters / max(words, 1), "longest_word": min(longest, 1000)}
    found |= {name: n / max(len(data), 1) for name, n in counts.items()} | {name: x.share() for name, x in kinds.items()}
    return np.array([[found[name] for name in FEATURES]], float)


def _kinds(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct over all hashes of each owner; 1 where there are none."""
    total = np.bincount(owner, minlength=n)
    mixed = hashes ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(mixed)
    first = np.ones(len(order), bool)
    first[1:] = mixed[order][1:] != mixed[order][:-1]
    return np.where(total, np.bincount(owner[order[first]], minlength=n) / np.maximum(total, 1), 1.0)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; a null text counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    if n == 1 and size[0] > GROUP_BYTES:
        return long_features(data)
    full = np.flatnonzero(size)
    out = {name: np.zeros(n) for name in FEATURES} | {k: np.ones(n) for k in ("word_kinds", "triple_kinds", "line_kinds")}
    out["log_bytes"] = np.log1p(size)
    if len(full):
        for name, members in _CLASSES.items():
            hit = np.isin(np.arange(256), list(members)).view(np.uint8)[data]
            out[name][full] = np.add.reduceat(hit, bounds[full], dtype=np.int64) / size[full]
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(len(data) + 1)[0][: len(data)], out=prefix[1:])
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds[full]] = True
        solid = ~_SPACE[data]
        starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1]))
        ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | np.concatenate((edge[1:-1], [True])))) + 1
        owner = np.searchsorted(bounds, starts, side="right") - 1
        owner = np.minimum(owner, n - 1)
        count = np.bincount(owner, minlength=n)
        out["log_words"] = np.log1p(count)
        out["word_bytes"] = np.bincount(owner, ends - starts, minlength=n) / np.maximum(count, 1)
        np.maximum.at(out["longest_word"], owner, np.minimum(ends - starts, 1000))
        if len(starts):
            h = _span_hashes(prefix, starts, ends)
            out["word_kinds"] = _kinds(owner, h, n)
            same = owner[2:] == owner[:-2]
            out["triple_kinds"] = _kinds(owner[2:][same], _triples(h)[same], n)
        stops = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate((bounds[full], stops + 1)))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.concatenate((line_starts[1:], [len(data)]))
        line_owner = np.minimum(np.searchsorted(bounds, line_starts, side="right") - 1, n - 1)
        out["line_kinds"] = _kinds(line_owner, _span_hashes(prefix, line_starts, line_ends), n)
    return np.column_stack([out[name] for name in FEATURES])


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    return -g / (h + ridge)


def _gain(g, h, ridge: float = 1.0):
    return g * g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins into two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree_1d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of depth two."""
    out = np.empty(len(g))
    _, at = _best_cut(g, h)
    for lo, hi in ((0, at), (at, len(g))):
        if hi <= lo:
            continue
        _, inner = _best_cut(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + inner), (lo + inner, hi)):
            if b > a:
                out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that splits one axis, then the other on either side."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(a.sum(1), b.sum(1))
        out, total = np.zeros_like(a), 0.0
        for lo, hi in ((0, at), (at, len(a))):
            if hi <= lo:
                continue
            col_g, col_h = a[lo:hi].sum(0), b[lo:hi].sum(0)
            _, inner = _best_cut(col_g, col_h)
            for c, d in ((0, inner), (inner, a.shape[1])):
                if d > c:
                    out[lo:hi, c:d] = _leaf(col_g[c:d].sum(), col_h[c:d].sum())
                    total += _gain(col_g[c:d].sum(), col_h[c:d].sum())
        if total > best[0]:
            best = (total, out.T if turned else out)
    return best


class PairwiseGam:
    """Lookup tables learned by cyclic boosting; `score` adds them up."""

    def __init__(self, bins: int = 32, rounds: int = 120, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15):
        self.bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate = bins, rounds, pairs, pair_rounds, rate

    def _place(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        """Tables for labels y (0/1). With no rows at all, every score is 0.5."""
        width = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        if not len(x):
            return self
        at, f = self._place(x), np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return p - y, p * (1 - p)

        for _ in range(self.rounds):
            for i, lookup in enumerate(self.tables):
                g, h = slopes()
                step = self.rate * _tree_1d(np.bincount(at[:, i], g, len(lookup)), np.bincount(at[:, i], h, len(lookup)))
                lookup += step
                f += step[at[:, i]]
        g, h = slopes()
        ranked = []
        for i, j in itertools.combinations(range(width), 2):
            ranked.append((_tree_2d(*self._grid(at, i, j, g, h))[0], i, j))
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for _, i, j in sorted(ranked, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, lookup in self.pairs:
                step = self.rate * _tree_2d(*self._grid(at, i, j, *slopes()))[1]
                lookup += step
                f += step[at[:, i], at[:, j]]
        return self

    def _grid(self, at, i, j, g, h):
        shape = (len(self.tables[i]), len(self.tables[j]))
        cell = at[:, i] * shape[1] + at[:, j]
        return [np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self._place(x)
        total = np.full(len(x), self.base)
        for i, lookup in enumerate(self.tables):
            total += lookup[at[:, i]]
        for i, j, lookup in self.pairs:
            total += lookup[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: str = "doc_id"):
    """True for the third of the ids that no fit may see; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, label: str = "quality", **options) -> PairwiseGam:
    """Fits on at most `max_rows` labelled documents outside the held-out third.

    Rows with a null id or label are ignored. A repeated id counts once: by its mean label, and by the row of the
    smallest features. The ids of the sample, a bounded list, are broadcast to the scan of the documents, and a feature
    row for each of them reaches the driver.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.avg(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y", "doc_id")

    def rows(batches):
        for batch in batches:
            for part in row_groups(batch, 0, GROUP_BYTES):
                x = text_features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *part.columns[1:]], names=["x", "y", "doc_id"])

    got = sample.mapInArrow(rows, "x array<double>, y double, doc_id bigint").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = (got.column("y").to_numpy() >= 0.5).astype(float)
    order = np.lexsort((*x.T, y))
    return PairwiseGam(**options).fit(x[order], y[order])


def score_documents(docs: DataFrame, model: PairwiseGam, column: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with the score of each whole text, from 0 to 1. Null texts count as empty.

    An existing column of the score's name is replaced.
    """
    keep = [c for c in (keep or docs.columns) if c != column]
    back = [k for k, c in enumerate(docs.columns) if c in keep]
    at = docs.columns.index("text")
    schema = docs.select(*[F.col(f"`{docs.columns[k]}`") for k in back]).schema.add(column, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in row_groups(batch, at, GROUP_BYTES):
                score = shared.value.score(text_features(part.column(at)))
                kept = [part.column(k) for k in back]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=schema.names)

    return docs.mapInArrow(rows, schema)


def op1_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, "score", ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
