"""Near duplicates by the exact Jaccard similarity of word shingles, found by prefix filtering.

All documents' shingle hashes are put in one order. Of a set of n shingles, the first n - ceil(t n) + 1 are its prefix:
two sets of similarity t or more share a shingle of both prefixes. So only documents that share one are compared. Of
these pairs, SimHash fingerprints of 1024 bits discard those that differ in more bits than similar sets ever do (see
`most_bits`), and the whole sets decide about the rest. The order puts shingles that a sample of the documents holds
several times last, the most frequent ones at the very end; it has no influence on the result. The sample is a fixed share
of the documents, so that shingles of some 32 documents and more are mostly listed however large the corpus is, and groups
of unlike documents don't grow with it until more than LISTED are so frequent.

In a group that shares a shingle one member is the pivot: the one that meets most others. All are compared with it, and
what that links needs no further comparison, so a large group of copies costs as many comparisons as it has members.
For the members that are not linked by then a table holds the distances of fingerprints to the pivot; pairs whose
distances differ by more than similar sets do are discarded. In large groups the table also holds what each set has in
common with the pivot, and pairs meet, exactly as well, by what they have besides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, row_groups
from .graph import components

WIDTH = 5
THRESHOLD = 0.8
#: The share of documents sampled, and documents at least, for the order of the shingles; the shingles listed at most.
SAMPLE, SAMPLE_DOCS, LISTED = 1 / 8, 5_000, 4_000_000
#: Bits of a shingle's hash by which it is listed, and those of them that tell its bucket; keys that are counted at once.
LISTED_BITS, BUCKET_BITS, COUNTED = 42, 10, 1 << 20
#: Members of a group that are compared with each other; those of a larger one meet by what the pivot lacks.
CROWD = 64
#: Ids (of 8 bytes) that are broadcast to a scan of the texts at most; more are joined by shuffling.
BROADCAST_IDS = 2_000_000
_ROUND = 1e-9


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of the text's runs of `width` words, sorted; of a shorter text, of all its words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # as the fingerprints of simhash: bytes, of which only A-Z change
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    factors = np.random.default_rng(42).integers(1, 2**63 - 1, width).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed += each[k : k + n] * factors[k]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((mixed ^ (mixed >> np.uint64(33))).view(np.int64))


#: Bits of the fingerprints, in words of 64; and the size from which sets are so large that they are told apart by them.
WORDS, LEAST = 16, 32
_FACTORS = np.random.default_rng(8).integers(0, 2**63, WORDS - 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(found: np.ndarray, piece: int = 1 << 14) -> list[int]:
    """The SimHash of a set: of each bit of its members' hashes, which value more than half of them have."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), piece):
        h = found[at : at + piece].view(np.uint64)
        words = [h]
        for factor in _FACTORS:
            x = h * factor
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            words.append(x ^ (x >> np.uint64(29)))
        ones += np.unpackbits(np.stack(words, axis=1).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.int64).tolist()


def most_bits(threshold: float) -> int:
    """Differing bits that two sets of that similarity exceed by chance alone, for 1 pair in 10**9 (6 standard deviations).

    A bit of two sets of one size differs with the angle between their vectors, arccos(2 t / (1 + t)), over pi.
    """
    bits, p = 64 * WORDS, math.acos(2 * threshold / (1 + threshold)) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _digest(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(found.tobytes(), 42)], np.uint64).view(np.int64)[0]) if len(found) else 0


def _mapped(docs: DataFrame, width: int, choose, schema: str, kind=pa.int64(), printed: bool = False) -> DataFrame:
    """For each row the doc_id, the digest of its set, the size of the set, and what `choose` takes of the set.

    printed: with the fingerprint of the set.
    """

    def rows(batches):
        for batch in batches:
            for part in row_groups(batch, 1, 1 << 20):
                found = [shingles(x or b"", width) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                columns = [pa.array([_digest(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([choose(x) for x in found], pa.list_(kind))]
                names = ["doc_id", "digest", "n", "items"]
                if printed:
                    columns.append(pa.array([fingerprint(x) for x in found], pa.list_(pa.int64())))
                    names.append("fp")
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


_SCHEMA = "doc_id bigint, digest bigint, n bigint, items array<bigint>"


def _keys(found: np.ndarray) -> np.ndarray:
    """The first bits of the hashes, by which they are listed."""
    return (found.view(np.uint64) >> np.uint64(64 - LISTED_BITS)).view(np.int64)


def _packed(docs: DataFrame, width: int) -> DataFrame:
    """(bucket, cells): of each document's shingles the key less the bucket, 4 bytes, and 2 bytes of the set's digest.

    Copies have the same cells, and cells count once.
    """
    rest = LISTED_BITS - BUCKET_BITS

    def flushed(cells):
        cells = np.unique(np.concatenate(cells))
        ends = np.searchsorted(cells, np.arange((1 << BUCKET_BITS) + 1, dtype=np.int64) << rest + 16)
        low = cells.view(np.uint8).reshape(-1, 8)[:, : (rest + 16) // 8]  # the bytes of little-endian numbers
        full = np.flatnonzero(np.diff(ends))
        packs = [low[ends[k] : ends[k + 1]].tobytes() for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "cells"])

    def rows(batches):
        cells, held = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                found = shingles(text.as_py() or b"", width)
                cells.append(_keys(found) << 16 | _digest(found) & 0xFFFF)
                held += len(found)
                if held > COUNTED:
                    yield flushed(cells)
                    cells, held = [], 0
        if held:
            yield flushed(cells)

    return docs.select("text").mapInArrow(rows, "bucket int, cells binary")


def _counted(packed: DataFrame) -> DataFrame:
    """(item, count) of the keys that stand in several documents; a task holds the cells of one bucket at once."""
    rest = LISTED_BITS - BUCKET_BITS

    def several(bucket, packs):
        low = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, (rest + 16) // 8)
        cells = np.zeros((len(low), 8), np.uint8)
        cells[:, : low.shape[1]] = low
        items, counts = np.unique(np.unique(cells.view(np.int64)) >> 16, return_counts=True)
        items, counts = items[counts > 1], counts[counts > 1]
        return pa.RecordBatch.from_arrays([pa.array(items | bucket << rest), pa.array(np.minimum(counts, 65535), pa.int32())], names=["item", "count"])

    def rows(batches):
        now, packs = None, []
        for batch in batches:
            for bucket, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and packs:
                    yield several(now, packs)
                    packs = []
                now = bucket
                packs.append(pack)
        if packs:
            yield several(now, packs)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, "item bigint, count int")


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of shingles that stand in several documents of a sample, sorted, and their counts; for the order only.

    Of more than LISTED those with the largest counts.
    """
    rate = max(SAMPLE, SAMPLE_DOCS / max(1, docs.count()))
    part = docs if rate >= 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < int(10**6 * rate))
    counted = cut(_counted(_packed(part, width)))
    least, total = 2, 0
    for count, n in counted.groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).collect():
        total += n
        if total > LISTED:
            least = count + 1
            break
    listed = counted.where(F.col("count") >= least).toArrow().sort_by("item")
    discard(counted)
    return listed["item"].to_numpy(), listed["count"].to_numpy().astype(np.uint16)


def _in_order(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    listed, counts = frequent
    if not len(listed) or not len(found):
        return found
    keys = _keys(found)
    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
    return found[np.argsort(np.where(listed[at] == keys, counts[at], 0), kind="stable")]


def prefixes(docs: DataFrame, width: int, threshold: float, frequent) -> DataFrame:
    """(doc_id, digest, n, items, fp): items are the prefix of each row's set, in order, fp its fingerprint.

    frequent: broadcast, the shingles that come last, by their counts.
    """

    def choose(found):
        size = len(found) - math.ceil(threshold * len(found) - _ROUND) + 1 if len(found) else 0
        return _in_order(found, frequent.value)[:size]

    return _mapped(docs, width, choose, _SCHEMA + ", fp array<bigint>", printed=True)


def _apart(a: str, b: str) -> Column:
    """In how many bits the fingerprints in the columns a_fp and b_fp differ."""
    return sum((F.bit_count(F.get(f"{a}_fp", F.lit(k)).bitwiseXOR(F.get(f"{b}_fp", F.lit(k)))) for k in range(WORDS)), F.lit(0))


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether fingerprints (columns a_fp, a_n) leave it open that the sets are similar."""
    return (F.least(f"{a}_n", f"{b}_n") < LEAST) | (_apart(a, b) <= most_bits(threshold))


def _may_reach(a, b, threshold: float) -> Column:
    """Whether sets whose first common shingle is the one at these places can be that similar."""
    x, y = a["n"], b["n"]
    rest = F.least(x - a["place"], y - b["place"])
    return (F.least(x, y) >= threshold * F.greatest(x, y) - _ROUND) & (rest >= threshold / (1 + threshold) * (x + y) - _ROUND)


def _sets(asked: DataFrame, groups: DataFrame, docs: DataFrame, width: int, frequent=None) -> DataFrame:
    """(digest, items) of the digests asked for: their sets, by the lower 32 bits of the shingles' hashes.

    A count of common shingles can be one too large by that, for one pair of 400 shingles in some 25,000.
    frequent: the whole hashes in order, these last.
    """
    ids = cut(groups.join(asked, "digest").select(F.col("id").alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    if frequent is None:
        made = _mapped(texts, width, lambda x: x.astype(np.int32), "doc_id bigint, digest bigint, n bigint, items array<int>", pa.int32())
    else:
        made = _mapped(texts, width, lambda x: _in_order(x, frequent.value), _SCHEMA)
    return made.select("digest", "items")


def _verified(pairs: DataFrame, docs: DataFrame, groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of the distinct pairs (u, v) of digests those whose whole sets are similar."""
    asked = pairs.select(F.col("u").alias("digest")).union(pairs.select(F.col("v").alias("digest"))).distinct()
    sets = cut(_sets(asked, groups, docs, width).dropDuplicates(["digest"]))
    a, b = (sets.select(F.col("digest").alias(k), F.col("items").alias(f"{k}_items")) for k in "uv")
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("u_items", "v_items"))
    out = cut(both.where(common >= F.lit(threshold) * (F.size("u_items") + F.size("v_items") - common) - _ROUND).select("u", "v"))
    discard(sets)
    return out


def _distances(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with bits, the distance of the fingerprint to the pivot's."""
    ends = {k: known.select(F.col("digest").alias(k), F.col("fp").alias(f"{k}_fp")) for k in ("digest", "pivot")}
    cells = rows.select("digest", "pivot").distinct().join(ends["digest"], "digest").join(ends["pivot"], "pivot")
    return rows.join(cut(cells.select("digest", "pivot", _apart("digest", "pivot").alias("bits"))), ["digest", "pivot"])


def _open(threshold: float) -> Column:
    """Whether a pair is not linked by now, and the distances to the pivot leave it open.

    Fingerprints that differ in few bits have distances to the pivot that differ by no more.
    """
    near = (F.least("u_n", "v_n") < LEAST) | (F.abs(F.col("u_bits") - F.col("v_bits")) <= most_bits(threshold))
    return (F.col("u_root") != F.col("v_root")) & near


def _paired(u: DataFrame, v: DataFrame, keys: list[str], names: tuple, condition) -> DataFrame:
    """Pairs (u, v) of digests of rows that share the keys and fulfil the condition on columns u_name and v_name."""
    a, b = (x.select(*keys, *[F.col(c).alias(f"{k}_{c}") for c in ("digest", *names)]) for k, x in (("u", u), ("v", v)))
    ends = [f("u_digest", "v_digest").alias(k) for k, f in (("u", F.least), ("v", F.greatest))]
    return a.join(b, keys).where(condition).select(*ends)


def _reach(threshold: float) -> Column:
    first, second = ({c: F.col(f"{k}_{c}") for c in ("n", "place")} for k in "uv")
    return _may_reach(first, second, threshold)


def _met(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of rows (item, digest, n, place, root, pivot, bits) that share an item and stay open."""
    condition = (F.col("u_digest") < F.col("v_digest")) & _open(threshold) & _reach(threshold)
    return _paired(rows, rows, ["item"], ("n", "place", "root", "bits"), condition)


def _table(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """For each pivot and digest of rows, root, n, bits, and: shared (items with the pivot), alike (to the pivot), size
    (of the set without the pivot's) and items (of the rest, by which it is met).

    A similar set has t n items of this one at least, `need` of them of the rest, so that the first size - need + 1 of
    the rest do. Of a set that is like its pivot all do, as it is only looked up.
    """
    cells = rows.select("pivot", "digest", "root", "n", "bits").distinct()
    both = cells.join(sets, "digest").join(sets.select(F.col("digest").alias("pivot"), F.col("items").alias("p")), "pivot")
    both = both.withColumns({"shared": F.size(F.array_intersect("items", "p")), "rest": F.array_except("items", "p")})
    similar = F.col("shared") >= threshold * (F.col("n") + F.size("p") - F.col("shared")) - _ROUND
    need = F.ceil(threshold * F.col("n") - _ROUND).cast("int") - F.col("shared")
    both = both.withColumns({"alike": similar, "size": F.size("rest")})
    first = F.when(F.col("alike") | (need < 1), F.col("rest")).otherwise(F.slice("rest", 1, F.greatest(F.lit(0), F.col("size") - need + 1)))
    return both.select("pivot", "digest", "root", "n", "bits", "shared", "alike", "size", first.alias("items"))


def _met_outside(rows: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """As _met, by way of what the sets have besides the pivot's.

    Of a similar pair that is not linked one set is unlike the pivot. It has less in common with the pivot than with the
    other set, unless that is smaller than the pivot: they share an item that the pivot lacks, by which they meet.
    Those that need not share one, by their sizes, meet by the item of their group.
    """
    part = threshold / (1 + threshold)
    names = ("root", "n", "bits", "shared", "alike")
    once = ~F.col("u_alike") & (F.col("v_alike") | (F.col("u_digest") < F.col("v_digest")))
    need = part * (F.col("u_n") + F.col("v_n")) - F.least("u_shared", "v_shared") - _ROUND
    rest = F.least(F.col("u_size") - F.col("u_place"), F.col("v_size") - F.col("v_place"))
    sizes = F.least("u_n", "v_n") >= threshold * F.greatest("u_n", "v_n") - _ROUND
    each = table.select("pivot", "digest", *names, "size", F.posexplode("items").alias("place", "item"))
    met = _paired(each.where("not alike"), each, ["pivot", "item"], (*names, "size", "place"), _open(threshold) & once & sizes & (need > 0) & (rest >= need))
    told = rows.select("item", "pivot", "digest", "place").join(table.drop("items", "size"), ["pivot", "digest"])
    least = table.groupBy("pivot").agg(F.min("n").alias("least"))
    asks = told.join(least, "pivot").where(~F.col("alike") & (part * (F.col("n") + F.col("least")) - F.col("shared") - _ROUND <= 0))
    return met.union(_paired(asks, told, ["item"], (*names, "place"), _open(threshold) & once & (need <= 0) & _reach(threshold)))


def near_pairs(prints: DataFrame, groups: DataFrame, docs: DataFrame, width: int, threshold: float, frequent) -> DataFrame:
    """Links (u, v) between the digests of similar sets; every similar pair is joined directly or through others."""
    items = prints.join(groups.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    each = items.select("digest", "n", F.posexplode("items").alias("place", "item"))
    # Most items stand in one set only and end here, after the one shuffle that all of them take part in.
    shared = cut(each.withColumn("m", F.count("*").over(Window.partitionBy("item"))).where("m > 1"))
    weights = shared.groupBy("digest").agg(F.sum("m").alias("weight"))
    known = cut(prints.join(weights, "digest").groupBy("digest").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("weight").alias("weight")))
    marks = {k: known.select(F.col("digest").alias(k), F.col("n").alias(f"{k}_n"), F.col("fp").alias(f"{k}_fp")) for k in "uv"}

    def verified(pairs):
        likely = cut(pairs.join(marks["u"], "u").join(marks["v"], "v").where(_alike("u", "v", threshold)).select("u", "v"))
        return _verified(likely, docs, groups, width, threshold)

    rows = shared.join(known.select("digest", "weight"), "digest")
    pivots = rows.groupBy("item").agg(F.max(F.struct("weight", "digest", "n", "place")).alias("pivot"))
    met = cut(rows.join(pivots, "item").where("digest <> pivot.digest").drop("weight"))
    asked = met.where(_may_reach(F.col("pivot"), {"n": F.col("n"), "place": F.col("place")}, threshold))
    ends = F.col("digest"), F.col("pivot.digest")
    links = verified(cut(asked.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct()))
    # Groups with two members or more besides the pivot that are not linked by now.
    roots = cut(components(links))
    left = met.where("m > 2").join(roots.toDF("digest", "root"), "digest", "left")
    left = left.select("item", "digest", "n", "place", F.coalesce("root", "digest").alias("root"), F.col("pivot.digest").alias("pivot"))
    several = left.groupBy("item").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    rows = cut(_distances(cut(left.join(several.select("item", "m"), "item")), known))
    discard(shared, met)
    large = rows.where(F.col("m") > CROWD)
    asked = large.select("digest").union(large.select("pivot")).distinct()
    table = cut(_table(large, _sets(asked, groups, docs, width, frequent).dropDuplicates(["digest"]), threshold))
    pairs = _met(rows.where(F.col("m") <= CROWD), threshold).union(_met_outside(large, table, threshold)).distinct()
    return links.union(table.where("alike").select("pivot", "digest")).union(verified(cut(pairs)))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id) for each row of docs; component_id is the smallest doc_id of those linked to it.

    Documents are linked whose sets of `width`-word shingles have a Jaccard similarity of `threshold` or more, and those
    without words. Rows that share a doc_id count as one document of several texts. A set whose rows all have a null
    id links no others; its component_id is null. Rows with a null id take the component of their set.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    prints = cut(prefixes(docs, width, threshold, frequent))
    groups = cut(prints.groupBy("digest").agg(F.min("doc_id").alias("id")))
    named = groups.where("id is not null")
    links = near_pairs(prints, named, docs, width, threshold, frequent)
    several = prints.groupBy("doc_id").agg(F.min("digest").alias("u"), F.max("digest").alias("v")).where("u <> v and doc_id is not null")
    doubles = prints.select("doc_id", "digest").join(several.select("doc_id", "u"), "doc_id").select("u", F.col("digest").alias("v"))
    roots = cut(components(links.union(doubles)))
    rooted = cut(groups.join(roots, groups.digest == roots.node, "left").select("digest", "id", F.coalesce("root", "digest").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    known = rooted.join(smallest, "root").select("digest", "component_id")
    return prints.select("doc_id", "digest").join(cut(known), "digest", "left").select("doc_id", "component_id")
