"""SimHash near-duplicates, found and discarded by pivot distance tables.

Each distinct fingerprint has its Hamming distances to many reference fingerprints, the pivots: one of random bits, 32
that differ from it in one block of two bits, and 6 that differ from it in a group of such blocks. A pivot's coordinate
less the first one's tells how far a fingerprint is from the first pivot inside that block, so two fingerprints at
distance d differ by d at most in each coordinate, and their 32 block coordinates by d at most in sum. With d of 2 the
coordinates of 4 of the 6 groups are equal, and these are the keys by which candidate pairs meet, in 15 tables. A pair
whose largest coordinate difference over the first pivot and the 6 groups is over the limit is discarded; what is left
is verified bit by bit.

A key that over BLOCK_LIMIT fingerprints share forms no pairs: its members meet, exactly as well, at the fingerprints
one bit away from them. A group that meets there has 65 members at most.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, row_groups, table
from .graph import components

BLOCK_LIMIT = 64
MAX_BITS = 2
#: Blocks of two bits to a group.
GROUPS = (5, 5, 5, 5, 6, 6)
#: Bytes of text whose words are held at once.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_ODD = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(seed: int = 42) -> list[int]:
    """The first pivot, the 32 of single blocks and the 6 of groups, as unsigned numbers."""
    first = int(np.random.default_rng(seed).integers(0, 2**64, dtype=np.uint64))
    return [first, *(first ^ (3 << 2 * k) for k in range(32)), *(first ^ mask for mask in _group_masks())]


def _group_masks() -> list[int]:
    ends = list(itertools.accumulate(GROUPS))
    return [sum(3 << 2 * k for k in range(end - n, end)) for n, end in zip(GROUPS, ends, strict=True)]


def _word_pieces(text: bytes):
    """Lists of the lower-cased words of the text, a piece of it at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end].lower().split()  # bytes: only A-Z change, and only ASCII white space divides
        at = end


def _fingerprint(text: bytes, width: int = 3) -> int:
    from xxhash import xxh64_intdigest

    ones, n, words = np.zeros(64, np.int64), 0, []
    for piece in _word_pieces(text):
        words = words[1 - width :] + piece if width > 1 else piece
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        count = len(words) - width + 1
        spans = zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True)
        while len(got := [xxh64_intdigest(joined[a:b], 42) for a, b in itertools.islice(spans, 1 << 16)]):
            bits = np.unpackbits(np.array(got, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        n += count
    if not n:
        return xxh64_intdigest(b" ".join(words), 42) if words else 0
    set_bits = (2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return int(np.bitwise_or.reduce(set_bits))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp BIGINT) for each row of docs, from its whole text; a null text has no words and fingerprint 0."""

    def rows(batches):
        for batch in batches:
            for part in row_groups(batch, 1):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                found = np.array([_fingerprint(x or b"", width) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, fp bigint")


def _block_coordinates(fp: Column) -> Column:
    """How many bits of each of the 32 blocks differ from the first pivot's, in fields of two bits.

    This is half of 2 less the difference of the coordinates of the block's pivot and the first.
    """
    x = fp.bitwiseXOR(F.lit(_signed(pivots()[0])))
    y, odd = F.shiftrightunsigned(x, 1), F.lit(_ODD)
    return x.bitwiseXOR(y).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(odd), 1))


def _keys(fp: Column) -> Column:
    """The block coordinates of each 4 of the 6 groups."""
    coordinates = _block_coordinates(fp)
    masks = [sum(four) for four in itertools.combinations(_group_masks(), len(GROUPS) - MAX_BITS)]
    return F.array(*[F.xxhash64(F.lit(k), coordinates.bitwiseAND(F.lit(_signed(mask)))) for k, mask in enumerate(masks)])


def _distances(fp: Column) -> Column:
    """The distances to the first pivot and to those of the groups, a byte each."""
    refs = [pivots()[0], *pivots()[33:]]
    pack = F.lit(0).cast("bigint")
    for k, p in enumerate(refs):
        pack = pack.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("bigint"), 8 * k))
    return pack


def _near(a: str, b: str, bits: int) -> Column:
    """All coordinates within `bits`, by one subtraction of 7 bytes each way, then the distance itself."""
    high, more = (sum(x << 8 * k for k in range(7)) for x in (128, bits))
    within = F.lit(True)
    for x, y in ((a, b), (b, a)):
        apart = F.col(f"{x}.d").bitwiseOR(F.lit(high)) - F.col(f"{y}.d") + F.lit(more)
        within = within & (apart.bitwiseAND(F.lit(high)) == high)
    return within & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)


def near_pairs(prints: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (fp, id) at two differing bits or fewer.

    Every linked pair is joined directly or through others of its group; no pair further apart is ever linked.
    """
    keys = _keys(F.col("fp"))
    members = prints.select("fp", "id", _distances(F.col("fp")).alias("d"), F.explode(keys).alias("block"))
    sizes = prints.select(F.explode(keys).alias("block")).groupBy("block").count()
    sizes = cut(sizes.where("count > 1"))
    small = cut(members.join(sizes.where(F.col("count") <= limit).select("block"), "block"))
    pairs = (
        small.alias("a").join(small.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.fp") < F.col("b.fp")))
        .where(_near("a", "b", MAX_BITS)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    )
    crowd = members.join(sizes.where(F.col("count") > limit).select("block"), "block").select("fp", "id").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    meet = crowd.select("id", F.explode(flips).alias("at")).groupBy("at").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    stars = meet.select(F.array_min("ids").alias("u"), F.explode("ids").alias("v")).where("u <> v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, threshold: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id of those linked to it.

    With a threshold the links are exact instead: (doc_id, component_id), by a Jaccard similarity of so much or more
    between the sets of `width`-word shingles. Texts of a similarity of 0.8 may differ in 16 of 64 bits and more, and
    pivots can't discard pairs at such distances (README), so jaccard finds these by prefix filtering.

    Without one, fingerprints within two bits are linked, and so are equal ones, those of empty texts (zero) too. Rows that share a
    doc_id count as one document of several fingerprints. A fingerprint whose rows all have a null id links no others;
    its component_id is null. Rows with a null id take the component of their fingerprint. Other columns are ignored.
    """
    if threshold is not None:
        return jaccard.near_duplicates(docs, width, threshold)
    prints = cut(fingerprints(docs, width))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    same = prints.groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp <> other and doc_id is not null")
    doubles = prints.join(same.select("doc_id"), "doc_id", "left_semi").join(groups, "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    links = near_pairs(groups.where("id is not null")).union(doubles)
    roots = cut(components(links))
    known = groups.join(roots, groups.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(cut(known), "fp", "left").select("doc_id", "fp", "component_id")


def op4_query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
