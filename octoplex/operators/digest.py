"""Digests of blobs and blocks, and checks against a manifest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import octets
from ..functions.literals import Unsupported

ALIASES = {"sha-1": "sha1", "sha-256": "sha256", "blake3-256": "blake3", "crc-32": "crc32", "xxh64": "xxhash64"}


@F.pandas_udf(StringType())
def xxh64(data: pd.Series) -> pd.Series:
    """XXH64 with seed 0, 16 hex digits."""
    from xxhash import xxh64_hexdigest

    return data.map(lambda x: xxh64_hexdigest(bytes(x), 0), na_action="ignore")


# Fixed values of BLAKE3: the initial state, the order of words between rounds, and the flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_SHUFFLE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
#: Chunks of 1024 bytes that are compressed at once.
_AT_ONCE = 4096


def _compress(chains: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, n) of n independent blocks: every step is taken for all of them at once."""
    n = chains.shape[1]
    rest = (np.full(n, x, np.uint32) for x in _IV[:4])
    v = [*chains.copy(), *rest, (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    order = list(range(16))
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, left, right in ((order[2 * k], 16, 12), (order[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + words[word]
                x = v[d] ^ v[a]
                v[d] = (x >> np.uint32(left)) | (x << np.uint32(32 - left))
                v[c] = v[c] + v[d]
                x = v[b] ^ v[c]
                v[b] = (x >> np.uint32(right)) | (x << np.uint32(32 - right))
        if turn < 6:
            order = [order[i] for i in _SHUFFLE]
    return np.array([v[i] ^ v[i + 8] for i in range(8)])


def _chunk_values(pieces: list[bytes], counters: np.ndarray, single: np.ndarray) -> np.ndarray:
    """The chaining values of chunks of up to 1024 bytes; `single` marks those that are a whole blob."""
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    words = np.frombuffer(b"".join(p.ljust(1024, b"\0") for p in pieces), "<u4").reshape(n, 16, 16)
    blocks = np.maximum(-(-sizes // 64), 1)
    chains = np.tile(np.array(_IV, np.uint32)[:, None], n)
    for step in range(int(blocks.max())):
        on = np.flatnonzero(blocks > step)
        last = blocks[on] == step + 1
        flags = _CHUNK_START * (step == 0) | np.where(last, _CHUNK_END | np.where(single[on], _ROOT, 0), 0)
        length = np.where(last, sizes[on] - 64 * step, 64)
        chains[:, on] = _compress(chains[:, on], words[on, step].T, counters[on], length, flags)
    return chains


def blake3_all(values: list[bytes]) -> list[str]:
    """BLAKE3 with 256 bits of output of each value. Chunks, then pairs of nodes, of all values are taken together."""
    if not values:
        return []
    counts = np.array([max(1, -(-len(v) // 1024)) for v in values])
    owner = np.repeat(np.arange(len(values)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    nodes = []
    for a in range(0, len(owner), _AT_ONCE):
        o, k = owner[a : a + _AT_ONCE], number[a : a + _AT_ONCE]
        pieces = [bytes(values[i][1024 * j : 1024 * j + 1024]) for i, j in zip(o.tolist(), k.tolist(), strict=True)]
        nodes.append(_chunk_values(pieces, k.astype(np.uint64), counts[o] == 1))
    found = np.concatenate(nodes, axis=1)
    while len(owner) > len(values):  # one level of all trees: neighbours are joined, an odd last one moves up
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        words = np.concatenate((found[:, left], found[:, left + 1]))
        flags = _PARENT | np.where(counts[owner[left]] == 2, _ROOT, 0)
        start = np.tile(np.array(_IV, np.uint32)[:, None], len(left))
        found[:, left] = _compress(start, words, np.zeros(len(left), np.uint64), np.full(len(left), 64), flags)
        found, owner = found[:, place % 2 == 0], owner[place % 2 == 0]
        counts = -(-counts // 2)
    return [row.tobytes().hex() for row in np.ascontiguousarray(found.T).astype("<u4")]


@F.pandas_udf(StringType())
def blake3(data: pd.Series) -> pd.Series:
    known = data.dropna()
    return pd.Series(blake3_all(known.tolist()), index=known.index, dtype=object).reindex(data.index)


def digest(b: Column, algorithm: str, encoding: str = "hex") -> Column:
    """Lower-case hex, or base64 with padding. md5, sha1, sha256 and crc32 stay in the JVM."""
    algorithm = ALIASES.get(algorithm.lower(), algorithm.lower())
    made = {
        "md5": lambda: F.md5(b), "sha1": lambda: F.sha1(b), "sha256": lambda: F.sha2(b, 256),
        "crc32": lambda: F.lpad(F.lower(F.hex(F.crc32(b))), 8, "0"), "xxhash64": lambda: xxh64(b), "blake3": lambda: blake3(b),
    }.get(algorithm)
    if not made or encoding not in ("hex", "base64"):
        raise Unsupported(f"{algorithm} as {encoding}")
    return made() if encoding == "hex" else F.base64(F.unhex(made()))


def of_bytes(algorithm: str):
    """A function from a list of bytes to their digests in hex, for kernels."""
    import hashlib
    import zlib

    name = ALIASES.get(algorithm.lower(), algorithm.lower())
    if name == "blake3":
        return blake3_all
    if name == "xxhash64":
        from xxhash import xxh64_hexdigest

        return lambda values: [xxh64_hexdigest(v, 0) for v in values]
    if name == "crc32":
        return lambda values: [f"{zlib.crc32(v):08x}" for v in values]
    if name in ("md5", "sha1", "sha256"):
        return lambda values: [hashlib.new(name, v).hexdigest() for v in values]
    raise Unsupported(algorithm)


def block_digests(df: DataFrame, algorithm: str, block_size: int, key: str = "blob_id", encoding: str = "hex") -> DataFrame:
    """(key, offset, digest) for each block; an empty blob has none."""
    n = octets.size(F.col("data"))
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(block_size).cast("bigint")))
    each = df.select(key, "data", F.explode(starts).alias("offset")).select(key, "offset", octets.cut(F.col("data"), F.col("offset"), block_size).alias("part"))
    return each.select(key, "offset", digest(F.col("part"), algorithm, encoding).alias("digest"))


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, expected) of lines `DIGEST  NAME`; blank lines and those that start with # or ; are skipped.

    The name follows the first two spaces and may start with *; without two spaces it follows the first white space.
    """
    line = F.trim(F.col(column))
    kept = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike("^[#;]"))
    two = F.regexp_extract("line", r"^(.*?)  (.*)$", 2)
    name = F.when(two != "", F.regexp_replace(F.trim(two), r"^\*", "")).otherwise(F.regexp_extract("line", r"^\S+\s+(.*)$", 1))
    return kept.select(name.alias("name"), F.lower(F.trim(F.when(two != "", F.regexp_extract("line", r"^(.*?)  ", 1)).otherwise(F.regexp_extract("line", r"^(\S+)", 1)))).alias("expected"))


def check(manifest: DataFrame, blobs: DataFrame, algorithm: str, name: str = "name") -> DataFrame:
    """(name, status): OK, FAILED, or MISSING where no blob has the name."""
    made = blobs.select(F.col(name).alias("name"), digest(F.col("data"), algorithm).alias("actual"))
    joined = manifest.join(made, "name", "left")
    return joined.select("name", F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("expected"), "OK").otherwise("FAILED").alias("status"))


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("status") == "OK").alias("passed"), F.count_if(F.col("status") != "OK").alias("failed"))
