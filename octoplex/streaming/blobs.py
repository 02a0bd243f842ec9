"""Stateful operators over streams of chunks (stream_id, seq, data). Chunk sizes never change a result.

seq counts from 0 in each stream; a chunk that comes again is ignored, and one that comes early waits in the state, up
to MAX_HELD bytes for a stream, longer only within a micro-batch. Where chunks have a column `last` (BOOLEAN), it ends the stream: what is left over is
given out and the state is dropped.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from ..functions.literals import Exact, Mask
from ..operators.analyze import _measures, byte_counts

#: Bytes of early chunks that the state of a stream keeps at most.
MAX_HELD = 64 << 20


def histogram(chunks: DataFrame) -> DataFrame:
    """(byte, count), for the output modes complete and update."""
    return byte_counts(chunks)


class _Stream:
    """What is known of one stream: the seq that comes next, chunks that came early, the last seq or -1, and what work keeps."""

    __slots__ = ("expected", "held", "end", "tail", "base", "free", "done")

    def __init__(self, expected=0, held=None, end=-1, tail=b"", base=0, free=0):
        self.expected, self.held, self.end, self.tail, self.base, self.free, self.done = expected, held or {}, end, tail, base, free, False

    def kept(self) -> tuple:
        return self.expected, self.held, self.end, self.tail, self.base, self.free

    def following(self) -> bytes:
        """The bytes that follow on, in the order of seq."""
        out = []
        while self.expected in self.held:
            out.append(self.held.pop(self.expected))
            self.expected += 1
        return b"".join(out)


#: Streams are kept by so many groups, by a hash of their ids: Spark's work for a group is worth that of hundreds of streams.
GROUPS = 2048


def _stateful(chunks: DataFrame, work, schema: str, mode: str) -> DataFrame:
    """work(new, ended, tail, base, free) gives the columns after stream_id and what the state keeps: tail, base and free.

    In the mode update a stream has one row a micro-batch, the last.
    """
    chunks = chunks if "last" in chunks.columns else chunks.withColumn("last", F.lit(False))
    names = [x.split()[0] for x in schema.split(", ")]

    def frame(rows: list[tuple[int, tuple]]) -> pd.DataFrame:
        ids = np.repeat(np.array([k for k, _ in rows], np.int64), [len(x[0]) for _, x in rows])
        return pd.DataFrame(dict(zip(names, [ids, *(np.concatenate(c) for c in zip(*(x for _, x in rows), strict=True))], strict=True)))

    def step(key, frames, state: GroupState):
        streams = {k: _Stream(*v) for k, v in pickle.loads(state.get[0]).items()} if state.exists else {}
        latest: dict[int, tuple] = {}
        for part in frames:
            touched: dict[int, _Stream] = {}
            for k, seq, data, last in zip(part["stream_id"].tolist(), part["seq"].tolist(), part["data"], part["last"].tolist(), strict=True):
                one = touched.get(k)
                if one is None:
                    one = touched[k] = streams.setdefault(k, _Stream())
                if seq >= one.expected:
                    one.held[seq] = b"" if data is None else bytes(data)
                if last:
                    one.end = seq
            rows = []
            for k, one in touched.items():
                if one.done:
                    continue
                new = one.following()
                one.done = 0 <= one.end < one.expected
                made, one.tail, one.base, one.free = work(new, one.done, one.tail, one.base, one.free)
                if mode == "update":
                    latest[k] = made
                elif len(made[0]):
                    rows.append((k, made))
            if rows:
                yield frame(rows)
        if latest:
            yield frame(list(latest.items()))
        left = {k: one.kept() for k, one in streams.items() if not one.done}
        for k, one in streams.items():
            if k in left and sum(map(len, one.held.values())) > MAX_HELD:
                raise ValueError(f"over {MAX_HELD} bytes wait for chunk {one.expected} of a stream")
        if left:
            state.update((pickle.dumps(left),))
        elif state.exists:
            state.remove()

    grouped = chunks.select("stream_id", "seq", "data", "last", F.pmod(F.xxhash64("stream_id"), F.lit(GROUPS)).alias("_group"))
    return grouped.groupBy("_group").applyInPandasWithState(step, schema, "streams binary", mode, GroupStateTimeout.NoTimeout)


def search(chunks: DataFrame, pattern: Exact | Mask, no_overlap: bool = False) -> DataFrame:
    """(stream_id, offset) of matches, also across chunks.

    The state holds the last bytes, one fewer than the pattern, chunks that came too early, and where the last match
    ended, so that no_overlap is greedy over the whole stream.
    """
    width = len(pattern.data)

    def work(new, ended, tail, base, free):
        data = tail + new
        found = kernels.places(np.frombuffer(data, np.uint8), pattern.data) + base
        if no_overlap:
            found = kernels.greedy(found, width, free)
            free = int(found[-1]) + width if len(found) else free
        keep = min(len(data), width - 1)
        return (found.astype(np.int64),), data[len(data) - keep :], base + len(data) - keep, free

    return _stateful(chunks, work, "stream_id bigint, offset bigint", "append")


def blocks(chunks: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, offset, size, entropy, ic) of each full block, and of the short last one when the stream ends."""

    def work(new, ended, tail, base, free):
        data = tail + new
        full = len(data) // block_size
        counts = [np.bincount(np.frombuffer(data, np.uint8, block_size, block_size * k), minlength=256) for k in range(full)]
        if ended and len(data) > full * block_size:
            counts.append(np.bincount(np.frombuffer(data, np.uint8, offset=full * block_size), minlength=256))
        grid = np.array(counts, np.int64).reshape(-1, 256)
        entropy, ic = _measures(grid)
        at = base + block_size * np.arange(len(grid), dtype=np.int64)
        return (at, grid.sum(1).astype(np.int64), entropy, ic), data[full * block_size :], base + full * block_size, free

    return _stateful(chunks, work, "stream_id bigint, offset bigint, size bigint, entropy double, ic double", "append")


def crc32(chunks: DataFrame) -> DataFrame:
    """(stream_id, size, crc32) so far, after each micro-batch; the state is a number, however long the stream."""

    def work(new, ended, tail, size, value):
        value, size = zlib.crc32(new, value), size + len(new)
        return (np.array([size]), np.array([f"{value:08x}"], object)), b"", size, value

    return _stateful(chunks, work, "stream_id bigint, size bigint, crc32 string", "update")


def block_digests(chunks: DataFrame, algorithm: str, block_size: int) -> DataFrame:
    """(stream_id, offset, digest) of each block, in hex; of the short last one when the stream ends.

    The state keeps less than a block. A digest of a whole stream, other than CRC32, needs it as one blob or by blocks.
    """
    from ..operators.digest import of_bytes

    made = of_bytes(algorithm)

    def work(new, ended, tail, base, free):
        data = tail + new
        stop = len(data) if ended else len(data) // block_size * block_size
        at = list(range(0, stop, block_size))
        digests = np.array(made([data[k : k + block_size] for k in at]), object)
        return (base + np.array(at, np.int64), digests), data[stop:], base + stop, free

    return _stateful(chunks, work, "stream_id bigint, offset bigint, digest string", "append")


def finished(made: DataFrame, folder: str, mode: str) -> DataFrame:
    """The result of a stream once all that is there has been read, written by executors to a folder that all share.

    In the mode complete the last micro-batch is the result, else all of them are.
    """
    path = f"{folder.rstrip('/')}/octoplex/{uuid.uuid4().hex}"
    kept: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")  # a micro-batch that runs again takes the place of its first run
        kept[:] = ([] if mode == "complete" else [x for x in kept if not x.endswith(f"/batch-{number}")]) + [f"{path}/batch-{number}"]

    made.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    reader = made.sparkSession.read.schema(made.schema)
    return reader.parquet(*kept) if kept else made.sparkSession.createDataFrame([], made.schema)
