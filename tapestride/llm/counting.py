"""Corpus counts of 64-bit keys for batches of documents: requests dealt by key range, answers in request order.

A batch asks for each distinct key once, in one row for each key range that it holds keys of, so rows and bytes grow
with the distinct keys of the batches; hot keys cost no more than others. There are several ranges to a shuffle
partition; a task sorts its rows by range and holds the keys of one range at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import key_runs

REQUEST = "shard int, batch bigint, uni binary, n_uni binary, bi binary, n_bi binary"


#: Key ranges of a shuffle partition.
RANGES = 8


def shard_count(spark: SparkSession) -> int:
    """Key ranges, a power of two: RANGES times the shuffle's partitions or more."""
    return 1 << max(0, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def packed(x) -> bytes:
    """An integer array as compressed byte planes."""
    import numpy as np
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) if len(x) else b""


def unpacked(data: bytes, dtype):
    import numpy as np
    import zstandard

    kind = np.dtype(dtype)
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed_keys(sorted_keys) -> bytes:
    import numpy as np

    return packed(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes):
    import numpy as np

    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


class Vocabulary(dict):
    """Numbers words as they come; number 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def request(number: int, uni, bi, shards: int) -> pa.RecordBatch:
    """REQUEST rows of a batch, one for each range with keys; uni and bi: (ascending keys, their counts in the batch)."""
    import numpy as np

    edges = np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - (shards.bit_length() - 1)) if shards > 1 else np.empty(0, np.uint64)
    bounds = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]) for keys, _ in (uni, bi)]
    live = np.flatnonzero(sum(np.diff(b) for b in bounds)).tolist()
    cols: list[list] = []
    for (keys, counts), b in zip((uni, bi), bounds):
        parts = [slice(b[s], b[s + 1]) for s in live]
        cols += [[packed_keys(keys[p]) for p in parts], [packed(counts[p]) for p in parts]]
    return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([number] * len(live), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "batch", "uni", "n_uni", "bi", "n_bi"])


def by_shard(df: DataFrame) -> DataFrame:
    """Rows of a shard together, in one task, shard after shard."""
    return df.repartition("shard").sortWithinPartitions("shard")


def answers(asked: DataFrame) -> DataFrame:
    """(batch, shard, uni, bi, types, tokens): corpus counts in the order of each batch's request; the shard's numbers of training types and tokens stand in one of its rows."""

    def answer(part: pa.Table) -> pa.Table:
        import numpy as np

        out, types, tokens = {}, 0, 0
        for kind in ("uni", "bi"):
            keys = [unpacked_keys(x.as_py()) for x in part[kind]]
            counts = [unpacked(x.as_py(), np.uint32) for x in part[f"n_{kind}"]]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place.ravel(), np.concatenate(counts), len(every)).astype(np.uint64)
            if kind == "uni":
                types, tokens = int((total > 0).sum()), int(total.sum())
            ends = np.cumsum([0, *map(len, keys)])
            out[kind] = [packed(total[place.ravel()[a:b]]) for a, b in zip(ends, ends[1:])]
        n = part.num_rows
        return pa.table({"batch": part["batch"], "shard": part["shard"], "uni": pa.array(out["uni"], pa.binary()), "bi": pa.array(out["bi"], pa.binary()), "types": pa.array([types] + [0] * (n - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in key_runs(batches):
            for s, e in bounds:
                yield from answer(part.slice(s, e - s)).to_batches()

    return by_shard(asked).mapInArrow(run, "batch bigint, shard int, uni binary, bi binary, types bigint, tokens bigint")
