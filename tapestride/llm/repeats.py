"""Substring dedup by super-k-mer partitioning.

A window is `WINDOW` consecutive words of one document; its minimiser is the leftmost of its least-hashed `MER`-word
runs. Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string to the bucket
of its minimiser; there the windows are sorted and counted exactly. A window's repeats have the same minimiser, each
in a super-k-mer of its own, so a minimiser that occurs once in the corpus holds no repeat: batches first ask for
the corpus counts of their minimisers, and only super-k-mers of the others travel. Equal strings of a batch travel
once. A key range's buckets are counted in one step, a range after the other. A hot minimiser (more than `HOT` super-k-mers) is split: its windows travel singly, each to the bucket of its
own hash, so that no bucket grows with a passage's popularity. Strings are compared in every case; hashes only route.

Cases: null and empty texts have no words; a text of fewer words than the window keeps them all; repeated rows
repeat each other's windows; ids may be null or repeated; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import field_ddl, key_runs, table, text_of
from .counting import REQUEST, answers, by_shard, packed, request, shard_count, unpacked

WINDOW, MER, HOT = 35, 8, 512
#: Text of a batch of documents.
BATCH_BYTES = 6_000_000


def batches_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, ids, data): documents of each input partition in batches of bounded size, texts compressed."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        ids, texts, total = [], [], 0

        def made():
            data = pickle.dumps((ids, [len(t) for t in texts], press.compress(b"".join(texts))))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["batch", "data"])

        for batch in arrow:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py().encode()
                ids.append(key)
                texts.append(text)
                total += len(text) + 1
                if total >= BATCH_BYTES:
                    yield made()
                    number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield made()

    return rows.mapInArrow(run, "batch bigint, data binary")


class Batch:
    def __init__(self, data: bytes):
        import zstandard

        self.ids, sizes, texts = pickle.loads(data)
        self.raw, self.sizes = zstandard.ZstdDecompressor().decompress(texts) if any(sizes) else b"", sizes

    def words(self) -> Iterator[list[bytes]]:
        """Each document's words."""
        at = 0
        for n in self.sizes:
            yield self.raw[at : at + n].split()
            at += n


def super_kmers(word_hashes, window: int = WINDOW, mer: int = MER):
    """(first window, number of windows, minimiser hash) of each super-k-mer of one document."""
    import numpy as np

    n = len(word_hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n - mer + 1, np.uint64)
        for j in range(mer):
            h = (h ^ word_hashes[j : n - mer + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    runs = np.lib.stride_tricks.sliding_window_view(h, window - mer + 1)
    place = runs.argmin(axis=1) + np.arange(len(runs))
    first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
    return first, np.diff(np.append(first, len(place))), h[place[first]]


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Hasher:
    """64-bit hashes of words, cached for a batch."""

    def __init__(self):
        self.known = Hashes()

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def requests(batches: DataFrame, shards: int) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        none = np.empty(0, np.uint64), np.empty(0, np.uint32)
        for batch in arrow:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                hasher = Hasher()
                found = [super_kmers(hasher.of(words))[2] for words in Batch(data.as_py()).words()]
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield request(number, (keys, counts.astype(np.uint32)), none, shards)

    return batches.mapInArrow(run, REQUEST)


def spread(batches: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """(shard, batch, data): the strings of each batch for each range of bucket keys, with where they occur."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import xxhash
        import zstandard

        if not left.num_rows:
            raise RuntimeError("an answer without its batch")
        number = left["batch"][0].as_py()
        hasher, docs = Hasher(), []
        for words in Batch(left["data"][0].as_py()).words():
            docs.append((words, *super_kmers(hasher.of(words))))
        counts = np.concatenate([unpacked(x.as_py(), np.uint64) for x in right.sort_by("shard")["uni"]] or [np.empty(0, np.uint64)])
        keys, place = np.unique(np.concatenate([d[3] for d in docs]), return_inverse=True)
        if len(keys) != len(counts):
            raise RuntimeError("a batch changed between request and answer")
        size_of, at = counts[place.ravel()], 0
        strings: dict[tuple[int, bytes], list[int]] = {}
        for k, (words, first, n, minimiser) in enumerate(docs):
            size = size_of[at : at + len(first)]
            at += len(first)
            for s in np.flatnonzero(size > 1).tolist():
                a, b = int(first[s]), int(first[s] + n[s])
                if size[s] <= HOT:
                    strings.setdefault((int(minimiser[s]), b" ".join(words[a : b + WINDOW - 1])), []).extend((k, a))
                else:
                    for w in range(a, b):
                        one = b" ".join(words[w : w + WINDOW])
                        strings.setdefault((xxhash.xxh3_64_intdigest(one), one), []).extend((k, w))
        by: list[list] = [[] for _ in range(shards)]
        shift = 64 - (shards.bit_length() - 1)
        for (key, string), where in strings.items():
            by[(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift if shards > 1 else 0].append((key, string, where))
        press = zstandard.ZstdCompressor(level=3)
        live = [s for s in range(shards) if by[s]]
        data = []
        for s in live:
            own = sorted(by[s])
            where = np.array([x for e in own for x in e[2]], np.uint32)
            data.append(pickle.dumps((packed(np.array([e[0] for e in own], np.uint64)), press.compress(b"\n".join(e[1] for e in own)), packed(np.array([len(e[2]) // 2 for e in own], np.uint32)), packed(where[::2]), packed(where[1::2]))))
        return pa.table({"shard": pa.array(live, pa.int32()), "batch": pa.array([number] * len(live), pa.int64()), "data": pa.array(data, pa.binary())})

    return batches.groupBy("batch").cogroup(answered.select("batch", "shard", "uni").groupBy("batch")).applyInArrow(run, "shard int, batch bigint, data binary")


def repeated_runs(entries: list[tuple[bytes, int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each (string, occurrences) of one bucket the runs (first, number) of windows that occur twice or more."""
    weight: dict[bytes, int] = {}
    for string, n in entries:
        weight[string] = weight.get(string, 0) + n
    windows: dict[bytes, list[bytes]] = {}
    for string in weight:
        words = string.split(b" ")
        windows[string] = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
    if len(weight) > 1:
        flat = sorted((w, weight[s]) for s, own in windows.items() for w in own)
        twice, k = set(), 0
        while k < len(flat):
            j, n = k, 0
            while j < len(flat) and flat[j][0] == flat[k][0]:
                n += flat[j][1]
                j += 1
            if n > 1:
                twice.add(flat[k][0])
            k = j
    else:
        twice = {w for s, own in windows.items() if weight[s] > 1 for w in own}
    runs: dict[bytes, list[tuple[int, int]]] = {}
    for string, own in windows.items():
        out: list[tuple[int, int]] = []
        for k, w in enumerate(own):
            if w in twice:
                if out and sum(out[-1]) == k:
                    out[-1] = (out[-1][0], out[-1][1] + 1)
                else:
                    out.append((k, 1))
        runs[string] = out
    return [runs[s] for s, _ in entries]


def counted(spreads: DataFrame) -> DataFrame:
    """(batch, data): runs of repeated windows (document, first window, number) that a shard finds in a batch."""

    def count(part: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        press = zstandard.ZstdDecompressor()
        keys, strings, times, docs, firsts, owner = [], [], [], [], [], []
        for k, data in enumerate(part["data"]):
            key, text, n, doc, first = pickle.loads(data.as_py())
            keys.append(unpacked(key, np.uint64))
            strings += press.decompress(text).split(b"\n")
            times.append(unpacked(n, np.uint32))
            docs.append(unpacked(doc, np.uint32))
            firsts.append(unpacked(first, np.uint32))
            owner += [k] * len(keys[-1])
        key, n = np.concatenate(keys), np.concatenate(times).astype(np.int64)
        doc, first, at = np.concatenate(docs), np.concatenate(firsts), np.append(0, np.cumsum(n))
        order = np.argsort(key, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order))
        out: list[list[int]] = [[] for _ in range(part.num_rows)]
        start = 0
        for end in ends.tolist():
            own = order[start:end].tolist()
            start = end
            if len(own) == 1 and n[own[0]] == 1:
                continue
            for e, runs in zip(own, repeated_runs([(strings[e], int(n[e])) for e in own])):
                if runs:
                    for x in range(int(at[e]), int(at[e + 1])):
                        for a, m in runs:
                            out[owner[e]] += (int(doc[x]), int(first[x]) + a, m)
        live = [k for k, x in enumerate(out) if x]
        return pa.table({"batch": part["batch"].take(pa.array(live, pa.int64())), "data": pa.array([packed(np.array(out[k], np.uint32)) for k in live], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in key_runs(batches):
            for s, e in bounds:
                yield from count(part.slice(s, e - s)).to_batches()

    return by_shard(spreads).mapInArrow(run, "batch bigint, data binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    batches = batches_of(docs, id_col, text_col)
    shards = shard_count(docs.sparkSession)
    found = counted(spread(batches, answers(requests(batches, shards)), shards))
    id_type = docs.schema[id_col].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_type

        batch = Batch(left["data"][0].as_py())
        runs = np.concatenate([unpacked(x.as_py(), np.uint32) for x in right["data"]] or [np.empty(0, np.uint32)]).reshape(-1, 3).astype(np.int64)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        bounds = np.searchsorted(runs[:, 0], np.arange(len(batch.ids) + 1))
        n_words, n_removed, sha, texts = [], [], [], []
        for k, words in enumerate(batch.words()):
            own = runs[bounds[k] : bounds[k + 1]]
            n = len(words)
            if len(own):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, own[:, 1], 1)
                np.add.at(edge, own[:, 1] + own[:, 2] + WINDOW - 1, -1)
                words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
            kept = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        cols = {id_col: pa.array(batch.ids, to_arrow_type(id_type)), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    ddl = f"{field_ddl(docs, id_col)}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, ddl)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
