"""Jaccard join on word n-grams by a MinHash LSH forest.

Documents with equal n-gram sets form a class, and only classes are compared. A class's signature is laid out in
trees of `LEVELS` levels; the rows (tree, levels) of all classes, sorted, are the prefix tries, written once. Classes
that share a prefix of a tree are candidates. Prefixes are matched at full depth first and shortened, in all trees,
until the estimated recall reaches the target: every pair found at depth d with similarity s stands for 1 / s^d pairs
of a tree, and of these 1 - (1 - s^d)^trees are found. A depth at which even pairs at the threshold are found with the
target recall needs no estimate and is never passed; without any match the search goes there at once.

Candidates pass a 2-bit sketch of the signature (six standard deviations below the threshold) and the length bound;
they form candidate groups, inside which n-gram sets are compared exactly, block by block, and links are counted
without being listed. A trie node with more classes than `NODE`, or one that isn't whole in a batch of the sorted
rows, is dealt to tasks in pairs of blocks.

A document of fewer words than the n-gram has one n-gram, all its words. Cases: null and empty texts have no
n-grams; they form one class without links to others; repeated ids and texts are rows of their own; null ids are
kept; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, field_ddl, key_runs, one_of_each, remove, row_key, shared_dir, table, text_of
from .components import components

WORDS, THRESHOLD = 5, 0.8
PERMUTATIONS, TREES, LEVELS, RECALL = 128, 20, 8, 0.9999
#: Bits of a level; a tree's number and four levels make the first half of a trie key, four levels the second.
BITS, HALF = 14, 4
#: Classes of a trie node that are compared in place, and of a block of a larger one.
NODE = 1024
#: Classes of a candidate group that are compared with each other at a time.
BLOCK = 512
CACHE = 400_000


def found(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of so many levels in one tree or more."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall; none shorter is needed."""
    for depth in range(levels, 0, -1):
        if found(threshold, depth, trees) >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def similarity_of(equal: int) -> float:
    """The Jaccard similarity that so many equal 2-bit values of the sketch speak for."""
    return min(1.0, max(0.0, (equal / PERMUTATIONS - 0.25) / 0.75))


def next_depth(pairs: dict[int, int], depth: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth to search after `depth`, or `depth` itself if it reaches the recall.

    pairs: how many pairs of classes share a node of the tries at `depth`, by equal values of their sketches."""
    floor = shortest_prefix(threshold, recall=recall)
    near = threshold - 2 * math.sqrt(threshold * (1 - threshold) / PERMUTATIONS)  # an estimate below the threshold by chance
    like = {max(threshold, similarity_of(e)): 0.0 for e in pairs if similarity_of(e) >= near}
    for e, n in pairs.items():
        if similarity_of(e) >= near:
            x = max(threshold, similarity_of(e))
            like[x] += n / (TREES * x**depth)
    total = sum(like.values())
    if not total:
        return min(depth, floor)
    enough = [d for d in range(floor, depth + 1) if sum(n * found(x, d) for x, n in like.items()) >= recall * total]
    return max(enough, default=min(depth, floor))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int = WORDS):
        self.n, self.cache = n, {}

    def hashes(self, text: str):
        import numpy as np
        import xxhash

        cache, words = self.cache, WORD.findall(text)
        if len(cache) >= CACHE:
            cache.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set(words).difference(cache):
            cache[w] = digest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(h))
        if not width:
            return h
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - width + 1, np.uint64)
            for j in range(width):
                out = (out ^ h[j : len(h) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return np.unique(out)


def permutations(count: int = PERMUTATIONS):
    """Odd 32-bit multipliers, drawn by hashing their numbers."""
    import numpy as np

    return np.array([int.from_bytes(hashlib.blake2b(f"permutation {k}".encode(), digest_size=4).digest(), "little") | 1 for k in range(count)], np.uint32)


def signature(hashes, multipliers):
    """Least values of m * low + high over the set, for each multiplier m."""
    import numpy as np

    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 512):
            block = multipliers[:, None] * low[None, at : at + 512]
            block += high[None, at : at + 512]
            np.minimum(best, block.min(axis=1), out=best)
    return best


def layout(trees: int = TREES, levels: int = LEVELS, count: int = PERMUTATIONS):
    """Permutation of each tree's levels; the upper levels of different trees share none while there are enough."""
    import numpy as np

    return np.array([[(level * trees + tree * (1 if level * trees + tree < count else 7)) % count for level in range(levels)] for tree in range(trees)])


def trie_keys(sig, places):
    """Two 64-bit halves of each tree's key: the tree's number and levels in the order of the trie."""
    import numpy as np

    level = ((sig[places] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)  # (trees, levels)
    first = np.arange(len(level), dtype=np.uint64) << np.uint64(HALF * BITS)
    second = np.zeros(len(level), np.uint64)
    for k in range(LEVELS):
        at = np.uint64(BITS * (HALF - 1 - k % HALF))
        if k < HALF:
            first |= level[:, k] << at
        else:
            second |= level[:, k] << at
    return first, second


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, class, keys, sketch) of each row: set size, digest of the set, the trie keys, 2 bits per permutation."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler, multipliers, places = Shingler(words), permutations(), layout()
        shifts = np.arange(4, dtype=np.uint8) * 2
        for batch in batches:
            n, cls, keys, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingler.hashes(text.as_py())
                sig = signature(s, multipliers)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(np.concatenate(trie_keys(sig, places)).tobytes() if len(s) else b"")
                bits = ((sig ^ (sig >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
                sketches.append((bits << shifts).sum(axis=1, dtype=np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (cls, keys, sketches))], names=["id", "n", "class", "keys", "sketch"])

    return rows.mapInArrow(run, f"{field_ddl(rows, 'id')}, n bigint, class binary, keys binary, sketch binary")


def unite(parent, i, j):
    """Union of the pairs (i, j) in a parent array; every node then points at the smallest of its set."""
    import numpy as np

    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


SKETCH = [f"s{k}" for k in range(PERMUTATIONS // 32)]
#: A row of the tries: the key's halves, the class's number, its set size and its sketch.
TRIE = ["k1", "k2", "node", "n", *SKETCH]


def tries(classes: DataFrame) -> DataFrame:
    """The sorted prefix tries, with the number of the sorted part each row belongs to."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(batch.num_rows, 2, TREES)
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            each = lambda x: pa.array(np.repeat(x, TREES), pa.int64())
            half = lambda k: pa.array(np.ascontiguousarray(keys[:, k]).ravel(), pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([half(0), half(1), each(batch.column(0).to_numpy()), each(batch.column(1).to_numpy()), *(each(sketch[:, k]) for k in range(len(SKETCH)))], names=TRIE)

    rows = classes.where("n > 0").select(number("class").alias("node"), "n", "keys", "sketch").mapInArrow(spread, ", ".join(f"{c} bigint" for c in TRIE))
    return rows.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").withColumn("part", F.spark_partition_id())


def number(cls: str) -> Column:
    """The first 64 bits of a class's digest; two classes with one number only become candidates of each other."""
    return F.conv(F.hex(F.substring(cls, 1, 8)), 16, -10).cast("long")


def sketch_floor(threshold: float) -> float:
    share = threshold + (1 - threshold) / 4  # equal 2-bit values at the threshold
    return (share - 6 * math.sqrt(share * (1 - share) / PERMUTATIONS)) * PERMUTATIONS


def equal_values(a, b):
    """Equal 2-bit values of sketches along the last axis."""
    import numpy as np

    diff, low = a ^ b, np.uint64(0x5555555555555555)
    return PERMUTATIONS - np.bitwise_count((diff | (diff >> np.uint64(1))) & low).sum(axis=-1, dtype=np.int64)


class Pairs:
    """Compares classes of trie nodes by sketch and length: which may be linked, and by how many equal values."""

    def __init__(self, threshold: float):
        import numpy as np

        self.threshold, self.floor = threshold, sketch_floor(threshold)
        self.equal = np.zeros(PERMUTATIONS + 1, np.int64)

    def near(self, n, sketch, i, j):
        """Of pairs of rows (i, j) those that may be linked."""
        import numpy as np

        same = equal_values(sketch[i], sketch[j])
        ok = (same >= self.floor) & (np.minimum(n[i], n[j]) >= self.threshold * np.maximum(n[i], n[j]))
        self.equal += np.bincount(same[ok], minlength=len(self.equal))
        return i[ok], j[ok]

    def block(self, n, sketch, left, right, alone: bool):
        """The same for all pairs of two ranges of rows, 256 by 1024 at a time; alone: the ranges are one, its pairs taken once."""
        import numpy as np

        out_i, out_j = [], []
        for a in range(left.start, left.stop, 256):
            for b in range(a if alone else right.start, right.stop, 1024):
                i, j = np.meshgrid(np.arange(a, min(a + 256, left.stop)), np.arange(b, min(b + 1024, right.stop)), indexing="ij")
                i, j = (i[i < j], j[i < j]) if alone else (i.ravel(), j.ravel())
                i, j = self.near(n, sketch, i, j)
                out_i.append(i)
                out_j.append(j)
        return np.concatenate(out_i or [np.empty(0, np.int64)]), np.concatenate(out_j or [np.empty(0, np.int64)])

    def histogram(self) -> pa.RecordBatch:
        import numpy as np

        at = np.flatnonzero(self.equal)
        return found_rows(KINDS["count"], at, self.equal[at])


#: Kinds of rows that a search returns: an edge (a, b) of class numbers, a count of pairs (equal values, pairs), and a row of an open node.
KINDS = {"edge": 0, "count": 1, "open": 2}


def found_rows(kind: int, a, b, more: dict | None = None) -> pa.RecordBatch:
    import numpy as np

    none = pa.nulls(len(a), pa.int64())
    cols = [pa.array(np.full(len(a), kind), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays([*cols, *((more or {}).get(c, none) for c in TRIE)], names=["kind", "a", "b", *TRIE])


FOUND = ", ".join(f"{c} bigint" for c in ["kind", "a", "b", *TRIE])


def spanning(parent, node) -> pa.RecordBatch:
    """Edges to each set's smallest row."""
    import numpy as np

    k = np.flatnonzero(parent != np.arange(len(parent)))
    return found_rows(KINDS["edge"], node[k], node[parent[k]])


def search(trie: DataFrame, depth: int, threshold: float) -> DataFrame:
    """FOUND rows at a depth: nodes that are whole in a batch of sorted rows are compared there, the others are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pairs = Pairs(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = dict(zip([*TRIE, "part"], batch.columns))
            k1, k2, n, node, part = (col[c].to_numpy() for c in ("k1", "k2", "n", "node", "part"))
            p1 = k1 >> (BITS * max(0, HALF - depth))
            p2 = k2 >> (BITS * max(0, LEVELS - depth)) if depth > HALF else np.zeros_like(k2)
            seam = (np.diff(part) != 0) | (np.diff(k1) < 0) | ((np.diff(k1) == 0) & (np.diff(k2) < 0))
            new = np.append(True, seam | (np.diff(p1) != 0) | (np.diff(p2) != 0))
            starts = np.flatnonzero(new)
            run_no = np.cumsum(new) - 1
            size = np.diff(np.append(starts, len(k1)))
            cut_off = np.zeros(len(starts), bool)  # more rows of the node may stand elsewhere
            cut_off[[0, -1]] = True
            cut_off[run_no[:-1][seam]] = cut_off[run_no[1:][seam]] = True
            away = (cut_off | (size > NODE))[run_no]
            if away.any():
                rows = {c: pa.array(col[c].to_numpy()[away], pa.int64()) for c in TRIE[2:]}
                yield found_rows(KINDS["open"], p1[away], p2[away], rows | {"k1": pa.array(p1[away]), "k2": pa.array(p2[away])})
            sketch = np.stack([col[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)
            left, right = [], []
            here = np.where(away, 0, size[run_no])
            place = np.arange(len(k1)) - starts[run_no]
            for step in range(1, 33):  # small nodes: rows that far apart
                i = np.flatnonzero((here <= 32) & (place + step < here))
                if not len(i):
                    break
                i, j = pairs.near(n, sketch, i, i + step)
                left.append(i)
                right.append(j)
            for r in np.flatnonzero((size > 32) & ~away[starts]):
                own = range(int(starts[r]), int(starts[r] + size[r]))
                i, j = pairs.block(n, sketch, own, own, True)
                left.append(i)
                right.append(j)
            if left:
                yield spanning(unite(np.arange(len(k1)), np.concatenate(left), np.concatenate(right)), node)
        yield pairs.histogram()

    return trie.select(*TRIE, "part").mapInArrow(run, FOUND)


def open_nodes(rows: DataFrame, threshold: float) -> DataFrame:
    """FOUND rows of the open nodes (k1, k2: the prefix): a node's classes are dealt into blocks of about NODE, each pair of blocks to a task."""
    sizes = rows.groupBy("k1", "k2").agg(F.ceil(F.count("*") / NODE).alias("blocks"), F.count("*").alias("of")).where("of > 1").drop("of")
    dealt = rows.join(sizes, ["k1", "k2"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("k1", "k2", F.least("own", "to"), F.greatest("own", "to"))
    dealt = dealt.select(key.alias("key"), (F.col("own") <= F.col("to")).alias("low"), (F.col("own") == F.col("to")).alias("alone"), *TRIE[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pairs = Pairs(threshold)
        for part, bounds in key_runs(batches):
            low, alone = (part[c].to_numpy(zero_copy_only=False) for c in ("low", "alone"))
            for s, e in bounds:
                own = part.slice(s, e - s)
                order = np.argsort(~low[s:e], kind="stable")
                n, node = (own[c].to_numpy()[order] for c in ("n", "node"))
                sketch = np.stack([own[c].to_numpy()[order] for c in SKETCH], axis=1).view(np.uint64)
                first = range(0, int(low[s:e].sum()))
                i, j = pairs.block(n, sketch, first, first if alone[s] else range(first.stop, e - s), bool(alone[s]))
                if len(i):
                    yield spanning(unite(np.arange(e - s), i, j), node)
        yield pairs.histogram()

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between class numbers that join candidate classes, at the depth that reaches the recall.

    A node gives a spanning forest of its candidate pairs, so rows grow with classes, not with their pairs."""
    spark = classes.sparkSession
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    tries(classes).write.parquet(path)
    trie, depth = spark.read.parquet(path), LEVELS
    while True:
        out = cut(search(trie, depth, threshold))
        rest = cut(open_nodes(out.where(F.col("kind") == KINDS["open"]).select(*TRIE), threshold))
        out = out.where(F.col("kind") != KINDS["open"]).unionByName(rest)
        counts = out.where(F.col("kind") == KINDS["count"]).groupBy("a").agg(F.sum("b").alias("b")).collect()  # a row per number of equal values
        better = next_depth({r["a"]: r["b"] for r in counts}, depth, threshold)
        if better == depth:
            break
        depth = better
    remove(spark, path)
    return out.where(F.col("kind") == KINDS["edge"]).select("a", "b").distinct()


def common_counts(left: list, right: list):
    """Sizes of the intersections of all sets on the left with all on the right, as a product of incidence matrices over the elements that both sides hold."""
    import numpy as np

    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    parts = []
    for flat, row in sides:
        place = np.searchsorted(both, flat)
        ok = place < len(both)
        ok[ok] = both[place[ok]] == flat[ok]
        parts.append((place[ok], row[ok]))
    order = [np.argsort(p, kind="stable") for p, _ in parts]
    for at in range(0, len(both), 4096):  # sets count exactly in float32 up to 2**24 elements
        dense = []
        for (place, row), o, n in zip(parts, order, (len(left), len(right))):
            a, b = np.searchsorted(place[o], [at, at + 4096])
            m = np.zeros((n, min(4096, len(both) - at)), np.float32)
            m[row[o[a:b]], place[o[a:b]] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def verified(grouped: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """(class, other, linked, linked_docs): how many classes of its candidate group a class is linked to by an exact
    comparison of their n-gram sets, how many documents these hold, and a linked class towards the group's smallest.

    A candidate group of g classes is cut into blocks of about BLOCK; each pair of blocks is compared by one task's
    step, so a class travels once per block of its group and no pair of classes becomes a row."""
    sizes = grouped.groupBy("label").agg(F.count("*").alias("g"))
    nodes = grouped.join(sizes, "label").select("node", "label", F.ceil(F.col("g") / BLOCK).alias("blocks"))
    nodes = nodes.join(classes.where("n > 0").select(number("class").alias("node"), "class", "rep", "size", "sketch"), "node")
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).join(nodes, F.col("id").eqNullSafe(F.col("rep"))).select("class", "label", "blocks", "size", "sketch", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            live, out = [], []
            for k, (c, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5))):
                s = shingler.hashes(t.as_py())
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c:  # else another text under the same id
                    live.append(k)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(live, pa.int64())) for c in range(5)), pa.array(out, pa.binary())], names=["class", "label", "blocks", "size", "sketch", "s"])

    held = texts.mapInArrow(sets, "class binary, label bigint, blocks bigint, size bigint, sketch binary, s binary").dropDuplicates(["class"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = held.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("label", F.least("own", "to"), F.greatest("own", "to")).alias("key"), F.col("own") <= F.col("to"), F.col("own") == F.col("to"), "class", "size", "sketch", "s").toDF("key", "low", "alone", "class", "size", "sketch", "s")

    floor = sketch_floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for part, bounds in key_runs(batches):
            alone, low = part["alone"].to_numpy(zero_copy_only=False), part["low"].to_numpy(zero_copy_only=False)
            size, cls, sets_of = part["size"].to_numpy(), part["class"].to_pylist(), part["s"]
            out: list[tuple] = []
            for s, e in bounds:
                a = [k for k in range(s, e) if low[k]]
                b = a if alone[s] else [k for k in range(s, e) if not low[k]]
                if len(a) + len(b) < 2 or not a or not b:
                    continue
                own, bits = b is a, np.frombuffer(b"".join(part["sketch"].take(pa.array([*a, *b])).to_pylist()), np.uint64).reshape(len(a) + len(b), -1)
                near = equal_values(bits[: len(a), None], bits[None, len(a) :]) >= floor  # only these sets need comparing
                if own:
                    np.fill_diagonal(near, False)
                a, b = [k for k, x in zip(a, near.any(axis=1)) if x], [k for k, x in zip(b, near.any(axis=0)) if x]
                if not a:
                    continue
                b = a if own else b
                get = lambda ks: [np.frombuffer(sets_of[k].as_buffer(), np.uint64) for k in ks]  # noqa: E731, B023
                x = get(a)
                y = x if b is a else get(b)
                n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
                common = common_counts(x, y)
                link = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-6
                if b is a:
                    np.fill_diagonal(link, False)
                i, j = np.nonzero(link)
                if not len(i):
                    continue
                joined = unite(np.arange(e - s), np.array(a)[i] - s, np.array(b)[j] - s) + s
                docs_a, docs_b = link @ size[b], size[a] @ link
                for k, count, held_docs in [*zip(a, link.sum(axis=1), docs_a)] + ([] if b is a else [*zip(b, link.sum(axis=0), docs_b)]):
                    if count:
                        out.append((cls[k], cls[joined[k - s]], int(count), int(held_docs)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["class", "other", "linked", "linked_docs"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "class binary, other binary, linked bigint, linked_docs bigint")


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """A row per input row with its class, links and group.

    n_class_links counts linked classes, n_links other documents: the rest of the class, and all of each linked
    class. group_id is the smallest id that links lead to."""
    prints = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(prints.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    found = cut(verified(components(candidates(classes, threshold)), classes, docs, id_col, text_col, words, threshold))
    labels = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("class").agg(F.sum("linked").alias("linked"), F.sum("linked_docs").alias("linked_docs"))
    least = labels.join(classes.select(F.col("class").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("group_id"))
    grouped = labels.join(least, "label").select(F.col("node").alias("class"), "group_id")
    known = cut(classes.select("class", "rep", "size").join(links, "class", "left").join(grouped, "class", "left"))
    return prints.select("id", "class").join(known, "class").select(
        F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.col("size").alias("class_size"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_class_links"),
        (F.col("size") - 1 + F.coalesce("linked_docs", F.lit(0))).cast("long").alias("n_links"), F.coalesce("group_id", "rep").alias("group_id"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of documents joined by links, the one with the smallest id, with all its columns.

    Decided per row: null ids rank last, and of rows with one id and text one stays."""
    members = near_join(docs.select(row_key(docs, id_col, text_col).alias("row"), docs[text_col].alias("text")), "row", "text")
    return one_of_each(docs, row_key(docs, id_col, text_col), members.where("row <> group_id").select("row").distinct())


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents"))
