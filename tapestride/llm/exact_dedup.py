"""Exact dedup of an incoming batch against an immutable snapshot.

A snapshot is indexed once: its exact buckets, a row per digest, and for each shard of the digests a static
binary-fuse filter; both can be stored and serve any number of batches. A batch's rows are grouped among themselves by
digest; its distinct digests are screened by their shard's filter, and only the positives meet the snapshot's
buckets, where one text of either side is compared byte by byte. What stays is decided over both sides.

Texts are equal when identical after deleting ASCII white space. Cases: null counts as empty; equal texts keep the
row with the most code points, then the smallest id, null ids last; of rows equal in that too (repeated ids, several
null ids) one stays, whose keep_id is their common id or null; an empty snapshot or batch is allowed; only id and
text are read. A digest that two different texts share (the byte check finds it) keeps the two sides apart; inside
one side SHA-256 stands for the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, one_of_each, row_key, strip_ws, table, text_of

#: Rows for which one shard's filter is meant.
SHARD_ROWS = 16_384


def mixed(keys, seed: int):
    """64-bit finaliser of (key + seed): two xor-multiply rounds."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        for by, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(by))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """Three-wise binary-fuse filter with 8-bit fingerprints; static: built once from distinct keys."""

    def __init__(self, seed: int, segment: int, spans: int, prints):
        self.seed, self.segment, self.spans, self.prints = seed, segment, spans, prints

    def slots(self, keys):
        """Three slots in neighbouring segments, and the fingerprint."""
        import numpy as np

        h, mask = mixed(keys, self.seed), np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segment * self.spans)) >> np.uint64(32)
        step = np.uint64(self.segment)
        slots = np.stack([first, (first + step) ^ ((h >> np.uint64(18)) & mask), (first + step + step) ^ (h & mask)])
        return slots.astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys) -> BinaryFuse:
        import numpy as np

        keys = np.unique(np.asarray(keys, dtype=np.int64)).astype(np.uint64)
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        spans = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 1000):
            f = cls(seed * 0x9E3779B97F4A7C15 % 2**64, segment, spans, np.zeros((spans + 2) * segment, np.uint8))
            if f.fill(keys):
                return f
        raise RuntimeError("no seed peels these keys")

    def fill(self, keys) -> bool:
        """Peels, round by round, keys that own a slot alone; then sets fingerprints in the reverse order."""
        import numpy as np

        slots, prints = self.slots(keys)
        size, flat = len(self.prints), slots.ravel()
        count = np.bincount(flat, minlength=size)
        who = np.zeros(size, np.int64)
        np.bitwise_xor.at(who, flat, np.tile(np.arange(len(keys)), 3))
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                return False
            out, at = np.unique(who[alone], return_index=True)
            rounds.append((out, alone[at]))
            gone = slots[:, out].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(who, gone, np.tile(out, 3))
            left -= len(out)
        for out, own in reversed(rounds):
            self.prints[own] = 0
            a, b, c = (self.prints[slots[k, out]] for k in range(3))
            self.prints[own] = prints[out] ^ a ^ b ^ c
        return True

    def may_contain(self, keys):
        import numpy as np

        slots, prints = self.slots(np.asarray(keys, dtype=np.int64))
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


def key64(digest: Column) -> Column:
    return F.xxhash64(digest)


def sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.select("digest", key64(F.col("digest")).alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)))


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """A filter per shard of a snapshot's digests; written once, as the snapshot never changes."""

    def run(keys: pa.Table) -> pa.Table:
        f = BinaryFuse.build(keys["key"].to_numpy())
        return pa.table({"shard": keys["shard"][:1], "seed": [str(f.seed)], "segment": [f.segment], "spans": [f.spans], "prints": pa.array([f.prints.tobytes()], pa.binary())})

    rows = sharded(digests, shards).select("shard", "key")
    return cut(rows.groupBy("shard").applyInArrow(run, "shard bigint, seed string, segment bigint, spans bigint, prints binary"))


def screen(digests: DataFrame, filters: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """Those digests that a filter lets through: all that the snapshot has, and about 1 in 256 others.

    A shard's digests are split into `parts` by their key, each with its copy of the filter, so that a batch much
    larger than the snapshot doesn't crowd few shards."""

    def run(keys: pa.Table, found: pa.Table) -> pa.Table:
        import numpy as np

        if not keys.num_rows or not found.num_rows:
            return keys.select(["digest"]).slice(0, 0)
        row = found.slice(0, 1).to_pylist()[0]
        f = BinaryFuse(int(row["seed"]), row["segment"], row["spans"], np.frombuffer(row["prints"], np.uint8))
        return keys.select(["digest"]).filter(pa.array(f.may_contain(keys["key"].to_numpy())))

    dealt = sharded(digests, shards).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(run, "digest binary")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(strip_ws(text), 256))


def printed(docs: DataFrame, id_col: str, text_col: str, snap: bool) -> DataFrame:
    """(digest, own) of each row, own in the order in which rows of one text stay: most code points, smallest id, null ids last."""
    text = text_of(docs[text_col])
    rows = docs.select(digest_of(text).alias("digest"), (-F.length(text)).alias("n"), docs[id_col].isNull().alias("none"), docs[id_col].alias("id"))
    return cut(rows.select("digest", F.struct("n", "none", "id", F.lit(snap).alias("snap"), F.monotonically_increasing_id().alias("row")).alias("own")))


def buckets_of(prints: DataFrame) -> DataFrame:
    return cut(prints.groupBy("digest").agg(F.count("*").alias("size"), F.min("own").alias("keep")))


@dataclass
class Index:
    """A snapshot's texts, rows, exact buckets and filters."""

    docs: DataFrame
    prints: DataFrame
    buckets: DataFrame
    filters: DataFrame
    shards: int

    PARTS = ("prints", "buckets", "filters")

    def save(self, path: str) -> None:
        """Writes all but the texts, so that later batches need not read them."""
        for name in self.PARTS:
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, docs: DataFrame, path: str) -> Index:
        parts = [docs.sparkSession.read.parquet(f"{path}/{name}") for name in cls.PARTS]
        return cls(docs, *parts, shards_for(parts[1].count()))


def shards_for(digests: int) -> int:
    return max(1, -(-digests // SHARD_ROWS))


def index_snapshot(snapshot: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    prints = printed(snapshot, id_col, text_col, True)
    buckets = buckets_of(prints)
    shards = shards_for(buckets.count())
    return Index(snapshot, prints, buckets, build_filters(buckets.select("digest"), shards), shards)


def exact_dedup(incoming: DataFrame, snapshot: DataFrame | Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of either side: id, keep_id, group_size, kept, text_sha256, in_snapshot."""
    old = snapshot if isinstance(snapshot, Index) else index_snapshot(snapshot, id_col, text_col)
    prints = printed(incoming, id_col, text_col, False)
    new = buckets_of(prints)
    positive = screen(new.select("digest"), old.filters, old.shards, max(1, shards_for(new.count()) // old.shards))
    named = lambda df, side: df.select("digest", F.col("size").alias(f"size_{side}"), F.col("keep").alias(f"keep_{side}"))
    met = cut(positive.join(named(old.buckets, "old"), "digest").join(named(new, "new"), "digest"))
    same = met.join(same_texts(met, [(incoming, False), (old.docs, True)], id_col, text_col), "digest").where("same")
    both = cut(same.select("digest", (F.col("size_new") + F.col("size_old")).alias("size_both"), F.least("keep_new", "keep_old").alias("keep_both")))
    tagged = lambda df, snap: df.withColumn("snap", F.lit(snap))
    groups = tagged(new, False).unionByName(tagged(old.buckets, True)).join(both, "digest", "left")
    groups = groups.select("digest", "snap", F.coalesce("size_both", "size").alias("size"), F.coalesce("keep_both", "keep").alias("keep")).where("size > 1")
    rows = prints.unionByName(old.prints).withColumn("snap", F.col("own.snap")).join(groups, ["digest", "snap"], "left")
    alone = F.col("keep").isNull()
    return rows.select(
        F.col("own.id").alias(id_col), F.when(alone, F.col("own.id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep") == F.col("own"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("snap").alias("in_snapshot"),
    )


def same_texts(met: DataFrame, sides: list[tuple[DataFrame, bool]], id_col: str, text_col: str) -> DataFrame:
    """The byte check, (digest, same): for digests that both sides have, whether the texts of the two rows that would stay are equal."""
    row = F.explode(F.array("keep_new", "keep_old")).alias("x")
    asked = met.select("digest", row).select(F.col("digest").alias("asked"), F.col("x.snap").alias("of"), F.col("x.id").alias("by"), F.col("x.n").alias("chars"))
    held = None
    for docs, snap in sides:
        text = text_of(docs[text_col])
        part = docs.select(docs[id_col].alias("id"), (-F.length(text)).alias("n"), F.lit(snap).alias("snap"), digest_of(text).alias("digest"), strip_ws(text).alias("bare"))
        held = part if held is None else held.unionByName(part)
    at = (held["digest"] == asked["asked"]) & (held["snap"] == asked["of"]) & (held["n"] == asked["chars"]) & held["id"].eqNullSafe(asked["by"])
    return held.join(asked, at).groupBy("digest").agg((F.min("bare") == F.max("bare")).alias("same"))


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(incoming, snapshot) of one table, by a hash of the id."""
    old = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % 2 == 0
    return docs.where(~old), docs.where(old)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns, decided per row: null ids rank last, rows of one id and text are copies too."""
    key = lambda df: df.select(row_key(df, id_col, text_col).alias("row"), df[text_col].alias("text"))
    out = exact_dedup(*map(key, halves(docs, id_col)), "row", "text")
    return one_of_each(docs, row_key(docs, id_col, text_col), out.where("keep_id <> row").select("row").distinct())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(*halves(table(spark, sf_dir, "documents"))).drop("in_snapshot")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
k AS (SELECT bare, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM d JOIN k USING (bare)
"""
