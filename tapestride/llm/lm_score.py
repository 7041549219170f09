"""Word bigram scoring by deleted interpolation.

P(w | v) mixes the maximum-likelihood bigram and unigram estimates with the uniform distribution; the mixture
weights depend on how often v was seen (context-frequency buckets, powers of two) and are learned by expectation-
maximisation on held-out counts: every training token is held out in turn, its own occurrence deleted from counts.

How counts travel. Documents are taken in batches of bounded size. A batch asks for each distinct n-gram it holds
once, with the number of its training occurrences; requests are dealt by ranges of 64-bit n-gram hashes, which are
even whatever the words' frequencies are. A range adds up the requests and answers each batch in the order of its
request. Answers meet their batch again, and the counts of each token are written to the shared folder; EM reads
them as a histogram of bounded size, scoring reads them once more. No table of counts is broadcast or collected.

Cases: a null or empty text has one token, its end; a null id counts as the text ''; repeated ids are scored row by
row; with no training rows all of the mass is uniform; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of
from .counting import REQUEST, Vocabulary, answers, packed, request, shard_count, unpacked

BATCH_TOKENS = 2_000_000
HELD_OUT = (7, 2)
EM_ROUNDS = 60
#: Histogram cells for EM are quarter octaves of probability ratios within these exponents.
STEP, REACH = 4, 40
BUCKETS = 50


def bucket(context_count):
    """0 for an unseen context, then 1, 2, 3-4, 5-8, ..."""
    import numpy as np

    c = np.maximum(context_count, 1).astype(np.float64)
    return np.where(context_count > 0, 1 + np.ceil(np.log2(c)), 0).astype(np.int64).clip(0, BUCKETS - 1)


def pair_keys(left, right):
    import numpy as np

    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019))
        for shift in (32, 29):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Batch:
    """Documents of a batch: ids, training flags, token numbers; a document's tokens end with number 0."""

    def __init__(self, ids: list, train, sizes, tokens, words):
        self.ids, self.train, self.sizes, self.tokens, self.words = ids, train, sizes, tokens, words

    def save(self) -> bytes:
        import numpy as np

        return pickle.dumps((self.ids, packed(self.train.astype(np.uint8)), packed(self.sizes.astype(np.uint32)), packed(self.tokens.astype(np.uint32)), packed(self.words)))

    @classmethod
    def load(cls, data: bytes) -> Batch:
        import numpy as np

        ids, train, sizes, tokens, words = pickle.loads(data)
        return cls(ids, unpacked(train, np.uint8).astype(bool), unpacked(sizes, np.uint32).astype(np.int64), unpacked(tokens, np.uint32).astype(np.int64), unpacked(words, np.uint64))

    def pairs(self):
        """Distinct bigram keys, ascending, and each token's place among them."""
        import numpy as np

        before = np.concatenate([self.tokens[:1] * 0, self.tokens[:-1]])  # an end, number 0, precedes each first word
        return np.unique(pair_keys(self.words[before], self.words[self.tokens]), return_inverse=True)


def batches_of(docs: DataFrame, id_col: str, text_col: str, held_out: tuple[int, int]) -> DataFrame:
    """(batch, data): the documents of each input partition in batches of bounded size."""
    rows = docs.select(docs[id_col].alias("id"), F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("crc"), text_of(docs[text_col]).alias("text"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def made(ids, train, parts, vocabulary):
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            order = np.argsort(words, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            tokens = np.concatenate(parts)
            # ascending words; the end keeps number 0 by trading places
            first = int(place[0])
            trade = np.arange(len(words))
            trade[[0, first]] = [first, 0]
            words = words[order][trade]
            return Batch(ids, np.array(train), np.array([len(p) for p in parts]), trade[place[tokens]], words)

        ids, train, parts, total, vocabulary = [], [], [], 0, Vocabulary({b"": 0})
        for arrow_batch in arrow:
            for key, crc, text in zip(arrow_batch.column(0).to_pylist(), arrow_batch.column(1).to_pylist(), arrow_batch.column(2)):
                words = text.as_py().encode().lower().split()
                words.append(b"")
                parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                ids.append(key)
                train.append(crc % held_out[0] != held_out[1])
                total += len(words)
                if total >= BATCH_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([made(ids, train, parts, vocabulary).save()], pa.binary())], names=["batch", "data"])
                    number += 1
                    ids, train, parts, total, vocabulary = [], [], [], 0, Vocabulary({b"": 0})
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([made(ids, train, parts, vocabulary).save()], pa.binary())], names=["batch", "data"])

    return rows.mapInArrow(run, "batch bigint, data binary")


def grams(b: Batch):
    """(unigram keys ascending, their order among word numbers, bigram keys, places of tokens among bigrams)."""
    import numpy as np

    order = np.argsort(b.words, kind="stable")
    keys, places = b.pairs()
    return b.words[order], order, keys, places.ravel()


def requests(batches: DataFrame, shards: int) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for arrow_batch in arrow:
            for number, data in zip(arrow_batch.column(0).to_pylist(), arrow_batch.column(1)):
                b = Batch.load(data.as_py())
                uni, order, bi, places = grams(b)
                live = np.repeat(b.train, b.sizes)
                n_uni = np.bincount(b.tokens[live], minlength=len(uni))[order].astype(np.uint32)
                n_bi = np.bincount(places[live], minlength=len(bi)).astype(np.uint32)
                yield request(number, (uni, n_uni), (bi, n_bi), shards)

    return batches.mapInArrow(run, REQUEST)


def counted(batches: DataFrame, answered: DataFrame) -> DataFrame:
    """(data): each batch's documents with the counts of every token: its own, its context's, and both together."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        if not left.num_rows:
            raise RuntimeError("an answer without its batch")
        b = Batch.load(left["data"][0].as_py())
        uni, order, bi, places = grams(b)
        right = right.sort_by("shard")
        got = [np.concatenate([unpacked(x.as_py(), np.uint64) for x in right[k]]) for k in ("uni", "bi")]
        if len(got[0]) != len(uni) or len(got[1]) != len(bi):
            raise RuntimeError("a batch changed between request and answer")
        of_word = np.empty(len(uni), np.uint64)
        of_word[order] = got[0]
        data = pickle.dumps((b.ids, packed(b.train.astype(np.uint8)), packed(b.sizes.astype(np.uint32)), packed(b.tokens.astype(np.uint32)), packed(of_word), packed(got[1][places])))
        return pa.table({"data": pa.array([data], pa.binary())})

    return batches.groupBy("batch").cogroup(answered.select("batch", "shard", "uni", "bi").groupBy("batch")).applyInArrow(run, "data binary")


def counts_in(data: bytes):
    """(ids, train, sizes, own counts, context counts, bigram counts) of a counted batch."""
    import numpy as np

    ids, train, sizes, tokens, of_word, pairs = pickle.loads(data)
    own = unpacked(of_word, np.uint64).astype(np.int64)[(t := unpacked(tokens, np.uint32).astype(np.int64))]
    end = unpacked(of_word, np.uint64).astype(np.int64)[0]
    return ids, unpacked(train, np.uint8).astype(bool), unpacked(sizes, np.uint32).astype(np.int64), own, np.concatenate([[end], own[:-1]]) if len(t) else own, unpacked(pairs, np.uint64).astype(np.int64)


def held_out_cells(counted_batches: DataFrame, n: int, v: int) -> DataFrame:
    """Histogram (bucket, q2, q0, weight) of training tokens, each held out: quarter octaves of bigram over unigram, and of uniform over unigram estimates. A ratio beyond reach takes the end cell; REACH + 1 stands for no estimate."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for arrow_batch in arrow:
            for data in arrow_batch.column(0):
                _, train, sizes, own, context, both = counts_in(data.as_py())
                live = np.repeat(train, sizes)
                c, x, xy = own[live] - 1, context[live] - 1, both[live] - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    p1, p2 = c / max(n - 1, 1), np.where(x > 0, xy / np.maximum(x, 1), 0.0)
                    cell = lambda p: np.where(p > 0, np.clip(np.round(STEP * np.log2(p / np.where(p1 > 0, p1, 1.0))), -STEP * REACH, STEP * REACH), -STEP * (REACH + 1)).astype(np.int64)
                    q2, q0, dead = cell(p2), cell(np.full(len(c), 1 / (v + 1))), (p1 <= 0).astype(np.int64)
                code = ((bucket(x) * 2 + dead) * 512 + q2 + 256) * 512 + q0 + 256
                code, weight = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(weight, pa.int64())], names=["cell", "weight"])

    return counted_batches.mapInArrow(run, "cell bigint, weight bigint").groupBy("cell").agg(F.sum("weight").alias("weight"))


def learned(cells: list[tuple[int, int]], rounds: int = EM_ROUNDS):
    """Mixture weights (bucket, [bigram, unigram, uniform]) by EM; an empty bucket gets even weights."""
    import numpy as np

    out = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    out[0] = [0.0, 0.5, 0.5]
    if not cells:
        return np.where(np.arange(BUCKETS)[:, None] >= 0, [0.0, 0.0, 1.0], out)
    code, weight = (np.array(x) for x in zip(*cells))
    q0, q2, dead, b = code % 512 - 256, code // 512 % 512 - 256, code // 512**2 % 2, code // 512**2 // 2
    p = np.stack([np.where(q2 < -STEP * REACH, 0.0, 2.0 ** (q2 / STEP)), np.where(dead == 1, 0.0, 1.0), 2.0 ** (q0 / STEP)], axis=1)
    for _ in range(rounds):
        share = out[b] * p
        share *= (weight / share.sum(axis=1))[:, None]
        for k in range(BUCKETS):
            if (own := b == k).any():
                out[k] = share[own].sum(axis=0) / share[own].sum()
    out = np.maximum(out, [0.0, 1e-9, 1e-9])
    return out / out.sum(axis=1, keepdims=True)


def probability(own, context, both, n: int, v: int, weights):
    """P(token | context) of each token."""
    import numpy as np

    w = weights[bucket(context)]
    return w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * own / max(n, 1) + w[:, 2] / (v + 1)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    import numpy as np

    shards = shard_count(docs.sparkSession)
    batches = batches_of(docs, id_col, text_col, held_out)
    answered = cut(answers(requests(batches, shards)))
    n, v = (int(x or 0) for x in answered.agg(F.sum("tokens"), F.sum("types")).first())
    scored = cut(counted(batches, answered))
    weights = learned([(r["cell"], r["weight"]) for r in held_out_cells(scored, n, v).collect()])  # of bounded size
    id_type = docs.schema[id_col].dataType

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, unit = to_arrow_type(id_type), n + v + 1
        for arrow_batch in arrow:
            for data in arrow_batch.column(0):
                ids, train, sizes, own, context, both = counts_in(data.as_py())
                starts = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                base = np.log10((own + 1) / unit)
                score = np.log10(probability(own, context, both, n, v, weights))
                cols = [pa.array(ids, kind), pa.array(~train), pa.array(sizes), pa.array(total((own > 0).astype(np.int64))), pa.array(np.full(len(ids), n, np.int64)), pa.array(total(base)), pa.array(total(score))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
