"""Toxicity by a classifier chain.

Categories are predicted one after another by sparse logistic models over word and word-beginning features; each
later model also sees the earlier categories' log-odds. In training these are out-of-fold, so that a model learns
from what its predecessors say of unseen documents. A fold holds whole texts: equal texts are never split.

The chain is fitted on the documents of at most `max_rows` labelled ids, the first ones by a hash of the id; of an id
that several documents carry, the least text. Scoring reads every whole text once, on the executors, without a shuffle.

Cases: a null or empty text gets the intercepts' probabilities; labels that are null, or contradict another row of
the same id, count as the larger label present, and not at all if all are null; with no labelled row the operator
raises ValueError; a category with one class only gets a constant probability; repeated ids are scored row by row.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field_ddl, table, text_of

#: Bound of the labelled sample.
MAX_ROWS = 8000
FOLDS = 5
#: Lengths of word beginnings that are features beside the word.
STEMS = (4, 5, 6)
#: A feature needs so many documents, and such a likelihood-ratio statistic, to enter; so many enter at most.
LEAST_DOCS, LEAST_G2, MOST_FEATURES = 4, 20.0, 4000
CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(f"w {word}".encode()), *(zlib.crc32(f"{k} {word[:k]}".encode()) for k in STEMS if len(word) >= k)]


@dataclass
class Linear:
    """Weights by feature hash; weights of earlier categories' log-odds; intercept."""

    weights: dict[int, float]
    chain: list[float]
    bias: float


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    thresholds: list[float]
    accuracy: list[float]  # out of fold


def chosen(codes, rows, y):
    """Feature codes whose presence goes with the label, by the G statistic of their 2x2 tables."""
    import numpy as np

    n, n1 = len(y), int(y.sum())
    df, d1 = np.bincount(codes), np.bincount(codes, weights=y[rows])
    table = np.stack([d1, df - d1, n1 - d1, n - n1 - (df - d1)])
    part = np.stack([df * n1, df * (n - n1), (n - df) * n1, (n - df) * (n - n1)]) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * np.nansum(np.where(table > 0, table * np.log(table / part), 0), axis=0)
    ok = np.flatnonzero((df >= LEAST_DOCS) & (g2 >= LEAST_G2))
    return ok[np.argsort(-g2[ok], kind="stable")[:MOST_FEATURES]]


def fit_logistic(codes, rows, dense, y, l2: float = 0.5, rounds: int = 300):
    """Sparse binary features (codes of rows) and dense columns; class-balanced, Adam on the whole sample."""
    import numpy as np

    n, k, m = len(y), int(codes.max()) + 1 if len(codes) else 0, dense.shape[1]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    theta, m1, m2 = np.zeros(k + m + 1), np.zeros(k + m + 1), np.zeros(k + m + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, theta[codes], n) + dense @ theta[k : k + m] + theta[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.concatenate([np.bincount(codes, g[rows], k) if k else np.empty(0), dense.T @ g, [g.sum()]])
        grad[:-1] += l2 * theta[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return theta[:k], theta[k : k + m], theta[-1]


def fit_chain(docs: list, groups: list[int], labels, names: list[str]) -> Chain:
    """docs: a feature-hash array each; groups: equal for equal texts; labels: (documents, categories) of 0 and 1."""
    import numpy as np

    if not len(docs):
        raise ValueError("no labelled rows")
    at = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    flat = np.concatenate([np.asarray(d, np.uint32) for d in docs])
    known, times = np.unique(flat, return_counts=True)
    known = known[times >= LEAST_DOCS]  # rarer features never enter a model, so the rest of the sample is let go
    codes = np.searchsorted(known, flat).astype(np.int32)
    held = codes < len(known)
    held[held] = known[codes[held]] == flat[held]
    at, codes = at[held], codes[held]
    del flat, times, held
    fold = np.array([zlib.crc32(str(g).encode()) % FOLDS for g in groups])
    earlier = np.zeros((len(docs), 0))
    out = Chain(list(names), [], [], [])

    def one(take, y, dense):
        """A model of the rows in take: codes, weights, chain weights, bias."""
        if not 0 < y[take].sum() < take.sum():
            p = np.clip(y[take].mean() if take.any() else 0.0, 1e-4, 1 - 1e-4)
            return np.empty(0, np.int64), np.empty(0), np.zeros(dense.shape[1]), float(np.log(p / (1 - p)))
        index = np.cumsum(take) - 1
        inside = take[at]
        own = chosen(codes[inside], index[at[inside]], y[take])
        place = np.full(len(known), -1)
        place[own] = np.arange(len(own))
        used = inside & (place[codes] >= 0)
        w, c, b = fit_logistic(np.append(place[codes[used]], len(own)), np.append(index[at[used]], 0), dense[take], y[take])
        return own, w[: len(own)], c, b

    def margin(model, dense):
        own, w, c, b = model
        full = np.zeros(len(known))
        full[own] = w
        return np.bincount(at, full[codes], len(docs)) + dense @ c + b

    for j in range(len(names)):
        y = np.asarray(labels)[:, j].astype(float)
        oof = np.zeros(len(docs))
        for k in range(FOLDS):
            if (fold == k).any():
                oof[fold == k] = margin(one(fold != k, y, earlier), earlier)[fold == k]
        oof = np.clip(oof, -15, 15)
        cuts = np.linspace(-4, 4, 33)
        right = [float(((oof > c) == (y == 1)).mean()) for c in cuts]
        best = max(right)
        level = float(np.median([c for c, r in zip(cuts, right) if r == best]))
        model = one(np.ones(len(docs), bool), y, earlier)
        out.models.append(Linear(dict(zip(known[model[0]].tolist(), model[1].tolist())), model[2].tolist(), float(model[3])))
        out.thresholds.append(1 / (1 + float(np.exp(-level))))
        out.accuracy.append(best)
        earlier = np.column_stack([earlier, oof])
    return out


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, max_rows: int) -> Chain:
    """Features are made on the executors; hashes of at most max_rows documents reach the driver."""
    import numpy as np

    names = list(categories)
    y = labels.groupBy(labels[id_col].alias("id")).agg(*(F.max(F.expr(sql).cast("int")).alias(n) for n, sql in categories.items())).dropna()
    y = y.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).join(F.broadcast(y), "id")
    rows = rows.groupBy("id", *names).agg(F.min("text").alias("text")).orderBy("id").select("text", *names)  # max_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [np.array(sorted({f for w in set(LETTERS.findall(t.lower())) for f in features(w)}), np.uint32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(found, pa.binary()), *batch.columns[1:]], names=["grp", "f", *names])

    got = rows.mapInArrow(run, "grp bigint, f binary, " + ", ".join(f"`{n}` int" for n in names)).toArrow()
    docs_f = [np.frombuffer(b.as_buffer(), np.uint32) for b in got["f"]]
    return fit_chain(docs_f, got["grp"].to_pylist(), np.column_stack([got[n].to_numpy() for n in names]) if len(docs_f) else np.empty((0, len(names))), names)


class Scorer:
    def __init__(self, chain: Chain):
        self.chain, self.cache = chain, {}
        self.of: dict[int, list[tuple[int, float]]] = {}
        for j, m in enumerate(chain.models):
            for f, w in m.weights.items():
                self.of.setdefault(f, []).append((j, w))

    def word(self, word: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got = self.cache[word] = tuple(f for f in features(word) if f in self.of)
        return got

    def score(self, text: str) -> list[float]:
        import math

        cache, present = self.cache, set()
        for w in set(LETTERS.findall(text.lower())):
            got = cache.get(w)
            if got is None:
                got = self.word(w)
            if got:
                present.update(got)
        z = [m.bias for m in self.chain.models]
        for f in sorted(present):
            for j, w in self.of[f]:
                z[j] += w
        for j, m in enumerate(self.chain.models):
            z[j] = max(-15.0, min(15.0, z[j] + sum(c * z[i] for i, c in enumerate(m.chain))))
        return [1 / (1 + math.exp(-x)) for x in z]


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a probability and a boolean is_<category> for each category."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))  # bounded by MOST_FEATURES
    names, thresholds = chain.names, chain.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(held.value))
        for batch in batches:
            p = [scorer.score(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([x[j] for x in p], pa.float64()) for j in range(len(names))]
            flags = [pa.array([x[j] > t for x in p], pa.bool_()) for j, t in enumerate(thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *flags], names=[id_col, *names, *(f"is_{n}" for n in names)])

    ddl = ", ".join([field_ddl(rows, "id", id_col), *(f"`{n}` double" for n in names), *(f"`is_{n}` boolean" for n in names)])
    return rows.mapInArrow(run, ddl)


#: Categories of the labels table in the chain's order, each as an expression of its columns. low_quality is no
#: toxicity of its own: it is the chain's helper link, whose probability the later model may use.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    return labelled(docs, labels, CATEGORIES, "doc_id", "text", max_rows)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))


def drop_flagged(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows that the chain does not put into the category, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))  # bounded by MOST_FEATURES
    j, at = chain.names.index(category), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(held.value))
        for batch in batches:
            stays = [scorer.score(t.as_py() or "")[j] <= scorer.chain.thresholds[j] for t in batch.column(at)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
