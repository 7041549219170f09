"""Searches: parameters bred over generations, and the rules of a decision tree's leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simulate import first_touch


def chance(*parts) -> float:
    """A number in [0, 1) from the parts' text."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def exit_fitness(entries: DataFrame, people: list[dict]) -> dict[int, float]:
    """Mean result of every entry (side, entry_px, path) under each person's stop and target: one pass, a row a person."""
    g = F.array(*(F.struct(F.lit(k).alias("who"), F.lit(float(p["stop"])).alias("s"), F.lit(float(p["target"])).alias("t")) for k,
        p in enumerate(people)))
    e = entries.select("side", "entry_px", "path", F.explode(g).alias("g"))
    e = e.select("side", "entry_px", "path", (F.col("entry_px") - F.col("side") * F.col("g.s")).alias("stop"),
        (F.col("entry_px") + F.col("side") * F.col("g.t")).alias("target"), F.col("g.who").alias("who"))
    return {r["who"]: r["m"] for r in first_touch(e).groupBy("who").agg(F.avg("pnl").alias("m")).collect()}  # a row a person


def evolve(spark: SparkSession, bounds: dict[str, tuple[float, float]], fitness: Callable[[list[dict]], dict[int, float]], people: int,
    generations: int, seed: str = "evolve") -> DataFrame:
    """(generation, person, each parameter, fitness) of a genetic search: the better half lives on, children take each
    parameter of one of two parents and are moved by up to a tenth of its span. The driver holds a generation's parameters."""
    now = [{n: round(lo + (hi - lo) * chance(seed, 0, k, n), 4) for n, (lo, hi) in bounds.items()} for k in range(people)]
    rows = []
    for g in range(generations):
        score = fitness(now)
        order = sorted(range(people), key=lambda k: (-(score.get(k) if score.get(k) is not None else float("-inf")), k))
        rows += [(g, k, *now[k].values(), score.get(k)) for k in range(people)]
        best = [now[k] for k in order[: max(2, people // 2)]]
        children = []
        for k in range(people - len(best)):
            a, b = (best[int(chance(seed, g, k, side) * len(best))] for side in "ab")
            child = {}
            for n, (lo, hi) in bounds.items():
                x = (a if chance(seed, g, k, n, "of") < 0.5 else b)[n] + (chance(seed, g, k, n, "by") - 0.5) * 0.2 * (hi - lo)
                child[n] = round(min(hi, max(lo, x)), 4)
            children.append(child)
        now = best + children
    return spark.createDataFrame(rows, "generation int, person int, " + ", ".join(f"`{n}` double" for n in bounds) + ", fitness double")


def leaf_rules(rows: DataFrame, features: list[str], value: str, depth: int, least: int) -> DataFrame:
    """(rule, n, mean_value) of a regression tree's leaves, each rule a conjunction of thresholds that a filter can run."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    tree = DecisionTreeRegressor(featuresCol="_x", labelCol=value, maxDepth=depth, minInstancesPerNode=least, seed=7).fit(data)
    out: list[list[str]] = []

    def walk(node, path: list[str]) -> None:
        if node.numDescendants() == 0:
            out.append(path)
            return
        split = node.split()
        name, at = features[split.featureIndex()], split.threshold()
        walk(node.leftChild(), [*path, f"{name} <= {at!r}"])
        walk(node.rightChild(), [*path, f"{name} > {at!r}"])

    walk(tree._call_java("rootNode"), [])
    rules = [" AND ".join(p) or "true" for p in out]
    leaf = F.coalesce(*(F.when(F.expr(r), F.lit(r)) for r in rules))
    return rows.groupBy(leaf.alias("rule")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"))
