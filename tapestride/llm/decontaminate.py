"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

Texts become lower-case words (runs of letters, marks and digits). A fixed mask hashes the words at its selected
positions and ignores the others; test and training hashes are joined, and around every hit the two texts are
compared position by position, word by word as 64-bit hashes. A document overlaps an item if some `WINDOW`
consecutive words of the item stand in the document with at most `SPARE` substituted. The mask is lossless for that:
whichever two of 13 positions are substituted, at one of its places it selects none of them. Items of fewer words
than the window must stand in the document in whole; a contiguous mask of their own length finds them.

Texts are known by their SHA-256 digest: equal texts are searched together and reported for each id, so neither a
repeated id nor a null one mixes texts, and a candidate row holds one text, one item and the item's places in it.

Cases: null and empty texts overlap nothing; rows of one id and item are reported once, null ids too; identical
item rows count once; an empty table on either side gives no rows; very long texts are searched in whole; only ids
and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

WINDOW, SPARE = 13, 2
MASKS = ((0, 1, 3, 6, 7),)
#: Test hashes are broadcast up to so many (24 bytes each); more of them are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def hashed_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(h: Column, mask: tuple[int, ...]) -> Column:
    """Seed of the mask at each place of the hashed words h; places too near the end hash fewer words, and prove nothing."""
    salt = F.lit(len(mask) * 100 + mask[-1])
    return F.transform(h, lambda x, i: F.xxhash64(salt, x, *(F.get(h, i + o) for o in mask[1:])))


def placed_seeds(words: DataFrame, keep: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(keep, pos, seed) of all masks at all places of the hashed words w."""
    out = None
    for mask in masks:
        one = words.select(keep, F.posexplode(seeds(F.col("w"), mask)).alias("pos", "seed"))
        out = one if out is None else out.unionByName(one)
    return out


def held(array: Column) -> Column:
    """The array, evaluated once per row: a generator between two projections keeps the optimizer from copying it into lambdas."""
    return F.explode(F.array(array))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that overlap: ids, the most equal words in a window, equal words over the item, the item's words, and where its first word would stand in the document."""
    d = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).withColumn("doc", text_key(F.col("text")))
    b = items.select(items[item_col].alias("item"), hashed_words(text_of(items[item_text_col])).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("row", F.xxhash64("item", "w")).dropDuplicates(["row"])
    short = sorted(r[0] for r in b.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # 12 at most
    whole = tuple(tuple(range(n)) for n in short)
    test = placed_seeds(b.where(F.size("w") >= WINDOW), "row", MASKS)
    for mask in whole:
        test = test.unionByName(placed_seeds(b.where(F.size("w") == len(mask)), "row", (mask,)))
    test = test.withColumnRenamed("pos", "item_pos")
    if test.count() <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    train = placed_seeds(d.select("doc", hashed_words(F.col("text")).alias("w")), "doc", MASKS + whole)
    hits = train.join(test, "seed").select("doc", "row", (F.col("pos") - F.col("item_pos")).alias("shift"))
    near = hits.groupBy("doc", "row").agg(F.collect_set("shift").alias("shifts"))  # places in one text: bounded by its own words
    near = near.join(b, "row").join(d.select(F.col("doc").alias("of"), "text"), F.col("doc") == F.col("of"))
    near = near.dropDuplicates(["doc", "row"]).select("doc", "item", "row", "w", "shifts", held(hashed_words(F.col("text"))).alias("t"))
    near = near.select("doc", "item", "row", "w", "t", F.explode("shifts").alias("shift"))
    n, width = F.size("w"), F.least(F.size("w"), F.lit(WINDOW))
    place = lambda j: j + F.col("shift")
    same = F.transform("w", lambda x, j: F.when((place(j) >= 0) & F.coalesce(F.get("t", F.greatest(place(j), F.lit(0))) == x, F.lit(False)), 1).otherwise(0))
    near = near.select("doc", "item", "row", "w", "shift", held(same).alias("same"))
    window = F.array_max(F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x)))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    need = F.when(n < WINDOW, n).otherwise(WINDOW - SPARE)
    found = near.select("doc", "item", "row", window.alias("best"), total.alias("total"), n.alias("n"), "shift").where(F.col("best") >= need)
    found = found.groupBy("doc", "item", "row").agg(F.max("best").cast("long").alias("window_equal"), F.max("total").cast("long").alias("words_equal"), F.max("n").cast("long").alias("item_words"), F.min("shift").cast("long").alias("first_word"))
    found = found.join(d.select(F.col("doc").alias("of"), "id").distinct(), F.col("doc") == F.col("of"))
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col), "row").agg(*(f(c).alias(c) for f, c in ((F.max, "window_equal"), (F.max, "words_equal"), (F.max, "item_words"), (F.min, "first_word")))).drop("row")


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    bad = overlaps(docs, items, id_col, text_col).select(F.col(id_col).alias("bad_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like clean, but decided by each row's own text: a leaking row doesn't take others of its id, or of no id, with it."""
    keyed = docs.withColumn("_row", text_key(text_of(docs[text_col])))
    bad = overlaps(keyed, items, "_row", text_col).select(F.col("_row").alias("_bad")).distinct()
    return keyed.join(bad, F.col("_row") == F.col("_bad"), "left_anti").drop("_row")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
