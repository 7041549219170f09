"""The pipeline's filters decide per row: null and repeated ids."""

import random

from tapestride.llm import decontaminate, exact_dedup, near_join

DDL = "doc_id long, text string, lang string, n long"


def say(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]


def stay(stage, spark, rows):
    """(id, text) of the rows that stay, of rows in two orders."""
    out = []
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame([(k, t, "en", 1) for k, t in part], DDL).repartition(3)
        left = stage(docs)
        assert left.columns == docs.columns
        out.append(sorted(((x.doc_id, x.text) for x in left.collect()), key=repr))
    assert out[0] == out[1]
    return out[0]


def test_exact_copies(spark):
    a, b, c, d = (" ".join(say(20, k)) for k in range(4))
    rows = [(5, a), (5, a), (5, a), (5, b), (None, a), (None, b), (None, c), (None, c), (None, c + " "), (7, d), (7, d + "\n"), (9, None), (9, ""), (None, "  ")]
    want = [(5, a), (5, b), (None, c + " "), (7, d + "\n"), (None, "  ")]
    assert stay(exact_dedup.drop_copies, spark, rows) == sorted(want, key=repr)


def test_near_copies(spark):
    base, other, more = say(120, 1), say(120, 2), say(120, 3)
    a, b, c = map(" ".join, (base, other, more))
    near = lambda w, at: " ".join([*w[:at], "changed", *w[at + 1 :]])
    alone, clean, two = (" ".join(say(90, k)) for k in (4, 5, 6))
    rows = [(1, a), (None, near(base, 50)), (None, alone), (None, clean), (2, b), (3, near(other, 9)), (3, two), (None, c), (None, near(more, 70)), (4, two), (6, "x y"), (6, "x y")]
    got = stay(near_join.one_of_each_group, spark, rows)
    kept = {t: k for k, t in got}
    assert len(kept) == len(got)
    one = c if c in kept else near(more, 70)  # of two null ids the text's digest decides
    assert kept == {a: 1, alone: None, clean: None, b: 2, two: 3, one: None, "x y": 6}


def test_leaks(spark):
    item = " ".join(say(30, 8))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "before " + item), (None, "clean words"), (None, None), (1, item), (1, "again"), (2, "")]
    assert stay(lambda d: decontaminate.clean_rows(d, items), spark, rows) == sorted([(None, "clean words"), (None, None), (1, "again"), (2, "")], key=repr)


def test_stages_are_these(spark, tmp_path):
    """The pipeline's own stage decides per row."""
    import corpus_pipeline

    item = " ".join(say(30, 8))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stay(lambda d: corpus_pipeline.drop_leaks(spark, d, str(tmp_path)), spark, [(None, item), (None, "clean words")]) == [(None, "clean words")]
