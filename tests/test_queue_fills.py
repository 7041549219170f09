"""queue_fills on dense tapes and odd rows, against its SQL."""

import collections
import datetime as dt
import random

import duckdb

from tapestride import plans

NAN = float("nan")


def written(path, rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    if rows:
        c.executemany("INSERT INTO events VALUES (?, ?, 1, ?, ?, ?)", [(k, ts, s, px, "{}" if n is None else f'{{"k": {n}}}') for k, ts, s, px, n in rows])
    c.sql(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    return collections.Counter(c.sql(plans.oracle_sql()["queue_fills"]).fetchall())


def shuffled(spark) -> int:
    """Bytes that all shuffles of the session wrote so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_dense_tape_makes_no_pairs(spark, tmp_path):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=r.randrange(3600)), "click", r.choice([8.0, 4.0, 2.0]), r.randrange(1, 2000)) for k in range(3000)]
    want = written(tmp_path, rows)
    before = shuffled(spark)
    got = collections.Counter(map(tuple, plans.queries()["queue_fills"](spark, str(tmp_path)).collect()))
    assert got == want and len({x[3] for x in want}) == 3
    assert shuffled(spark) - before < 200 * len(rows)


def test_odd_rows_agree_with_sql(spark, tmp_path):
    """Nulls, NaN, negative prices and sizes, equal moments, sizes beyond 64 bits together, ids of several rows, equal and not."""
    r = random.Random(7)
    for case in range(4):
        rows = []
        for k in range(500):
            ts = dt.datetime(2024, 3, 9, 20) + dt.timedelta(minutes=r.randrange(900), microseconds=r.choice([0, 1]))
            px = r.choice([1.0, 2.0, 4.0, 8.0, 0.0, -2.0, -1.0, NAN, None])
            n = r.choice([(3, 7, 15), (None, -3, 2, 5, 9, 0), (1 << 61, 1 << 62, 5, -(1 << 61)), (1, 2, 3)][case])
            rows.append((k if r.random() > 0.02 else None, ts if r.random() > 0.02 else None, r.choice(["click", "view", "view", None]), px, n))
        if case == 2:
            rows += [x for x in rows if r.random() < 0.2] * 2
        if case == 3:  # an id of two rows, of one limit
            rows += [(k, ts + dt.timedelta(hours=r.choice([1, 9])), s, px, n + 1) for k, ts, s, px, n in rows if k and ts and k % 5 == 0]
        folder = tmp_path / str(case)
        folder.mkdir()
        want = written(folder, rows)
        got = collections.Counter(map(tuple, plans.queries()["queue_fills"](spark, str(folder)).collect()))
        assert got == want, case
        assert len({x[3] for x in want}) == 3 and want.total() == len(rows)


def test_empty_tape(spark, tmp_path):
    assert not written(tmp_path, [])
    assert plans.queries()["queue_fills"](spark, str(tmp_path)).collect() == []
