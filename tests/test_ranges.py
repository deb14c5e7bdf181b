"""Numbers, sums, look-back and packing without a task or an array that holds a key."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import packed

from quillgraph.operators import ranges, threads, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, a NULL key, ties in the order broken by a second column."""
    rng = random.Random(2)
    rows = [(("hot", None, "a", "b")[min(3, rng.randrange(12) // 3) if rng.random() < 0.4 else 0], rng.randrange(50), i, rng.randrange(9)) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "k string, o int, i int, v bigint").repartition(7)


def in_order(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def test_numbers_within_keys(skewed):
    rows, frame = skewed
    got = ranges.number_within(frame, ["k"], ["o", "i"]).select("k", "i", "rn").collect()
    want = {(k, r[2], n + 1) for k, held in in_order(rows).items() for n, r in enumerate(held)}
    assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_numbers_over_all_rows(skewed):
    rows, frame = skewed
    got = sorted(ranges.global_number(frame, ["o", "i"]).select("n", "i").collect())
    assert [tuple(r) for r in got] == list(enumerate(r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))))


def test_running_sums_in_chunks(skewed):
    rows, frame = skewed
    numbered = ranges.number_within(frame.where("k is not null"), ["k"], ["o", "i"])
    got = {(r.k, r.rn): (r.upto, r.n) for r in ranges.running_sum(numbered, ["k"], "rn", "v", chunk=64).collect()}
    for k, held in in_order(rows).items():
        total = 0
        for n, r in enumerate(held if k else ()):
            total += r[3]
            assert got[k, n + 1] == (total, len(held))


def test_meeting_hot_and_other_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    values = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = ranges.hot_keys(rows, "k", 5000)
    assert [r.k for r in hot.collect()] == [0]
    got = ranges.meet(rows, values, "k", hot).collect()
    assert len(got) == 5000 and all(r.v == 2 * r.k for r in got)


@pytest.mark.parametrize("block", [21, 64, 1024])
def test_lookback_in_one_source(spark, block):
    rng = random.Random(block)
    rows = [("only", p, rng.randrange(40_000)) for p in range(0, 900, 3)] + [(None, 1, 5), (None, 2, 5), ("z", 9, None), ("z", 10, 1)]
    frame = spark.createDataFrame(rows, "source string, pos bigint, s int").select("source", "pos", F.col("pos").alias("id"), F.timestamp_seconds("s").alias("ts"))
    pairs = threads.lookback_pairs(frame.repartition(5), ["source"], block=block)
    by = {}
    for s, p, t in sorted(rows, key=lambda r: r[1]):
        by.setdefault(s, []).append((p, t))
    want = {(s, x[0], y[0]) for s, held in by.items() for i, x in enumerate(held) for y in held[max(0, i - 20) : i] if x[1] is not None and y[1] is not None and x[1] - y[1] <= 14_400}
    got = [tuple(r) for r in pairs.select("source", "id", "prev_id").collect()]
    assert len(got) == len(want) and set(got) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan and "Join" not in plan.replace("BroadcastHashJoin", "")


@pytest.mark.parametrize(("limit", "overlap"), [(600, 4), (300, 0), (0, 3), (40, 1)])
def test_long_threads_are_packed_like_short_ones(spark, limit, overlap):
    rng = random.Random(limit)
    lengths = {t: [rng.choice([0, 0, 5, 50, 400, 1500, None]) for _ in range(n)] for t, n in enumerate((1, 4, 5, 6, 31, 150))}
    rows = [(t or None, i + 1, x) for t, held in lengths.items() for i, x in enumerate(held)]
    frame = spark.createDataFrame(rows, "t int, rn bigint, chars bigint")
    for small in (0, 5):
        got = {}
        for r in windows.pack_windows(frame, ["t"], max_chars=limit, overlap=overlap, small=small).orderBy("window_idx").collect():
            got.setdefault(r.t or 0, []).append((r.window_idx, r.first_rn, r.last_rn))
        assert got == {t: [(i, *w) for i, w in enumerate(packed([x or 0 for x in held], limit, overlap))] for t, held in lengths.items()}


def test_threads_of_one_source_are_ordered(spark):
    rows = [("s", f"t{i % 4}", i, i, (i * 7) % 30 if i % 11 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "source string, thread string, id int, pos int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.thread, r.rn): (r.id, r.thread_idx) for r in threads.order_threads(frame.repartition(6)).collect()}
    last = lambda r: (r[4] is None, r[4] or 0, r[3])
    by = {t: sorted((r for r in rows if r[1] == t), key=last) for t in {r[1] for r in rows}}
    index = {t: n for n, t in enumerate(sorted(by, key=lambda t: last(by[t][0])))}
    assert got == {(t, n + 1): (r[2], index[t]) for t, held in by.items() for n, r in enumerate(held)}
