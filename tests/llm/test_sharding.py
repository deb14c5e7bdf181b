"""Operator 4."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillgraph.llm import _shared, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4099])
def test_positions_are_a_permutation(n):
    assert sorted(sharding.position(i, n) for i in range(n)) == list(range(n))


def test_expression_equals_integers(spark):
    for n in (1, 3, 1000, 10**6 + 3, 5 * 10**12):
        rows = spark.range(0, min(n, 50)).selectExpr(f"id * {max(1, n // 50)} as row").where(f"row < {n}")
        got = rows.select("row", sharding.permuted(rows["row"], n).alias("p")).collect()
        assert all(r.p == sharding.position(r.row, n) for r in got)


def check(rows, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_op4(spark, sf_dir, texts):
    rows = sharding.query(spark, sf_dir).collect()
    check(rows)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in sharding.query(spark, sf_dir).repartition(3).collect()}


def test_corner_cases(odd_docs, no_docs):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sorted(r.row_number for r in rows) == list(range(len(rows)))
    check(rows)
    assert {r.size for r in rows if r.text is None} == {1}
    assert sharding.shard(no_docs).collect() == []


@pytest.mark.parametrize("broadcast", [50_000, 2])
def test_numbers_follow_files(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(_shared, "MAX_BROADCAST_FILES", broadcast)
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for frame in (df, df.where("id % 3 = 0"), df.unionAll(df)):
        rows, n = _shared.number_rows(frame, frame["id"] if "id" in frame.columns else None)
        assert sorted(r["_row"] for r in rows.collect()) == list(range(n)) and n == frame.count()


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 50, 97, 1000, 4097])
def test_walks_end(n):
    """The longest walk is exact: positions are a permutation, and a shorter one wouldn't do."""
    for seed in range(4):
        assert sorted(sharding.position(i, n, seed) for i in range(n)) == list(range(n))
        steps, rows = sharding.longest_walk(n, seed), np.arange(n, dtype=np.int64)
        walks = []
        for _ in range(steps + 1):
            rows = sharding._once(rows, n, seed, 8)
            walks.append(bool((rows >= n).any()))
            rows = rows[rows >= n]
        assert walks == [True] * steps + [False]


def test_write_shards_keeps_every_row(spark, odd_docs, no_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = sorted((str(r.doc_id), str(r.text)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == want
    sharding.write_shards(no_docs, str(tmp_path / "none"))
    assert (tmp_path / "none" / "_SUCCESS").exists() and not list((tmp_path / "none").glob("shard=*"))
