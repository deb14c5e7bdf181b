"""Operators 2, 3 and 6, and the pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import exact_topk, license_scan, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("shard_size", [10**6, 150])
def test_op2_matches_sql(spark, sf_dir, shard_size):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = exact_topk.top_k(vectors, F.col("vec_id") % 100 == 0, shard_size=shard_size)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(exact_topk.ORACLE).fetchall())


def test_op2_corner_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, [0.25, 0.0]), (2, [0.25, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [-inf, 0.0]), (7, [1.0]), (None, [0.25, 0.0]), (0, [1.0, 0.5]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("score", F.lit("x")).coalesce(1)
    got = exact_topk.top_k(df, F.col("vec_id") % 100 == 0, k=4, shard_size=2)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # The repeated row is its copy's first candidate; equal scores go by id, NULL last.
    assert sorted(by[0]) == sorted(2 * [(1, 0, 1024 * 1024 + 512 * 512), (2, 1, 256 * 1024), (3, 2, 256 * 1024), (4, None, 256 * 1024)])
    assert sorted(by[100]) == [(1, 1, -256 * 1024), (2, 2, -256 * 1024), (3, None, -256 * 1024), (4, 0, -1024 * 1024)]
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_op2_with_a_third_of_all_vectors_equal(spark):
    """Equal vectors are cut into blocks; other lengths keep to themselves; few shards are visited."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 6)) * 3
    rows = [(i, [0.5] * 6 if i % 3 == 0 else (centres[i % 20] + rng.normal(size=6) * 0.1).tolist()[: 6 if i % 17 else 4]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows}
    got = {}
    for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, shard_size=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 1500, 50):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_op2_deals_by_space():
    points = np.random.default_rng(6).integers(-1000, 1000, (40_000, 5))
    dealer = exact_topk.Dealer(points[::10], 64)
    leaf = dealer.leaf(points)
    assert dealer.leaves == 64 and np.bincount(leaf, minlength=64).max() < 2 * 40_000 / 64
    boxes = sum(np.prod((points[leaf == i].max(axis=0) - points[leaf == i].min(axis=0)).astype(float)) for i in range(64))
    assert boxes < 1.01 * 2000.0**5  # they share the space and don't overlap
    same = exact_topk.Dealer(np.ones((50, 3), dtype=np.int64), 8)
    assert same.leaves == 1


def test_op2_large_numbers_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-(2**28), 2**28)) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, F.col("vec_id") == 0, k=5, scale=8, shard_size=50).collect()
    ints = {i: [int(8 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(ints[0], ints[i], strict=True)), i) for i in ints if i), key=lambda t: t)[:5]
    assert [(r.vec_id, -r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, s) for s, i in want]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_op3_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    scored = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    s, p, y = (np.array([r[k] for r in scored]) for k in range(3))
    assert auc(s, y) > 0.9
    assert p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.03
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.5)).all()


@pytest.mark.parametrize("together", [np.logical_and, np.logical_xor])
def test_op3_learns_pairs(together):
    """With XOR neither term alone tells anything about the classes; both together tell all."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        docs.append(([10] if a else [11]) + ([20] if b else [21]) + sorted({30 + int(x) for x in rng.integers(0, 5, 2)}))
        labels.append(int(together(a, b)))
    labels = np.array(labels)
    flat = np.array([t for x in docs for t in x])
    machine = toxicity.fit_machine(labels, np.array([len(x) for x in docs]), flat)
    place = {b: i for i, b in enumerate(machine.buckets.tolist())}
    got = np.array([machine.margin(np.array([place[t] for t in x if t in place])) > 0 for x in docs])
    assert (got == labels).mean() > 0.98
    v = machine.factors[[place[10], place[20], place[21]]]
    assert (v[0] @ v[1] > 0.1) if together is np.logical_and else (v[0] @ v[1] < -0.1 < 0.1 < v[0] @ v[2])


def test_op3_pairs_among_thousands_of_terms():
    """Only pairs of two terms among 3,000 others tell the classes, of a term that weighs nothing alone."""
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(20_000):
        a, b = rng.random(2) < 0.5
        docs.append(sorted({10 if a else 11, 20 if b else 21, *(100 + rng.integers(0, 3000, 20)).tolist()}))
        labels.append(int(a != b))
    labels, sizes = np.array(labels), np.array([len(x) for x in docs])
    machine = toxicity.fit_machine(labels[:18_000], sizes[:18_000], np.array([t for x in docs[:18_000] for t in x]))
    place = {b: i for i, b in enumerate(machine.buckets.tolist())}
    got = np.array([machine.margin(np.array([place[t] for t in x if t in place], dtype=np.int64)) > 0 for x in docs[18_000:]])
    assert (got == labels[18_000:]).mean() > 0.95


def test_op3_pairs_work_on_the_given_labels(spark):
    """Kept terms have vectors, and the pair term makes held-out scores better than the weights alone."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    machine = toxicity.fit(docs, labels)
    assert (machine.factors != 0).any(axis=1).mean() > 0.9
    alone = toxicity.Machine(machine.bias, machine.buckets, machine.weights, np.zeros_like(machine.factors))
    loss, scores = {}, {}
    for name, m in (("pairs", machine), ("alone", alone)):
        rows = toxicity.score_documents(docs, m).join(labels, "doc_id").where("held_out and toxic is not null").orderBy("doc_id").collect()
        s, y = np.array([r.score for r in rows]).clip(1e-9, 1 - 1e-9), np.array([r.toxic for r in rows])
        loss[name], scores[name] = -np.log(np.where(y == 1, s, 1 - s)).mean(), s
    assert loss["pairs"] < 0.07 < loss["alone"] and np.abs(scores["pairs"] - scores["alone"]).max() > 0.1


def test_op3_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.3, np.arange(12), rng.normal(size=12), rng.normal(size=(12, 8)))
    for n in (0, 1, 2, 7, 12):
        t = rng.permutation(12)[:n]
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(t) for j in t[:k])
        assert machine.margin(t) == pytest.approx(-0.3 + machine.weights[t].sum() + pairs)


def test_op3_learns_from_its_fold_only(spark):
    rows = [(i, f"good text {i % 7}" if i % 2 else f"awful text {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    got = toxicity.score_documents(docs, a).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)


def test_op3_corner_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        for known in (labels, labels.limit(0)):
            rows = toxicity.score_documents(docs, toxicity.fit(docs, known)).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def brute_license(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [s for s, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_op6(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in license_scan.query(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    lines = {"cc-by-nc": "Licensed under CC BY-NC 4.0."}
    for label, line in lines.items():
        assert all(label in rows[i].labels.split(",") for i, t in texts.items() if line in (t or ""))


def test_op6_spans_survive_edits(spark):
    mit = license_scan.TEMPLATES[1][1].split()
    rng = random.Random(3)
    noise = lambda n: [f"n{rng.randrange(999)}" for _ in range(n)]
    edited = mit[:20] + ["inserted"] + mit[20:40] + mit[41:]
    rows = [(0, " ".join(noise(50) + mit + noise(50))), (1, " ".join(noise(5) + edited)), (2, " ".join(mit[:8] + noise(90))), (3, " ".join(noise(200))), (4, " ".join((noise(30) + mit) * 3))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "mit" and got[0].spans[0].start == 50 and got[0].score == 1.0
    assert got[1].labels == "mit" and len(got[1].spans) == 1
    assert got[2].labels == "" and got[3].labels == "" and got[3].score == 0.0
    assert len(got[4].spans) == 3


def test_op6_with_a_word_put_in_or_left_out_anywhere(spark):
    """One span of the license whole, wherever the edit is; five words more in one place don't split it."""
    whole = [t for label, t in license_scan.TEMPLATES if label == "mit"][-1].split()
    rows = [(i, " ".join(["before", "it", *whole[:i], "inserted", *whole[i:], "after", "it"])) for i in range(len(whole) + 1)]
    rows += [(1000 + i, " ".join(whole[:i] + whole[i + 1 :])) for i in range(len(whole))]
    rows += [(2000 + i, " ".join([*whole[:i], *[f"n{k}" for k in range(5)], *whole[i:]])) for i in range(len(whole))]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.labels == "mit" and len(r.spans) == 1 and r.spans[0].cover >= 0.95, (r.doc_id, r.spans)


def test_op6_votes_and_overlaps(spark):
    """Each template names its own license, also where another one's wording is almost the same."""
    rows = [(i, f"x y z {t} and more words") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, t) in enumerate(license_scan.TEMPLATES):
        assert {s.label for s in got[i].spans} == {label} and max(s.cover for s in got[i].spans) == 1.0, (label, got[i].spans)
    assert len({label for label, _ in license_scan.TEMPLATES}) >= 12


@pytest.mark.parametrize("seed", range(4))
def test_op6_spans_equal_brute_force(spark, seed):
    """Copies with some words changed: found where the best alignment of a template covers enough."""
    rng = random.Random(seed)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        label, text = rng.choice([x for x in license_scan.TEMPLATES if len(x[1].split()) > 40])
        words = [w.decode() for w in license_scan.words_of(text)]
        share = rng.choice([0.0, 0.05, 0.5])
        changed = {k for k in range(len(words)) if rng.random() < share}
        rows.append((i, " ".join(noise(30) + [f"c{k}" if k in changed else w for k, w in enumerate(words)] + noise(30))))
        cover = 1 - len(changed) / len(words)
        want[i] = (label, cover) if cover >= 0.85 else None
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if want[r.doc_id]:
            assert {s.label for s in r.spans} == {want[r.doc_id][0]} and max(s.cover for s in r.spans) > want[r.doc_id][1] - 0.06
        else:
            assert not any(s.cover >= 0.8 for s in r.spans if s.end - s.start > 30)


def test_op6_shuffles_marked_texts_alone(spark):
    licence = license_scan.TEMPLATES[1][1]
    rows = [(i, f"{licence} {i}" if i % 10 == 0 else f"plain words of text {i} and no licence at all") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(license_scan.scan(docs).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = license_scan.scan(docs)
        assert sorted(out.collect()) == want and sum(r.labels != "" for r in want) == 20
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The side with texts passes the bitmap before it meets the diagonals; the other branch has no such join.
    joins = [n for n, line in enumerate(plan) if "Join LeftOuter" in line]
    assert len(joins) == 1 and any("Union" in line for line in plan[: joins[0]])
    assert "held(" in "".join(plan[joins[0] + 1 : joins[0] + 6])


def test_op6_corner_cases(odd_docs, no_docs):
    rows = license_scan.scan(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(r.doc_id), brute_license(r.text)[0]) for r in odd_docs.collect())
    assert license_scan.scan(no_docs).collect() == []


def test_stages_on_odd_and_no_documents(spark, odd_docs, no_docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from quillgraph.llm import _shared

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            out = _shared.materialize(stage(spark, frame, str(tmp_path)), "odd")
            if name != "packing":
                assert out.columns == odd_docs.columns and out.count() <= frame.count()
                frame = out
        assert out.count() >= frame.count()


def test_pipeline(spark, sf_dir, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frame = docs.columns, docs
    for _, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in frame.select("doc_id").collect()}
        from quillgraph.llm import _shared

        frame = _shared.materialize(stage(spark, frame, sf_dir), "test")
        assert frame.columns == columns and {r.doc_id for r in frame.select("doc_id").collect()} <= before
    kept = {r.doc_id for r in frame.select("doc_id").collect()}
    packed = {r.doc_id for r in pipeline.run(spark, sf_dir).collect()}
    assert packed == kept and 0.5 * len(texts) < len(kept) < len(texts)
