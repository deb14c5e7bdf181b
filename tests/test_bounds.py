"""What tasks hold and what jobs send stays bounded as tables grow."""

import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillgraph.functions import providers
from quillgraph.functions.vectors import cosine, norm
from quillgraph.operators import communities, components, decisions, graph, ranges, threads, windows
from quillgraph.plans import mining, q_chat, q_graph

# Workers can't import tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
QUICK = providers.Retry(attempts=1, first_delay=0.0)


def resident(*_):
    """MB that this process holds."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def told(step, prompt, data):
    """A provider that tells how much its process holds, and how many windows of its project it was asked about."""
    if step == "graph":
        seen = json.loads(prompt)["memory"].get("seen", 0) + 1
        return json.dumps({"nodes": [{"id": "d", "label": "Decision", "name": str(resident()), "description": str(seen)}], "edges": [], "summary": str(seen)})
    if step == "memory":
        return json.dumps({"seen": int(json.loads(data)["summary"])})
    return "{}"


@pytest.fixture(scope="module")
def wide(spark):
    """4,000 windows of 100,000 characters; rows with and without a project."""
    project = F.when(F.col("id") >= 50, F.lit(7))
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000))
    return spark.range(4000).select(F.lit("s").alias("source"), F.lit(0).alias("source_seq"), project.alias("project"), F.lit(0).cast("bigint").alias("thread_idx"), F.col("id").alias("window_idx"), F.col("id").cast("string").alias("window_ref"), text.alias("window_text"))


def test_a_project_streams_through_its_task(wide):
    rows = mining.mine_in_order(wide, told, QUICK).select("window_idx", F.col("nodes")[0]["name"].cast("double").alias("mb"), F.col("nodes")[0]["description"].cast("int").alias("seen")).collect()
    assert len(rows) == 4000 and max(r.mb for r in rows) < 450
    assert all(r.seen == (r.window_idx - 49 if r.window_idx >= 50 else r.window_idx + 1) for r in rows)


def test_calls_hold_a_batch(spark, wide):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = providers.call(wide.withColumn("prompt", F.lit("")), resident_answer, "x", data="window_text", retry=QUICK)
    assert found.agg(F.max(F.col("response").cast("double"))).first()[0] < 450
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def resident_answer(step, prompt, data):
    return str(resident())


def test_long_windows_broadcast_nothing(spark):
    rows = spark.range(1, 3001).select(F.struct(F.lit("a").alias("source")).alias("key"), F.col("id").alias("rn"), F.lit(2000).cast("bigint").alias("len"))
    found = windows.long_windows(rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    # Windows of five messages overlap by four.
    assert sorted((r.window_idx, r.first_rn, r.last_rn) for r in found.collect()) == [(n, n + 1, n + 5) for n in range(2996)]


def test_settled_sources_are_not_looked_at_again(spark, monkeypatch):
    asked = []
    wishes = communities.wishes
    monkeypatch.setattr(communities, "wishes", lambda state, links: (asked.append(state.select("source").distinct().count()), wishes(state, links))[1])
    # Pairs settle at once, a ring with chords takes more steps.
    pairs = [(f"p{n}", 2 * n, 2 * n + 1, 1.0) for n in range(40)]
    ring = [("ring", 1000 + n, 1000 + (n + d) % 40, 1.0) for n in range(40) for d in (1, 2)]
    edges = spark.createDataFrame(pairs + ring, "source string, id bigint, target bigint, weight double")
    members = edges.select("source", "id").unionByName(edges.select("source", F.col("target").alias("id"))).distinct()
    found = {r.id: r.community for r in communities.thread_communities(members, edges).collect()}
    assert len(found) == 120 and all(found[2 * n + 1] == found[2 * n] == 2 * n for n in range(40))
    assert asked[0] == 41 and min(asked) == 1


def test_united_subgraphs_are_gathered_once(spark, sf_dir, monkeypatch):
    passes = spark.sparkContext.accumulator(0)
    edges_of = q_graph._edges

    def counted(seq):
        passes.add(1)
        return seq

    monkeypatch.setattr(q_graph, "_edges", lambda *a: edges_of(*a).withColumn("seq", F.udf(counted, "bigint")("seq")))
    rows = edges_of(spark, sf_dir).count()
    assert q_graph.union_first_nodes(spark, sf_dir).count() > 0
    assert passes.value <= rows


@pytest.mark.parametrize("block", [7, 1024])
def test_best_lookback_as_by_pairs(spark, block):
    rng = random.Random(8)
    vecs = [[rng.choice([0.0, 0.3, 0.7, 1.1]) for _ in range(6)] for _ in range(12)] + [None, [0.0] * 6, [1.0]]
    rows = [(("a", "b", "c")[n % 7 % 3], n, n * 10, None if n % 17 == 3 else n * 900 * (1 + n % 2), rng.choice(vecs), n % 5 > 0) for n in range(300)]
    df = spark.createDataFrame(rows, "source string, pos bigint, id bigint, secs bigint, vec array<double>, asks boolean").withColumn("ts", F.timestamp_seconds("secs"))
    pairs = threads.lookback_pairs(df.withColumn("norm", norm(F.col("vec"))), ["source"]).where("asks")
    want = threads.best_previous(pairs, ["source", "id"], "prev_id", cosine(F.col("vec"), F.col("prev_vec"), F.col("norm"), F.col("prev_norm")), 0.6)
    got = threads.best_lookback(df, least=0.6, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 50


def test_edges_of_threads_are_computed_once(spark):
    passes = spark.sparkContext.accumulator(0)

    def counted(i):
        passes.add(1)
        return i

    edges = spark.range(50).select(F.udf(counted, "bigint").asNondeterministic()("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.connected_components(edges).select("component").distinct().count() == 1
    assert passes.value == 50


def broadcast_joins(monkeypatch, modules, run):
    """The broadcast joins in the plans of what ``run`` writes and returns, as the tables' sizes alone suggest them."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = components.cut_lineage
    for m in modules:
        monkeypatch.setattr(m, "cut_lineage", noted)
    last = run()
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5
    return [line.strip() for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_messages_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Tables with a row a message, a link, a window or an answer look small to Spark as files; only places of range
    partitions, a row each, may go through the driver."""
    found = broadcast_joins(monkeypatch, (components, ranges, windows, providers), lambda: q_chat.provider_extract(spark, sf_dir))
    assert found and all("[_part#" in line for line in found)


def test_pairs_and_voters_are_not_broadcast(spark):
    nodes = spark.createDataFrame([("d", "Decision", "role", 0), ("x", "Component", "X", 1), ("y", "Component", "Y", 2), ("p", "Person", "P", 3)], "id string, label string, name string, seq bigint")
    edges = spark.createDataFrame([("d", "x", "RELATES_TO", 0), ("d", "y", "RELATES_TO", 1)] + [("p", "x", "VOTED_FOR", n) for n in range(2, 52)], "source string, target string, relation string, seq bigint")
    counts = decisions.vote_counts(graph.Graph(components.cut_lineage(nodes), components.cut_lineage(edges)))
    found = [line for line in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    # Nodes may be; a row a pair of nodes or a list of all voters may not.
    assert not [line for line in found if "target#" in line.split("]")[0]]
    assert counts._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [option_id#") == 1
    assert {(r.option_id, r.votes_for, len(r.voters_for)) for r in counts.collect()} == {("x", 50, 50), ("y", 0, 0)}
