"""Operators on small literals, corner cases included."""

import json
import random
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import providers, votes
from quillgraph.functions import text as text_fn
from quillgraph.operators import communities, components, decisions, graph, ranges, similarity, threads, windows
from quillgraph.plans import mining, pipeline
from quillgraph.sources import chat, sinks

QUICK = providers.Retry(attempts=2, first_delay=0.0)


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "direction", "target"),
    [
        ("я за React, да", "for", "react"),
        ("голосую за C++ и C#", "for", "c++ и c#"),
        ("из-за ошибки", "for", "ошибки"),
        ("не за Vue", "for", "vue"),
        ("поддерживаю Redis", "for", "redis"),
        ("против Vue!", "against", "vue"),
        ("не хочу Mongo", "against", "mongo"),
        ("Ок!", "for", None),
        ("не надо", "against", None),
        ("Ок, принято.", None, None),
        (None, None, None),
    ],
)
def test_votes(spark, text, direction, target):
    assert one(spark, votes.detect_vote, text) == Row(direction=direction, target=target)


def test_texts(spark):
    assert one(spark, text_fn.embedding_text, " \n\t ") == "empty"
    assert one(spark, text_fn.slug, "POST /log-in Ж") == "post_/log_in_ж"
    assert one(spark, text_fn.custom_id, "x" * 50) == "custom_" + "x" * 23
    assert one(spark, text_fn.rich_text, '["a",{"text":"b"},{"y":1},"c"]') == "abc"
    assert one(spark, text_fn.rich_text, None) == ""
    assert one(spark, text_fn.reply_snippet, None, "a\nb" + "c" * 60).endswith("a b" + "c" * 37 + '..."]')
    assert one(spark, lambda a: text_fn.parse_timestamp(a), "not a date") is None
    assert str(one(spark, lambda a: text_fn.parse_timestamp(a), "2024-01-01T00:00:00Z")) == "2024-01-01 00:00:00"


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(pairs + [(None, 1)], "src int, dst int")).collect()
    wanted = {n: find(n) for n in parent}
    wanted.setdefault(1, 1) if 1 in parent else None
    assert {r.node: r.component for r in got if r.node in wanted} == wanted


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def packed(lengths, limit, overlap):
    out, start, chars = [], 0, 0
    for i, x in enumerate(lengths):
        if chars + x > limit and i - start > overlap:
            out.append((start + 1, i))
            start = i - overlap
            chars = sum(lengths[start:i])
        chars += x
    return [*out, (start + 1, len(lengths))] if lengths else out


@pytest.mark.parametrize("seed", range(4))
def test_windows_match_a_loop(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 5, 50, 400, 1500]) for _ in range(rng.choice([1, 4, 5, 60]))]
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(lengths)], "t int, rn bigint, chars bigint")
    for limit, overlap in ((600, 4), (1000, 2), (10, 1)):
        got = windows.pack_windows(df, ["t"], max_chars=limit, overlap=overlap).orderBy("window_idx").collect()
        assert [(r.first_rn, r.last_rn) for r in got] == packed(lengths, limit, overlap)


def test_lookback_takes_four_hours_inclusive(spark):
    rows = [("s", i, i, ts) for i, ts in enumerate(["2024-01-01 00:00:00", "2024-01-01 04:00:00", "2024-01-01 08:00:01"])]
    df = spark.createDataFrame(rows, "source string, pos bigint, id bigint, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = threads.lookback_pairs(df, ["source"]).select("id", "prev_id").collect()
    assert sorted(map(tuple, got)) == [(1, 0)]


def test_id_zero_can_be_answered_and_reply_hides_similarity(spark):
    m = chat.create_messages(spark, [(0, "a", "one", "2024-01-01T00:00:00", None), (1, "b", "one", "2024-01-01T00:01:00", 0), (2, "b", "one", "2024-01-01T00:02:00", 77)], "s")
    v = threads.valid_messages(m).withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    got = {(r.id, r.target, r.weight) for r in threads.thread_edges(v).collect()}
    assert got == {(1, 0, 15.0), (2, 0, 1.0)}


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i % 2, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(0, 60, [0.0, 0.0, 0.0]), (1, 61, None)]
    df = spark.createDataFrame(rows, "label int, id bigint, vec array<double>")
    whole = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.9).collect()}
    blocks = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.9, block_rows=7).collect()}
    assert whole == blocks and len(whole) > 5 and all(a < b for a, b in whole)
    assert {(r.a, r.b) for r in similarity.lsh_pairs(df, 0.9).collect()} <= whole


def test_copies_are_clustered_without_their_pairs(spark, monkeypatch):
    rng = random.Random(6)
    seen = []
    pairs_of = similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda rows, *a: (seen.append(rows.count()), pairs_of(rows, *a))[1])
    vecs = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)] + [[0.0, 0.0, 0.0], [float("inf"), 0.0, 1.0]]
    rows = [((n % 3, None)[n == 4], f"n{i:03}", n) for i, n in enumerate(rng.choices(range(22), k=300))] + [(0, "none", None)]
    df = spark.createDataFrame([(k, i, None if n is None else vecs[n]) for k, i, n in rows], "label int, id string, vec array<double>")
    got = {(r.node, r.cluster) for r in graph.class_clusters(*similarity.similar_classes(df, 0.9)).collect()}
    # Only the zero and the infinite vector, which are like nothing, and one row a class are compared.
    assert seen == [20 + sum(n in (20, 21) for *_, n in rows)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    near = {(a, b) for a in range(20) for b in range(20) if a % 3 == b % 3 and 4 not in (a, b) and unit(vecs[a]) @ unit(vecs[b]) >= 0.9} | {(4, 4)}
    links = [(i, j) for _, i, n in rows for _, j, m in rows if i < j and (n, m) in near]
    want = {(r.node, r.cluster) for r in graph.duplicate_clusters(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == want and len({c for _, c in got}) < 20
    assert graph.class_clusters(*similarity.similar_classes(df, 1.5)).collect() == []


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_hashing_finds_pairs_without_comparing_all(spark, block_rows):
    """Pairs of 0.88 to 0.95, just above the threshold, among unrelated vectors, and a group of copies."""
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for i in range(700):
        v = rng.standard_normal(64)
        near = v + rng.uniform(0.35, 0.52) * rng.standard_normal(64)
        rows += [(i % 2, n, v.tolist()), (i % 2, n + 1, near.tolist())]
        n += 2
    rows += [(None, n + i, rows[0][2]) for i in range(9)] + [(0, n + 9, [0.0] * 64), (0, n + 10, None)]
    df = spark.createDataFrame(rows, "label int, id bigint, vec array<double>")
    exact = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.88).collect()}
    found = [(r.a, r.b) for r in similarity.lsh_pairs(df, 0.88, block_rows=block_rows).where("label is not null").collect()]
    assert len(set(found)) == len(found) and set(found) <= exact and len(exact) > 300
    assert len(found) >= 0.9 * len(exact)
    tried = similarity.lsh_candidates(df, 0.88, block_rows=block_rows).where("label is not null")
    assert tried.count() == tried.distinct().count() < 0.1 * 2 * 700 * 699 / 2


def test_more_rows_take_more_bits(spark):
    """So the pairs tried grow with rows times bands."""
    for rows in (1_000, 1_000_000, 10**9):
        bands = similarity.Bands.for_recall(rows, 0.88, 0.95)
        assert rows / 2**bands.bits * bands.bands < 600
        assert 1 - (1 - (1 - np.arccos(0.88) / np.pi) ** bands.bits) ** bands.bands >= 0.95


def louvain(edges: list[tuple[int, int, float]], nodes: list[int], seed: int = 0) -> dict[int, int]:
    """node -> community, numbered by smallest member. Nodes are visited in a seeded order
    and move to the neighbouring community that raises modularity most, level by level."""
    weight: dict[int, dict[int, float]] = {n: defaultdict(float) for n in nodes}
    for a, b, w in edges:
        weight[a][b] += w
        if a != b:
            weight[b][a] += w
    members = {n: [n] for n in nodes}
    rng = random.Random(seed)
    while True:
        degree = {n: sum(w for m, w in adj.items()) + adj.get(n, 0.0) for n, adj in weight.items()}
        total = sum(degree.values())
        if total == 0:
            break
        own = {n: n for n in weight}
        size = dict(degree)
        moved_any, moving = False, True
        while moving:
            moving = False
            order = sorted(weight)
            rng.shuffle(order)
            for n in order:
                links: dict[int, float] = defaultdict(float)
                for m, w in weight[n].items():
                    if m != n:
                        links[own[m]] += w
                now = own[n]
                size[now] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - size[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({now, *links}), key=lambda c: (gain(c), c == now))
                size[best] += degree[n]
                if best != now and gain(best) > gain(now) + 1e-12:
                    own[n], moving, moved_any = best, True, True
                else:
                    size[best] -= degree[n]
                    size[now] += degree[n]
        if not moved_any:
            break
        merged: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(own.values())}
        for n, adj in weight.items():
            for m, w in adj.items():
                if own[n] != own[m] or n == m:
                    merged[own[n]][own[m]] += w
                else:
                    merged[own[n]][own[n]] += w / 2
        together: dict[int, list[int]] = defaultdict(list)
        for n, c in own.items():
            together[c] += members[n]
        weight, members = merged, dict(together)
    return {n: min(group) for group in members.values() for n in group}


def modularity(edges, community):
    degree, size, total, inside = defaultdict(float), defaultdict(float), 0.0, 0.0
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        total += 2 * w
        inside += 2 * w * (community[a] == community[b])
    for n, d in degree.items():
        size[community[n]] += d
    return inside / total - sum((x / total) ** 2 for x in size.values())


def test_communities_are_as_good_as_the_loop(spark):
    """Groups that hang together loosely, a star, a node without edges; a source with a third of all rows."""
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    graphs = {"cliques": (100, clique(range(5)) + clique(range(10, 15)) + [(0, 10, 0.1)]), "star": (41, [(0, i, 1.0) for i in range(1, 41)])}
    for s in range(2):
        rng = random.Random(s)
        graphs[f"random {s}"] = (60, [(a, b, rng.choice([0.75, 0.9, 15.0])) for a in range(60) for b in range(a) if rng.random() < (0.4 if a % (4 + s) == b % (4 + s) else 0.03)])
    members = spark.createDataFrame([(s, i) for s, (n, _) in graphs.items() for i in range(n)], "source string, id long")
    edges = spark.createDataFrame([(s, a, b, w) for s, (_, es) in graphs.items() for a, b, w in es], "source string, id long, target long, weight double")
    got = defaultdict(dict)
    for r in communities.thread_communities(members, edges).collect():
        got[r.source][r.id] = r.community
    found = got["cliques"]
    assert {found[i] for i in range(5)} == {0} and {found[i] for i in range(10, 15)} == {10} and found[99] == 99
    for s, (n, es) in graphs.items():
        assert sorted(got[s]) == list(range(n)) and all(min(i for i in got[s] if got[s][i] == c) == c for c in set(got[s].values()))
        assert modularity(es, got[s]) > 0.98 * modularity(es, louvain(es, list(range(n)))) - 1e-9


def counting(folder, fails=()):
    """A provider that leaves a file for each call."""

    def provider(step, prompt, data):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if prompt in fails:
            raise ValueError(prompt)
        return f"{step}: {prompt}{data}"

    return provider


def test_equal_prompts_are_asked_once(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    df = spark.createDataFrame([(i, f"p{i % 7}", None if i % 2 else "d", 1) for i in range(200)], "id long, prompt string, data string, _k int").repartition(6)
    quick = providers.Retry(attempts=1)
    got = providers.call(df, counting(calls), "ask", retry=quick).collect()
    assert len(list(calls.iterdir())) == 14 and len(got) == 200
    assert all(r.response == f"ask: {r.prompt}{r.data or ''}" for r in got)
    # A failed call is asked again by the next run, an answered one isn't.
    first = providers.call(df, counting(calls, ("p3",)), "ask", retry=quick, answers=answers).collect()
    assert len(list(calls.iterdir())) == 28 and all((r.response is None) == (r.prompt == "p3") for r in first)
    again = providers.call(df, counting(calls), "ask", retry=quick, answers=answers).collect()
    assert len(list(calls.iterdir())) == 30 and all(r.response is not None for r in again) and len(again) == 200


def make(spark, nodes, edges):
    n = spark.createDataFrame([(*x, i) for i, x in enumerate(nodes)], "id string, label string, name string, description string, target_section string, seq bigint")
    e = spark.createDataFrame([(*x, "", i) for i, x in enumerate(edges)], "source string, target string, relation string, evidence string, seq bigint")
    return graph.Graph(n, e)


def node(i, label="Component", name=None):
    return (i, label, name or i, "", None)


def test_decisions(spark):
    nodes = [node(f"d{i}", "Decision") for i in range(6)] + [node(o) for o in "abcz"] + [node("u", "Person", "Ann")]
    edges = [("d0", "a", "RELATES_TO"), ("d0", "b", "RELATES_TO"), ("d0", "a", "RELATES_TO"), ("d1", "b", "RELATES_TO"), ("d1", "c", "RELATES_TO"), ("d2", "z", "RELATES_TO"), ("d3", "ghost", "RELATES_TO"), ("d5", "c", "MENTIONS")]
    edges += [("u", "a", "VOTED_FOR"), ("u", "a", "VOTED_FOR"), ("v", "b", "VOTED_FOR"), ("u", "c", "VOTED_FOR"), ("u", "z", "VOTED_AGAINST")]
    got = {r.decision_id: r for r in decisions.resolve_decisions(make(spark, nodes, edges)).collect()}
    assert set(got) == {"d0", "d1", "d2", "d3"}  # no options, no row
    assert got["d0"].winner_id == "a" and [o.option_id for o in got["d0"].options] == ["a", "b"]
    assert got["d0"].options[0].votes_for == 2 and got["d0"].options[0].voters_for == ["Ann", "Ann"] and got["d0"].options[1].voters_for == ["v"]
    assert got["d1"].is_tie and "b, c" in got["d1"].conflict_description  # b's vote counts in both
    assert got["d2"].winner_id == "z" and got["d2"].options[0].score == -1
    assert got["d3"].is_tie and got["d3"].options[0].option_name == "ghost"
    for r in got.values():
        assert (r.winner_id is None) == r.is_tie


def test_report_without_anything(spark):
    empty = decisions.resolve_decisions(make(spark, [node("a")], [("a", "a", "MENTIONS")]))
    assert decisions.merge_report(empty).first()["report"] == decisions.WORDING.nothing


def test_merge_keeps_edges_and_loops(spark):
    g = make(spark, [node("a"), node("b"), node("c")], [("a", "b", "MENTIONS"), ("b", "c", "MENTIONS"), ("c", "a", "MENTIONS")])
    actions = spark.createDataFrame([(True, ["a", "b"], "n", "new", "both", 0), (True, ["n", "a", "c"], "c", "x", "x", 1)], "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string, seq bigint")
    out = graph.merge_nodes(g, actions)
    assert [r.id for r in out.nodes.collect()] == ["c"]
    assert [(r.source, r.target, r.merged_loop) for r in out.edges.collect()] == [("c", "c", True)] * 3


MERGES = "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string, seq bigint"


def merged_one_by_one(ids, edges, rows):
    """Nodes (id -> (given node, name)), edges and valid ids of merge actions applied in order, one at a time."""
    nodes, ends, log = {i: (i, i) for i in ids}, [list(e) for e in edges], {}
    for _, named, unified, name, _, seq in rows:
        log[seq] = valid = [i for i in named if i in nodes]
        if valid and unified not in nodes:
            nodes[unified] = (nodes[valid[0]][0], name)
        for old in set(valid) - {unified}:
            ends = [[unified if x == old else x for x in e] for e in ends]
            del nodes[old]
    return nodes, ends, log


def same_merges(spark, ids, edges, rows):
    labelled = [(i, schemas.NODE_LABELS[n % 3], i, "", None, n) for n, i in enumerate(ids)]
    nodes = spark.createDataFrame(labelled, "id string, label string, name string, description string, target_section string, seq bigint")
    links = spark.createDataFrame([(a, b, "MENTIONS", "", n) for n, (a, b) in enumerate(edges)], "source string, target string, relation string, evidence string, seq bigint")
    g, actions = graph.Graph(nodes, links), spark.createDataFrame(rows, MERGES)
    want, ends, log = merged_one_by_one(ids, edges, rows)
    out, label = graph.merge_nodes(g, actions), {r[0]: r[1] for r in labelled}
    assert sorted((r.id, r.name, r.label) for r in out.nodes.collect()) == sorted((i, name, label[base]) for i, (base, name) in want.items())
    assert [[r.source, r.target] for r in out.edges.orderBy("seq").collect()] == ends
    assert {r.seq: r.valid_ids for r in graph.merge_outcomes(g, actions).collect()} == log
    # Made nodes come after the given ones, in the order of the actions that made them.
    made = [r.id for r in out.nodes.orderBy("seq").collect() if r.id not in ids]
    assert made == [i for i in want if i not in ids]


def test_merge_actions_as_one_by_one(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(14)]
    names = ids + [f"m{i}" for i in range(4)]
    edges = [tuple(rng.choices(ids, k=2)) for _ in range(40)]
    rows = []
    for n in range(40):
        # A third of the actions name one id; some ids come back after they were merged away.
        named = rng.choices(names, k=rng.randint(2, 3)) + ["n0"] * (n % 3 == 0)
        unified = rng.choice(named if rng.random() < 0.5 else names)
        rows.append((True, named, unified, f"{unified} of {n}", "", n))
    same_merges(spark, ids, edges, rows)


def test_merge_actions_in_one_chain(spark, monkeypatch):
    monkeypatch.setattr(ranges, "FEW", 0)
    ids = [f"n{i:03}" for i in range(40)]
    ring = list(zip(ids, ids[1:] + ids[:1], strict=True))
    # A chain, then one id that takes another forty, and comes back at the end.
    rows = [(True, [a, b], b, b, "", n - 100) for n, (a, b) in enumerate(ring[:-1])]
    rows += [(True, ["n000", x], "n000", "n000", "", n) for n, x in enumerate(["n039", *(f"x{i}" for i in range(40))])]
    ids += [f"x{i}" for i in range(40)]
    same_merges(spark, ids, ring, [*rows, (True, ["n000", "gone"], "all", "all", "", 300), (True, ["n000", "all"], "n000", "again", "", 301)])


def test_outcomes_of_merge_actions(spark):
    g = make(spark, [node(x) for x in "abcd"], [])
    rows = [(True, ["a", "b"], "a", 1), (True, ["b", "c"], "new", 2), (True, ["a", "a"], "a", 3), (True, ["b", "x"], "y", 4), (True, ["d"], "d", 5), (None, ["c", "d"], "c", 6), (True, ["c", "d"], None, 7), (True, None, "d", 8)]
    actions = spark.createDataFrame([(d, i, u, u, "", s) for d, i, u, s in rows], "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string, seq bigint")
    got = {r.seq: (r.valid_ids, r.outcome, r.reason) for r in graph.merge_outcomes(g, actions).collect()}
    assert got == {
        1: (["a", "b"], "applied", None),
        2: (["c"], "applied", None),
        3: (["a", "a"], "applied", "nothing left to merge"),
        4: ([], "rejected", "no id exists"),
        5: ([], "rejected", "fewer than two ids"),
        6: ([], "rejected", "no duplicates"),
        7: ([], "rejected", "no unified id"),
        8: ([], "rejected", "fewer than two ids"),
    }
    assert graph.merge_outcomes(g, actions.limit(0)).collect() == []


def test_graphml_round_trip(spark, tmp_path):
    g = make(spark, [node('a<&">', "Person", "x & y"), node("b")], [('a<&">', "b", "MENTIONS"), ('a<&">', "b", "MENTIONS")])
    sinks.write_graphml(g.nodes, g.edges, str(tmp_path / "g"))
    nodes, edges = chat.read_graphml(spark, str(tmp_path / "g" / "part-*"))
    assert {(r.id, r.name) for r in nodes.collect()} == {('a<&">', "x & y"), ("b", "b")}
    assert edges.count() == 2


def test_graphml_in_several_documents(spark, tmp_path):
    names = [f"n{i}" for i in range(40)]
    g = make(spark, [node(n) for n in names], [(a, b, "MENTIONS") for a, b in zip(names, names[1:] + names[:1], strict=True)] * 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a graph is one range otherwise
    try:
        sinks.write_graphml(g.nodes, g.edges, str(tmp_path / "g"), single_file=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    nodes, edges = chat.read_graphml(spark, str(tmp_path / "g" / "part-*"))
    assert sorted(r.id for r in nodes.collect()) == sorted(names)
    assert sorted((r.source, r.target) for r in edges.collect()) == sorted((r.source, r.target) for r in g.edges.collect())
    sinks.write_graphml(g.nodes.limit(0), g.edges.limit(0), str(tmp_path / "none"), single_file=False)
    assert not list((tmp_path / "none").glob("part-*")) or spark.read.text(str(tmp_path / "none")).isEmpty()


def test_chat_json_is_permissive(spark, tmp_path):
    lines = [json.dumps({"id": 1, "type": "message", "date": "2024-01-01T00:00:00", "from": "a", "text": ["x", {"text": "y"}]}), "{broken", json.dumps({"id": 2, "type": "service"})]
    (tmp_path / "c.json").write_text("\n".join(lines))
    rows = chat.read_chat_json(spark, str(tmp_path / "c.json"), "s").orderBy("pos").collect()
    assert [(r.id, r.text, r.pos) for r in rows] == [(1, "xy", 0), (2, "", 1)]


def test_sample_windows(spark):
    rows = mining.chat_windows(chat.sample_chats(spark)).collect()
    text = "\n".join(r.window_text for r in rows)
    assert text.count("[2024") == 13 and '[в ответ Галина: "Экран входа рисуем на React?..."]' in text and "[VOTE_FOR:yookassa]" in text


def test_failed_provider_gives_null(spark):
    def broken(step, prompt, data):
        raise OSError

    df = spark.createDataFrame([("p", "d")], "prompt string, data string")
    assert providers.call(df, broken, "x", retry=QUICK).first()["response"] is None


def test_modes_of_mining(spark):
    w = mining.chat_windows(chat.sample_chats(spark))
    a = mining.mine_parallel(w, providers.Rules(), QUICK).collect()
    ordered = w.withColumn("project", F.lit("p")).withColumn("source_seq", F.when(F.col("source") == "chat_backend_team", 0).otherwise(1))
    b = mining.mine_in_order(ordered, providers.Rules(), QUICK).collect()
    key = lambda r: (r.source, r.window_ref)
    assert sorted((key(r), sorted(n.id for n in r.nodes)) for r in a) == sorted((key(r), sorted(n.id for n in r.nodes)) for r in b)
    for r in b:
        ids = {n.id for n in r.nodes}
        assert all(e.source in ids and e.target in ids and e.source != e.target for e in r.edges)


def test_snapshots_of_the_steps(spark, tmp_path):
    unified, _ = pipeline.run(chat.sample_chats(spark), retry=QUICK, snapshots=pipeline.Snapshots(str(tmp_path)))
    names = {"subgraphs", "united_nodes", "united_edges", "merge_actions", "merge_outcomes", "merged_nodes", "merged_edges", "conflicts", "section_facts"}
    assert {p.name for p in tmp_path.iterdir()} == names
    read = lambda name: [json.loads(r.value) for r in spark.read.text(str(tmp_path / name)).collect()]
    assert {n["id"] for n in read("merged_nodes")} <= {n["id"] for n in read("united_nodes")}
    assert {n["id"] for n in read("merged_nodes")} == {r.id for r in unified.nodes.collect()}
    assert len(read("subgraphs")) > 1 and all(g["nodes"] for g in read("subgraphs")) and {"title", "facts"} <= set(read("section_facts")[0])


def test_document_of_the_sample(spark):
    unified, document = pipeline.run(chat.sample_chats(spark), retry=QUICK)
    text = document.first()["markdown"]
    heads = [x for x in text.split("\n") if x.startswith("## ")]
    assert heads == [h for h in ("## GENERAL", "## FUNCTIONAL", "## STACK", "## INTERFACE") if h in heads] and len(heads) >= 3
    assert unified.decisions.count() >= 2 and unified.edges.where("relation = 'RESOLVED_TO'").count() >= 1


def test_outputs_are_written(spark, tmp_path):
    unified, document = pipeline.run(chat.sample_chats(spark), retry=QUICK)
    pipeline.write_outputs(unified, document, str(tmp_path))
    assert spark.read.text(str(tmp_path / "document"), wholetext=True).first()["value"].startswith("# ")
    nodes, edges = chat.read_graphml(spark, str(tmp_path / "graphml" / "part-*"))
    assert nodes.count() == unified.nodes.count() and edges.count() == unified.edges.count()
    assert spark.read.json(str(tmp_path / "nodes")).count() == nodes.count()


def test_resolutions_in_two_phases(spark):
    mined = mining.mine_parallel(mining.chat_windows(chat.sample_chats(spark)), providers.Rules(), QUICK)
    g, found = pipeline.prepare(mined, providers.Rules(), QUICK)
    asked = found.select("id").collect()
    assert {r.id for r in asked} >= {"conflict_payment_gateway"}
    chosen = spark.createDataFrame([("conflict_payment_gateway", "yookassa", None, 0)], "conflict_id string, selected_option_id string, custom_text string, seq bigint")
    unified, _ = pipeline.complete(g, found, chosen, providers.Rules(), QUICK)
    ids = {r.id for r in unified.nodes.collect()}
    assert "yookassa" in ids and "stripe" not in ids


def test_replay_of_recorded_subgraphs(spark):
    """Union and merge keep first definitions and all edges, and record a self-loop."""
    person = lambda i: {"id": i, "label": "Person", "name": i, "description": "", "properties": [], "target_section": "uncategorized"}
    thing = lambda i, n: {"id": i, "label": "Component", "name": n, "description": "", "properties": [], "target_section": "tech_stack"}
    edge = lambda a, b, r="MENTIONS": {"source": a, "target": b, "relation": r, "evidence": ""}
    one_ = {"summary": "", "nodes": [person("ivan"), thing("pg", "PG"), thing("screen", "Screen")], "edges": [edge("ivan", "pg")], "source_ref": "w1"}
    two = {"summary": "", "nodes": [thing("pg", "later"), thing("pg_15", "PG 15"), thing("endpoint", "Endpoint")], "edges": [edge("ivan", "pg"), edge("screen", "endpoint", "DEPENDS_ON")], "source_ref": "w2"}
    g = pipeline.combine(pipeline.subgraph_rows(spark, [one_, two]))
    assert g.nodes.count() == 5 and g.edges.count() == 3
    actions = spark.createDataFrame([(True, ["pg", "pg_15"], "pg", "x", "x", 0), (True, ["endpoint", "screen"], "login", "Login", "both", 1)], "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string, seq bigint")
    out = graph.merge_nodes(g, actions)
    assert {(r.id, r.name) for r in out.nodes.collect()} == {("ivan", "ivan"), ("pg", "PG"), ("login", "Login")}
    assert out.edges.count() == 3 and out.edges.where("merged_loop").count() == 1
