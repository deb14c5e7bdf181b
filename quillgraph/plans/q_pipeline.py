"""Queries on the pipeline's steps that ask a provider, over tables and with the rule provider."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.providers import Retry, Rules
from quillgraph.operators import graph as g
from quillgraph.plans import mining, pipeline, q_decisions, q_graph
from quillgraph.plans.registry import query, table


@query("""WITH p AS (SELECT 'part_' || p_partkey AS id, p_brand, p_name, first_value('part_' || p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY length('part_' || p_partkey), p_partkey) AS stays FROM part),
e AS (SELECT stays, count(*) AS n FROM lineitem JOIN p ON id = 'part_' || l_partkey GROUP BY stays)
SELECT id, p_brand AS label, p_name AS name, coalesce(n, 0) AS n_edges FROM p LEFT JOIN e USING (stays) WHERE id = stays""")
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and a size are duplicates; a cluster's verdict merges them and their edges."""

    def one_hot(texts: DataFrame) -> DataFrame:
        return texts.withColumn("vec", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: (i == F.col("description").cast("int")).cast("double")))

    part = table(spark, sf_dir, "part")
    nodes = part.select(q_graph._id("part", "p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("description"), F.col("p_partkey").cast("bigint").alias("seq"))
    graph = g.Graph(nodes, q_graph._edges(spark, sf_dir).where("relation = 'MENTIONS'"))
    merged = g.merge_nodes(graph, pipeline.candidate_actions(graph, Rules(), embed=one_hot))
    counts = merged.edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return merged.nodes.join(counts, "id", "left").select("id", "label", "name", F.coalesce("n_edges", F.lit(0).cast("bigint")).alias("n_edges"))


#: Roles and what excludes each other in them; one role has a single known member, one an unknown one.
ROLES = {
    "home region": ("region_1", "region_3", "region_99"),
    "lone region": ("region_2", "no_such_node"),
    "main supplier": ("supplier_5", "supplier_2", "supplier_4"),
}
_MEMBERS = ", ".join(f"({n}, '{role}', {i}, '{m}')" for n, (role, members) in enumerate(ROLES.items()) for i, m in enumerate(members))


@query(f"""WITH {q_graph.NODES}, f AS (SELECT * FROM nodes WHERE label IN ('Component', 'Concept', 'Requirement') ORDER BY seq LIMIT 60),
r AS (SELECT * FROM (VALUES {_MEMBERS}) t(n, role, i, id)),
c AS (SELECT n, role, string_agg(f.name, ', ' ORDER BY i) AS names, string_agg(f.id, ', ' ORDER BY i) AS ids, arg_min(f.name, i) AS best FROM r JOIN f ON r.id = f.id GROUP BY n, role HAVING count(*) > 1)
SELECT row_number() OVER (ORDER BY n) - 1 AS seq, 'conflict_' || replace(role, ' ', '_') AS id, role AS category, role || ': ' || names AS description, ids AS option_ids, names AS option_texts, best AS ai_recommendation FROM c""")
def detected_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What excludes each other among the first technical nodes (the limit is the feature)."""
    found = pipeline.detect_conflicts(q_graph._graph(spark, sf_dir), Rules(roles=ROLES))
    part = lambda name: F.array_join(F.transform("options", lambda o: o[name]), ", ")
    return found.select("seq", "id", "category", "description", part("id").alias("option_ids"), part("text").alias("option_texts"), "ai_recommendation")


@query(f"""WITH {q_graph.NODES}, t AS (SELECT *, lower(id || ' ' || name) AS words FROM nodes)
SELECT id, CASE WHEN label = 'Person' THEN NULL WHEN contains(words, 'screen') OR contains(words, 'form') OR contains(words, 'button') OR contains(words, 'ui') THEN 'ui_ux'
  WHEN label = 'Requirement' THEN 'functional_req' WHEN label IN ('Component', 'Decision') THEN 'tech_stack' ELSE 'general_info' END AS target_section FROM t""")
def asked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections asked in batches of 20; persons aren't asked about."""
    return pipeline.assign_sections(q_graph._nodes(spark, sf_dir), Rules()).select("id", "target_section")


@query(f"""WITH {q_decisions.TALLY} SELECT 'decision_' || k AS id, 'Decision' AS label, 'tech_stack' AS target_section FROM ds WHERE k IS NOT NULL
UNION ALL SELECT DISTINCT option_id, 'Component', 'tech_stack' FROM e WHERE k IS NOT NULL
UNION ALL SELECT 'user_' || user_id, 'Person', 'uncategorized' FROM us WHERE user_id % 10 <> 0""")
def finalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the finished graph; those without a name go."""
    return pipeline.finalize(q_decisions.vote_graph(spark, sf_dir), Rules()).nodes.select("id", "label", "target_section")


@query(f"""WITH {q_decisions.TALLY}, x AS (SELECT 'decision_' || k AS source, option_id AS target, 'RELATES_TO' AS relation, '' AS evidence FROM e WHERE event_type = 'view'
UNION ALL SELECT 'user_' || user_id, option_id, CASE event_type WHEN 'purchase' THEN 'VOTED_FOR' ELSE 'VOTED_AGAINST' END, '' FROM e WHERE event_type IN ('purchase', 'error')
UNION ALL SELECT 'decision_' || k, option_id, 'RESOLVED_TO', 'Победитель голосования: ' || votes_for || ' за, ' || votes_against || ' против' FROM res WHERE NOT is_tie)
SELECT source, target, relation, evidence, count(*) AS n_edges FROM x GROUP BY ALL""")
def finalized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the finished graph, the outcomes of its decisions among them."""
    edges = pipeline.finalize(q_decisions.vote_graph(spark, sf_dir), Rules()).edges
    return edges.groupBy("source", "target", "relation", "evidence").agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"""WITH {q_decisions.TALLY} SELECT 'decision_' || res.k AS id, string_agg(rk.option_id, ', ' ORDER BY rk.first_seq) AS option_names,
  CASE WHEN any_value(res.most) = 0 THEN 'Голосов не обнаружено. Решение не принято.' ELSE 'Ничья между: ' || any_value(res.tied) || ' (счёт ' || any_value(res.top) || '). Требуется ручное решение.' END AS description
FROM res JOIN rk ON rk.k = res.k WHERE res.is_tie GROUP BY res.k""")
def finalized_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that the finished graph leaves open."""
    found = pipeline.finalize(q_decisions.vote_graph(spark, sf_dir), Rules()).conflicts
    return found.select("id", F.array_join("conflicting_values", ", ").alias("option_names"), "description")


class Editor(Rules):
    """Rules that put a heading before a section's facts and fail on one section."""

    def __call__(self, step: str, prompt: str, data: str) -> str:
        if step == "section" and prompt == "ui_ux":
            raise ConnectionError("no answer")
        return f"### {prompt}\n{super().__call__(step, prompt, data)}"


@query(f"""WITH {q_graph.FACTS} SELECT ord, title, section_id, '### ' || section_id || chr(10) || facts AS content_markdown FROM f WHERE section_id <> 'ui_ux'""")
def compiled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's text as a provider writes it from its facts; a section whose call fails is left out."""
    return pipeline.compile_sections(q_graph._sectioned(spark, sf_dir), Editor(), Retry(attempts=2, first_delay=0.0))


class Strict(Rules):
    """Rules whose critique takes out one component and what the second clerk says of another."""

    def do_critique(self, data: str) -> str:
        fixes = [{"action": "remove_node", "node_id": n["id"]} for n in json.loads(data)["nodes"] if n["id"] == "redis"]
        return json.dumps({"fixes": [*fixes, {"action": "remove_edge", "edge_source": "clerk_1", "edge_target": "mysql"}]})


_SAID = ("we store it in PostgreSQL", "MySQL and Redis, please", "nothing to add")


def _customer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window a customer, a line an order."""
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("["), F.col("o_orderdate").cast("date").cast("string"), F.lit("] Clerk "), (F.col("o_orderkey") % 4).cast("string"), F.lit(": "), said)
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(g.ordered_lines(line, F.col("o_orderkey")).alias("window_text"))
    customer = F.concat(F.lit("customer_"), F.col("o_custkey").cast("string"))
    return orders.select(F.lit("orders").alias("source"), F.col("o_custkey").cast("bigint").alias("thread_idx"), F.lit(0).cast("bigint").alias("window_idx"), customer.alias("window_ref"), "window_text")


MINED = """l AS (SELECT 'customer_' || o_custkey AS window_ref, 'clerk_' || (o_orderkey % 4) AS who, o_orderkey % 3 AS k FROM orders),
w AS (SELECT window_ref, who, id FROM l JOIN (VALUES (0, 'postgresql'), (1, 'mysql')) t(k, id) USING (k)),
d AS (SELECT DISTINCT window_ref, 'decision_primary_database' AS who, id FROM w),
n AS (SELECT window_ref, who AS id FROM l UNION SELECT window_ref, id FROM w UNION SELECT window_ref, who FROM d),
e AS (SELECT window_ref, who || ' MENTIONS ' || id AS edge FROM w WHERE NOT (who = 'clerk_1' AND id = 'mysql') UNION ALL SELECT window_ref, who || ' RELATES_TO ' || id FROM d)"""


@query(f"""WITH {MINED} SELECT window_ref, any_value(nodes) AS nodes, coalesce(string_agg(edge, ', ' ORDER BY edge), '') AS edges
FROM (SELECT window_ref, string_agg(id, ', ' ORDER BY id) AS nodes FROM n GROUP BY window_ref) LEFT JOIN e USING (window_ref) GROUP BY window_ref""")
def mined_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3, L4: a graph a window, with the critique's fixes applied."""
    mined = mining.mine_parallel(_customer_windows(spark, sf_dir), Strict())
    edge = F.transform("edges", lambda e: F.concat_ws(" ", e["source"], e["relation"], e["target"]))
    return mined.select("window_ref", F.array_join(F.array_sort(F.transform("nodes", lambda n: n["id"])), ", ").alias("nodes"), F.array_join(F.array_sort(edge), ", ").alias("edges"))


@query(f"""WITH {MINED} SELECT 'node' AS kind, id AS what, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT id FROM n) UNION ALL SELECT 'edge', edge, count(*) FROM e GROUP BY edge""")
def mined_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows' graphs as one; nodes meet by their slugs, edges are a bag."""
    graph = pipeline.combine(mining.mine_parallel(_customer_windows(spark, sf_dir), Strict()))
    what = F.concat_ws(" ", "source", "relation", "target")
    edges = graph.edges.groupBy(F.lit("edge").alias("kind"), what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("id").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges)


class OneSpeaker(Strict):
    """Strict rules that learn entities from the first clerk's lines alone."""

    def __call__(self, step: str, prompt: str, data: str) -> str:
        if step == "entities":
            data = "\n".join(line for line in data.split("\n") if "] Clerk 0: " in line)
        return super().__call__(step, prompt, data)


@query(f"""WITH {MINED}, s AS (
  SELECT project, id, min(c) AS since FROM (SELECT o_custkey % 10 AS project, o_custkey AS c, 'clerk_0' AS id FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_custkey % 10, o_custkey, id FROM orders JOIN (VALUES (0, 'postgresql'), (1, 'mysql')) t(k, id) ON o_orderkey % 3 = k WHERE o_orderkey % 4 = 0) GROUP BY project, id
  UNION ALL SELECT p, 'decision_primary_database', 0 FROM range(10) t(p)),
c AS (SELECT DISTINCT o_custkey AS c, o_custkey % 10 AS project, 'customer_' || o_custkey AS window_ref FROM orders),
k AS (SELECT n.window_ref, n.id FROM n JOIN c USING (window_ref) JOIN s ON s.project = c.project AND s.id = n.id AND s.since <= c.c),
ke AS (SELECT e.window_ref, edge FROM e WHERE EXISTS (SELECT 1 FROM k WHERE k.window_ref = e.window_ref AND k.id = split_part(edge, ' ', 1))
  AND EXISTS (SELECT 1 FROM k WHERE k.window_ref = e.window_ref AND k.id = split_part(edge, ' ', 3)))
SELECT c.window_ref, coalesce((SELECT string_agg(id, ', ' ORDER BY id) FROM k WHERE k.window_ref = c.window_ref), '') AS nodes,
  coalesce((SELECT string_agg(edge, ', ' ORDER BY edge) FROM ke WHERE ke.window_ref = c.window_ref), '') AS edges FROM c""")
def mined_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a project in order; a node stays if an entity found so far is of its name."""
    windows = _customer_windows(spark, sf_dir).withColumn("project", F.col("thread_idx") % 10).withColumn("source_seq", F.lit(0))
    mined = mining.mine_in_order(windows, OneSpeaker())
    edge = F.transform("edges", lambda e: F.concat_ws(" ", e["source"], e["relation"], e["target"]))
    return mined.select("window_ref", F.array_join(F.array_sort(F.transform("nodes", lambda n: n["id"])), ", ").alias("nodes"), F.array_join(F.array_sort(edge), ", ").alias("edges"))


@query("""WITH l AS (SELECT 'customer_' || o_custkey AS window_ref, o_orderkey % 4 AS who, o_orderkey % 3 AS k FROM orders)
SELECT DISTINCT window_ref, 'Clerk ' || who AS name, 'Person' AS label FROM l
UNION SELECT window_ref, name, 'Component' FROM l JOIN (VALUES (0, 'PostgreSQL'), (1, 'MySQL'), (1, 'Redis')) t(k, name) USING (k)""")
def window_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: entities that a provider finds in each window."""
    return mining.entity_rows(_customer_windows(spark, sf_dir), Rules()).select("window_ref", "name", "label")
