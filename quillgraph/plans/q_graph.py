"""Queries on the property graph of the star schema: union, integrity, fixes, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as text_fn
from quillgraph.operators import graph as g
from quillgraph.operators import sections
from quillgraph.plans.registry import query, table
from quillgraph.session import cut_lineage


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}_"), F.col(column).cast("string"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts, nations and regions as nodes in one order."""
    kinds = [
        ("region", "r_regionkey", "r_name", F.lit("Concept"), F.lit("").alias("d"), 0),
        ("nation", "n_nationkey", "n_name", F.lit("Person"), F.lit("").alias("d"), 1),
        ("supplier", "s_suppkey", "s_name", F.lit("Component"), F.lit("").alias("d"), 2),
        ("part", "p_partkey", "p_name", F.when(F.col("p_size") % 3 == 0, F.lit("Requirement")).when(F.col("p_size") % 3 == 1, F.lit("Task")).otherwise(F.lit("Concept")), F.col("p_type"), 3),
    ]
    out = None
    for name, key, title, label, description, rank in kinds:
        t = table(spark, sf_dir, name).select(
            _id(name, key).alias("id"),
            label.alias("label"),
            F.col(title).alias("name"),
            description.alias("description"),
            F.lit(None).cast("string").alias("target_section"),
            (F.lit(rank).cast("bigint") * 1_000_000_000_000 + F.col(key)).alias("seq"),
        )
        out = t if out is None else out.unionByName(t)
    return out


NODES = """nodes AS (
  SELECT 'region_' || r_regionkey AS id, 'Concept' AS label, r_name AS name, '' AS description, CAST(r_regionkey AS BIGINT) AS seq FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'Person', n_name, '', 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'Component', s_name, '', 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'part_' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'Requirement' WHEN 1 THEN 'Task' ELSE 'Concept' END, p_name, p_type, 3000000000000 + p_partkey FROM part)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part (every line item) and nation to region, parallel edges included."""
    li = table(spark, sf_dir, "lineitem").select(
        _id("supplier", "l_suppkey").alias("source"), _id("part", "l_partkey").alias("target"), F.lit("MENTIONS").alias("relation"), F.col("l_returnflag").alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    na = table(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("source"), _id("region", "n_regionkey").alias("target"), F.lit("RELATES_TO").alias("relation"), F.lit("").alias("evidence"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return li.unionByName(na)


EDGES = """edges AS (
  SELECT 'supplier_' || l_suppkey AS source, 'part_' || l_partkey AS target, 'MENTIONS' AS relation, l_returnflag AS evidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
  UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'RELATES_TO', '', CAST(n_nationkey AS BIGINT) FROM nation)"""


def _graph(spark: SparkSession, sf_dir: str) -> g.Graph:
    return g.Graph(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query("""WITH n AS (SELECT 'part_' || l_partkey AS id, 'order ' || l_orderkey AS name, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT id, name, l_orderkey AS g, l_linenumber AS pos FROM n WHERE k = 1""")
def keep_first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, J17, A12."""
    li = table(spark, sf_dir, "lineitem")
    nodes = li.select(_id("part", "l_partkey").alias("id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("pos"))
    return g.keep_first(nodes, ("g", "pos"))


@query(f"WITH {EDGES} SELECT source, relation, count(*) AS n_edges, count(DISTINCT target) AS n_targets FROM edges GROUP BY source, relation")
def edge_bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges stay; one subgraph an order, one a region."""
    return _united(spark, sf_dir).edges.groupBy("source", "relation").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("target").alias("n_targets"))


def _united(spark: SparkSession, sf_dir: str) -> g.Graph:
    """The union of a subgraph an order (its parts and their sources) and one a region."""
    rows = _edges(spark, sf_dir).withColumn("g", F.when(F.col("relation") == "MENTIONS", F.expr("seq div 10")).otherwise(-1))
    # Gathered once, as one list, which is written: nodes, edges and their widths are read from it.
    lines = F.sort_array(F.collect_list(F.struct("seq", "target", "source", "relation", "evidence")))
    held = cut_lineage(rows.groupBy("g").agg(lines.alias("lines")))
    name = F.concat(F.lit("order "), F.col("g").cast("string"))
    nodes = F.transform("lines", lambda x: F.struct(x["target"].alias("id"), F.lit("Concept").alias("label"), name.alias("name")))
    edges = F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ("source", "target", "relation", "evidence")]))
    return g.union_subgraphs(held.select(F.col("g").alias("seq"), nodes.alias("nodes"), edges.alias("edges")))


@query("""WITH n AS (SELECT 'part_' || l_partkey AS id, 'order ' || l_orderkey AS name, l_orderkey AS g,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT id, 'Concept' AS label, name, dense_rank() OVER (ORDER BY g) AS nth FROM n WHERE k = 1
UNION ALL SELECT DISTINCT 'region_' || n_regionkey, 'Concept', 'order -1', CAST(0 AS BIGINT) FROM nation""")
def union_first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal ids the first subgraph's node stands, in the subgraphs' order."""
    nodes = cut_lineage(_united(spark, sf_dir).nodes)
    orders = nodes.select("name").distinct().where("name <> 'order -1'")
    nth = g.global_number(orders.withColumn("k", F.substring("name", 7, 20).cast("bigint")), ["k"], "nth").select("name", (F.col("nth") + 1).alias("nth"))
    return nodes.join(nth, "name", "left").select("id", "label", "name", F.coalesce("nth", F.lit(0).cast("bigint")).alias("nth"))


@query("SELECT 'customer_' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def ghost_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes known to the glossary (customers with orders)."""
    nodes = table(spark, sf_dir, "customer").select(_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return g.ghost_filter(nodes, table(spark, sf_dir, "orders").select(_id("customer", "o_custkey").alias("id")))


@query("""WITH n AS (SELECT DISTINCT l_returnflag AS w, l_partkey AS id FROM lineitem WHERE l_quantity > 25),
e AS (SELECT l_returnflag AS w, l_partkey AS s, l_partkey % 500 AS t, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT w AS window_ref, s AS source, t AS target, seq FROM e WHERE s <> t
  AND EXISTS (SELECT 1 FROM n WHERE n.w = e.w AND n.id = e.s) AND EXISTS (SELECT 1 FROM n WHERE n.w = e.w AND n.id = e.t)""")
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends among the window's own nodes, no self-loop."""
    li = table(spark, sf_dir, "lineitem")
    nodes = li.where("l_quantity > 25").select(F.col("l_returnflag").alias("window_ref"), F.col("l_partkey").alias("id"))
    edges = li.select(F.col("l_returnflag").alias("window_ref"), F.col("l_partkey").alias("source"), (F.col("l_partkey") % 500).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return g.edge_integrity(edges, nodes, ["window_ref"]).select("window_ref", "source", "target", "seq")


@query(f"""WITH {NODES}, {EDGES}, x AS (SELECT 'part_' || p_partkey AS id FROM part WHERE p_size < 25)
SELECT source, target, relation, seq FROM edges WHERE source NOT IN (SELECT id FROM x) AND target NOT IN (SELECT id FROM x)""")
def fix_remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes go with their edges."""
    fixes = table(spark, sf_dir, "part").where("p_size < 25").select(F.lit("remove_node").alias("action"), _id("part", "p_partkey").alias("node_id"), F.lit(None).cast("string").alias("edge_source"), F.lit(None).cast("string").alias("edge_target"))
    return g.apply_fixes(_graph(spark, sf_dir), fixes).edges.select("source", "target", "relation", "seq")


@query(f"""WITH {EDGES}, x AS (SELECT DISTINCT 'supplier_' || l_suppkey AS source, 'part_' || l_partkey AS target FROM lineitem WHERE l_quantity > 40)
SELECT source, target, relation, seq FROM edges WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source = edges.source AND x.target = edges.target)""")
def fix_remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all parallel edges of a pair go; actions without effect are passed over."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    fixes = li.select(F.lit("remove_edge").alias("action"), F.lit(None).cast("string").alias("node_id"), _id("supplier", "l_suppkey").alias("edge_source"), _id("part", "l_partkey").alias("edge_target"))
    idle = fixes.limit(1).withColumn("action", F.lit("add_node"))
    return g.apply_fixes(_graph(spark, sf_dir), fixes.unionByName(idle)).edges.select("source", "target", "relation", "seq")


def _supplier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    return s.withColumn("f", first).where("f <> s_suppkey").select(_id("supplier", "s_suppkey").alias("id"), _id("supplier", "f").alias("final"))


SUPPLIER_MAP = """x AS (SELECT 'supplier_' || s_suppkey AS id, 'supplier_' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS final FROM supplier)"""


@query(f"WITH {EDGES}, {SUPPLIER_MAP} SELECT coalesce(x.final, source) AS source, target, relation, seq FROM edges LEFT JOIN x ON x.id = source")
def merge_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints follow the id map; the bag of edges keeps its size."""
    return g.relabel(_edges(spark, sf_dir), _supplier_map(spark, sf_dir)).select("source", "target", "relation", "seq")


@query("""WITH a AS (SELECT 'part_' || l_partkey AS s, 'part_' || (l_suppkey + 1) AS t, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
x AS (SELECT 'part_' || p_partkey AS id, 'part_' || (p_partkey % 50) AS f FROM part WHERE p_partkey >= 50),
m AS (SELECT coalesce(x.f, s) AS source, coalesce(y.f, t) AS target, seq FROM a LEFT JOIN x ON x.id = s LEFT JOIN x y ON y.id = t)
SELECT source, count(*) AS n_edges, CAST(count(*) FILTER (WHERE source = target) AS BIGINT) AS n_loops FROM m GROUP BY source""")
def merge_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: merging makes self-loops; they stay and are flagged."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(_id("part", "l_partkey").alias("source"), F.concat(F.lit("part_"), (F.col("l_suppkey") + 1).cast("string")).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    idmap = table(spark, sf_dir, "part").where("p_partkey >= 50").select(_id("part", "p_partkey").alias("id"), F.concat(F.lit("part_"), (F.col("p_partkey") % 50).cast("string")).alias("final"))
    return g.relabel(edges, idmap).groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("merged_loop").alias("n_loops"))


@query(f"""WITH {NODES}, x AS (SELECT * FROM (VALUES ('part_4', 'part_2'), ('part_6', 'part_2'), ('supplier_1', 'all suppliers'), ('supplier_2', 'all suppliers')) t(id, final)),
k AS (SELECT id, label, name FROM nodes WHERE id NOT IN (SELECT id FROM x))
SELECT * FROM k UNION ALL SELECT 'all suppliers', label, 'All suppliers' FROM nodes WHERE id = 'supplier_1'""")
def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing id keeps its attributes, a new one takes those given; later
    actions see what earlier ones did and actions of a single id are passed over."""
    rows = [
        (True, ["part_4", "part_2"], "part_2", "ignored", "ignored", 1),
        (True, ["part_4", "part_6", "part_2"], "part_2", "ignored", "ignored", 2),
        (True, ["supplier_1", "supplier_2"], "all suppliers", "All suppliers", "merged", 3),
        (True, ["part_8"], "part_9", "x", "x", 4),
        (False, ["part_8", "part_10"], "part_8", "x", "x", 5),
        (True, ["no such id", "nor this"], "nothing", "x", "x", 6),
    ]
    actions = spark.createDataFrame(rows, "is_duplicate boolean, ids_to_merge array<string>, unified_id string, unified_name string, unified_desc string, seq bigint")
    return g.merge_nodes(_graph(spark, sf_dir), actions).nodes.select("id", "label", "name")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS j, p_partkey + 1 IN (SELECT p_partkey FROM part) AS has_next, p_partkey - 1 IN (SELECT p_partkey FROM part) AS has_last FROM part),
v AS (SELECT k, j, list_filter([CASE WHEN j = 0 OR j = 1 AND NOT has_last THEN 'part_' || k END, CASE WHEN j < 2 AND has_next THEN 'part_' || (k + 1) END], lambda x: x IS NOT NULL) AS ids FROM p)
SELECT CAST(k AS BIGINT) AS seq, CASE WHEN j = 1 THEN 'merged_' || (k // 4) ELSE 'part_' || k END AS unified_id, array_to_string(ids, ', ') AS valid_ids,
  CASE WHEN len(ids) > 0 THEN 'applied' ELSE 'rejected' END AS outcome,
  CASE WHEN j = 3 THEN 'no duplicates' WHEN len(ids) = 0 THEN 'no id exists' WHEN j = 0 AND len(ids) = 1 THEN 'nothing left to merge' END AS reason FROM v""")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each action; of four parts the first takes the second, whose own action finds only the
    third left, the third's finds nobody, and the fourth's is about no duplicates."""
    k, name = F.col("p_partkey").cast("bigint"), lambda x: F.concat(F.lit("part_"), x.cast("string"))
    actions = table(spark, sf_dir, "part").select(
        (k % 4 != 3).alias("is_duplicate"),
        F.when(k % 4 == 2, F.array(name(k), name(k - 1))).otherwise(F.array(name(k), name(k + 1))).alias("ids_to_merge"),
        F.when(k % 4 == 1, F.concat(F.lit("merged_"), F.expr("p_partkey div 4").cast("string"))).otherwise(name(k)).alias("unified_id"),
        F.lit("merged").alias("unified_name"),
        F.lit("").alias("unified_desc"),
        k.alias("seq"),
    )
    return g.merge_outcomes(_graph(spark, sf_dir), actions).withColumn("valid_ids", F.array_join("valid_ids", ", "))


@query("""WITH e AS (SELECT replace(replace(lower(p_brand || ' ' || (p_size % 7)), ' ', '_'), '-', '_') AS id, p_name, p_partkey FROM part)
SELECT id, arg_max(p_name, p_partkey) AS description, min(p_partkey) AS seq FROM e GROUP BY id""")
def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of a slug at the place of its first."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat_ws(" ", "p_brand", (F.col("p_size") % 7).cast("string")).alias("name"), F.lit("Concept").alias("label"), F.col("p_name").alias("description"), F.col("p_partkey").alias("seq"))
    return g.upsert_glossary(rows).select("id", "description", "seq")


@query("""WITH g AS (SELECT DISTINCT replace(replace(lower(n_name), ' ', '_'), '-', '_') AS id FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
SELECT c_custkey, replace(replace(lower(n_name), ' ', '_'), '-', '_') AS id, replace(replace(lower(n_name), ' ', '_'), '-', '_') IN (SELECT id FROM g) AS is_duplicate
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, L2 offline: each customer names a nation; the glossary knows rich suppliers' nations."""
    nation = table(spark, sf_dir, "nation")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    glossary = rich.select(text_fn.slug(F.col("n_name")).alias("id"))
    entities = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.upper("n_name").alias("name"))
    return g.link_entities(entities, glossary).select("c_custkey", "id", "is_duplicate")


@query("SELECT p_brand, string_agg('- ' || p_partkey || ' (Concept): ' || p_name, chr(10) ORDER BY p_partkey) AS glossary FROM part GROUP BY p_brand")
def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14, A16."""
    p = table(spark, sf_dir, "part")
    line = text_fn.glossary_line(F.col("p_partkey").cast("string"), F.lit("Concept"), F.col("p_name"))
    return p.groupBy("p_brand").agg(g.ordered_lines(line, F.col("p_partkey")).alias("glossary"))


@query("""SELECT p_partkey AS id, p_brand AS label, regexp_replace(p_name || ' ' || p_type, '^\\s+|\\s+$', '', 'g') AS embed_text FROM part WHERE p_brand <> 'Decision'""")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, T17."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return g.candidate_texts(p).select("id", "label", "embed_text")


@query(f"""WITH {NODES}, b AS (SELECT id, name, seq, row_number() OVER (ORDER BY seq) - 1 AS n FROM nodes WHERE label <> 'Person')
SELECT n // 20 AS batch, count(*) AS n_nodes, string_agg('ID:' || id || ' | ' || name, chr(10) ORDER BY n) AS context FROM b GROUP BY n // 20""")
def unassigned_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, W7, T15."""
    return sections.batch_prompts(_nodes(spark, sf_dir))


SECTIONED = f"""{NODES}, a AS (
  SELECT 'part_' || l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'functional_req' WHEN 'A' THEN 'tech_stack' ELSE 'ui_ux' END AS section, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
  UNION ALL SELECT 'supplier_' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'general_info' ELSE 'no such section' END, s_suppkey FROM supplier),
l AS (SELECT id, arg_max(section, seq) AS section FROM a GROUP BY id),
s AS (SELECT n.*, l.section FROM nodes n LEFT JOIN l USING (id))"""


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, su = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    section = F.when(F.col("l_returnflag") == "R", F.lit("functional_req")).when(F.col("l_returnflag") == "A", F.lit("tech_stack")).otherwise(F.lit("ui_ux"))
    a = li.select(_id("part", "l_partkey").alias("node_id"), section.alias("target_section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    odd = F.when(F.col("s_suppkey") % 2 == 0, F.lit("general_info")).otherwise(F.lit("no such section"))
    b = su.select(_id("supplier", "s_suppkey").alias("node_id"), odd.alias("target_section"), F.col("s_suppkey").alias("seq"))
    return sections.assign(_nodes(spark, sf_dir), a.unionByName(b))


@query(f"WITH {SECTIONED} SELECT id, section AS target_section FROM s")
def assign_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last assignment stands."""
    return _sectioned(spark, sf_dir).select("id", "target_section")


@query(f"""WITH {SECTIONED} SELECT id, label, CASE WHEN section IN ('general_info', 'tech_stack', 'functional_req', 'ui_ux', 'uncategorized') THEN section ELSE 'uncategorized' END AS target_section
FROM s WHERE id <> 'part_3'""")
def finalize_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records that don't hold go, unknown sections become uncategorized."""
    nodes = _sectioned(spark, sf_dir).withColumn("label", F.when(F.col("id") == "part_3", F.lit("Nonsense")).otherwise(F.col("label")))
    valid, _ = g.finalize(g.Graph(nodes, _edges(spark, sf_dir)))
    return valid.nodes.select("id", "label", "target_section")


@query(f"WITH {SECTIONED} SELECT coalesce(section, 'uncategorized') AS target_section, count(*) AS n_nodes FROM s GROUP BY 1")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return sections.section_counts(_sectioned(spark, sf_dir))


FACTS = f"""{SECTIONED}, dim AS (SELECT * FROM (VALUES (0, 'GENERAL', 'general_info'), (1, 'FUNCTIONAL', 'functional_req'), (2, 'STACK', 'tech_stack'), (3, 'INTERFACE', 'ui_ux')) t(ord, title, section_id)),
f AS (SELECT dim.ord, dim.title, dim.section_id, count(*) AS n_nodes, string_agg('- ' || name || ' (ID: ' || id || '): ' || coalesce(description, ''), chr(10) ORDER BY seq) AS facts
  FROM s JOIN dim ON s.section = dim.section_id GROUP BY ALL)"""


@query(f"WITH {FACTS} SELECT title, section_id, n_nodes, facts FROM f")
def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18, T16, O6."""
    return sections.section_facts(_sectioned(spark, sf_dir)).select("title", "section_id", "n_nodes", "facts")


@query(f"""WITH {FACTS} SELECT '# Project' || chr(10) || '**Version:** 1.0.0' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg('## ' || title || chr(10) || chr(10) || facts || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY ord) AS markdown FROM f""")
def compile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, O6, F19, L9 by bullets."""
    facts = sections.section_facts(_sectioned(spark, sf_dir)).withColumnRenamed("facts", "content_markdown")
    return sections.compile_document(facts, "Project", "1.0.0", "Version")
