"""Queries on contexts and sinks, and the whole pipeline on the sample chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as text_fn
from quillgraph.operators import conflicts
from quillgraph.plans import q_graph
from quillgraph.plans.registry import query, table
from quillgraph.sources import chat, sinks


@query(f"""WITH {q_graph.NODES}, f AS (SELECT * FROM nodes WHERE label IN ('Component', 'Concept', 'Requirement') ORDER BY seq LIMIT 60)
SELECT id, 'ID: ' || id || ' | ' || name || ' | ' || description AS line FROM f""")
def tech_context_top60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 technical nodes that came first (the limit is the feature)."""
    return conflicts.technical_nodes(q_graph._nodes(spark, sf_dir)).select("id", "line")


@query(f"""WITH {q_graph.NODES}, e AS (SELECT 'nation_' || n_nationkey AS source, 'region_' || n_regionkey AS target, CAST(n_nationkey AS BIGINT) AS seq FROM nation)
SELECT 2 AS part, seq, '<node id="' || id || '"><data key="node_label">' || label || '</data><data key="node_name">' || replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') ||
  '</data><data key="node_section">None</data></node>' AS line FROM nodes
UNION ALL SELECT 3, seq, '<edge source="' || source || '" target="' || target || '" id="0"><data key="edge_relation">RELATES_TO</data></edge>' FROM e
UNION ALL SELECT * FROM (VALUES (0, 0, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
  (1, 0, '<key id="node_label" for="node" attr.name="label" attr.type="string"/>'), (1, 1, '<key id="node_name" for="node" attr.name="name" attr.type="string"/>'),
  (1, 2, '<key id="node_section" for="node" attr.name="section" attr.type="string"/>'), (1, 3, '<key id="edge_relation" for="edge" attr.name="relation" attr.type="string"/>'),
  (1, 4, '<graph edgedefault="directed">'), (4, 0, '</graph>' || chr(10) || '</graphml>')) t(part, seq, line)""")
def graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6."""
    nodes = q_graph._nodes(spark, sf_dir).select("id", "label", "name", F.col("target_section").alias("section"), "seq")
    na = table(spark, sf_dir, "nation")
    edges = na.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("RELATES_TO").alias("relation"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return sinks.graphml_lines(nodes, edges)


@query("""SELECT '{"id":' || s_suppkey || ',"name":"' || s_name || '","section":null,"tags":["' || s_nationkey || '"]}' AS value FROM supplier""")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent values are written as null."""
    s = table(spark, sf_dir, "supplier")
    return sinks.json_lines(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("section"), F.array(F.col("s_nationkey").cast("string")).alias("tags")))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'a' || event_type || 'c' WHEN 2 THEN '' WHEN 3 THEN '' ELSE '[not json' END AS plain FROM events""")
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, lists of strings and objects, objects alone, absent text."""
    k, t = F.col("event_id") % 5, F.col("event_type")
    text = F.when(k == 0, t).when(k == 1, F.concat(F.lit('["a",{"type":"bold","text":"'), t, F.lit('"},"c",{"x":1}]'))).when(k == 2, F.lit('{"text":"x"}')).when(k == 4, F.lit("[not json"))
    return table(spark, sf_dir, "events").select("event_id", text_fn.rich_text(text).alias("plain"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Ask' ELSE 'Ask' || chr(10) || chr(10) || 'DATA:' || chr(10) || event_type END AS prompt,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS parsed FROM events""")
def prompts_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that can't be read are NULL."""
    e = table(spark, sf_dir, "events")
    data = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    iso = F.when(F.col("event_id") % 4 == 0, F.lit("yesterday")).otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return e.select("event_id", text_fn.prompt_with_data(F.lit("Ask"), data).alias("prompt"), text_fn.parse_timestamp(iso).cast("timestamp_ntz").alias("parsed"))


@query("""WITH t AS (SELECT r_regionkey AS a, -1 AS b, '## ' || r_regionkey || ' ' || r_name || chr(10) || chr(10) || 'Region.' AS md FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, '### ' || n_regionkey || '.' || n_nationkey || ' ' || n_name FROM nation)
SELECT string_agg(md, chr(10) || chr(10) ORDER BY a, b) AS markdown FROM t""")
def outline_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested outline, flattened to paths."""
    from quillgraph.operators import sections

    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.array("r_regionkey").alias("path"), F.col("r_regionkey").cast("string").alias("number"), F.col("r_name").alias("title"), F.lit("Region.").alias("content"))
    number = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    below = n.select(F.array("n_regionkey", "n_nationkey").alias("path"), number.alias("number"), F.col("n_name").alias("title"), F.lit("").alias("content"))
    return sections.outline(top.unionByName(below))


@query()
def pipeline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the customers' messages: threads, windows, mining, merging, document, with the rule provider."""
    from quillgraph.plans import pipeline
    from quillgraph.plans.q_chat import customer_messages

    return pipeline.run(customer_messages(spark, sf_dir))[1]
