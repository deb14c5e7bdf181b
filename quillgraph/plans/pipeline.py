"""The pipeline's three entries: mine a source; merge and compile; all of it.

A person's choices split a run in two: ``prepare`` gives the conflicts as a table, and
``complete`` takes the resolutions as a table. No job waits for input.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import providers
from quillgraph.functions.embeddings import hashed_embeddings
from quillgraph.operators import conflicts as conflict_ops
from quillgraph.operators import decisions, sections, similarity
from quillgraph.operators import graph as graph_ops
from quillgraph.operators.ranges import global_number
from quillgraph.plans import mining
from quillgraph.session import cut_lineage
from quillgraph.sources import sinks

ACTIONS = "actions array<struct<is_duplicate:boolean,ids_to_merge:array<string>,unified_id:string,unified_name:string,unified_desc:string>>"


@dataclass(frozen=True)
class UnifiedGraph:
    nodes: DataFrame
    edges: DataFrame
    conflicts: DataFrame
    decisions: DataFrame


@dataclass(frozen=True)
class Snapshots:
    """Where the steps' intermediate tables go as JSON, a folder a table; without a path nowhere."""

    path: str | None = None

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        if self.path is not None:
            sinks.write_json(df, f"{self.path}/{name}")
        return df

    def keep_graph(self, name: str, graph: graph_ops.Graph) -> graph_ops.Graph:
        self.keep(f"{name}_nodes", graph.nodes)
        self.keep(f"{name}_edges", graph.edges)
        return graph


def combine(subgraphs: DataFrame) -> graph_ops.Graph:
    """Union of window subgraphs in order of source, thread and window."""
    ordered = global_number(subgraphs, ["source", "thread_idx", "window_idx"], "seq")
    graph = graph_ops.union_subgraphs(ordered)
    return graph_ops.Graph(cut_lineage(graph.nodes), cut_lineage(graph.edges))


def candidate_actions(graph: graph_ops.Graph, provider: providers.Provider, embed=hashed_embeddings, threshold: float = similarity.DUPLICATE_SIMILARITY, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """Ordered merge actions: similar pairs of a label, their clusters, a provider's verdict."""
    texts = embed(graph_ops.candidate_texts(graph.nodes))
    members, pairs = similarity.similar_classes(texts.select("label", "id", "vec"), threshold)
    clusters = graph_ops.class_clusters(members, pairs)
    full = clusters.join(graph.nodes, clusters["node"] == graph.nodes["id"])
    member = F.struct("seq", "id", "name", "description")
    data = full.groupBy("cluster").agg(F.min("seq").alias("seq"), F.to_json(F.array_sort(F.collect_list(member))).alias("data")).withColumn("prompt", F.lit(""))
    verdicts = providers.parsed(providers.call(data, provider, "cluster", retry=retry), ACTIONS, out="v")
    return verdicts.select("seq", F.posexplode("v.actions").alias("n", "a")).select(F.struct("seq", "n").alias("seq"), "a.*")


def detect_conflicts(graph: graph_ops.Graph, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """Conflicts among the first technical nodes; none if there are no such nodes."""
    context = conflict_ops.technical_context(graph.nodes).where("context <> ''").select(F.lit("").alias("prompt"), F.col("context").alias("data"))
    found = providers.parsed(providers.call(context, provider, "conflicts", retry=retry), f"conflicts array<{schemas.struct(schemas.CONFLICT).simpleString()}>", out="v")
    return found.select(F.posexplode("v.conflicts").alias("seq", "c")).select(F.col("seq").cast("bigint").alias("seq"), "c.*")


def prepare(subgraphs: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry(), snapshots: Snapshots = Snapshots()) -> tuple[graph_ops.Graph, DataFrame]:
    """(merged graph, conflicts) of mined subgraphs."""
    graph = snapshots.keep_graph("united", combine(snapshots.keep("subgraphs", subgraphs)))
    actions = snapshots.keep("merge_actions", candidate_actions(graph, provider, retry=retry))
    merged = graph_ops.merge_nodes(graph, actions)
    if snapshots.path is not None:
        snapshots.keep("merge_outcomes", graph_ops.merge_outcomes(graph, actions))
    merged = snapshots.keep_graph("merged", graph_ops.Graph(cut_lineage(merged.nodes), cut_lineage(merged.edges)))
    return merged, snapshots.keep("conflicts", detect_conflicts(merged, provider, retry))


def assign_sections(nodes: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """A section for each unassigned node, asked in batches of 20; a failed batch stays."""
    numbered = sections.batches(sections.unassigned(nodes))
    row = F.struct("n", "id", "name", "label")
    data = numbered.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("data")).withColumn("prompt", F.lit(""))
    answers = providers.parsed(providers.call(data, provider, "sections", retry=retry), "assignments array<struct<node_id:string,target_section:string>>", out="v")
    rows = answers.select("batch", F.posexplode("v.assignments").alias("n", "a")).select("a.node_id", "a.target_section", F.struct("batch", "n").alias("seq"))
    return sections.assign(nodes, rows)


def finalize(graph: graph_ops.Graph, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> UnifiedGraph:
    """Decisions first, then sections, then validation."""
    outcome = cut_lineage(decisions.resolve_decisions(graph))
    last = graph.edges.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    added = decisions.resolved_edges(outcome).crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + 1 + F.col("seq"))
    edges = graph.edges.unionByName(added.drop("last"), allowMissingColumns=True)
    valid, _ = graph_ops.finalize(graph_ops.Graph(assign_sections(graph.nodes, provider, retry), edges))
    # Ties are what the finished graph leaves to be settled.
    open_ = outcome.where("is_tie").select(F.col("decision_id").alias("id"), F.col("decision_id").alias("node_id"), F.transform("options", lambda o: o["option_name"]).alias("conflicting_values"), F.col("conflict_description").alias("description"))
    return UnifiedGraph(cut_lineage(valid.nodes), cut_lineage(valid.edges), open_, outcome)


def compile_sections(nodes: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry(), snapshots: Snapshots = Snapshots()) -> DataFrame:
    """(ord, title, section_id, content_markdown); a section whose call fails is left out."""
    facts = snapshots.keep("section_facts", sections.section_facts(nodes)).withColumn("prompt", F.col("section_id"))
    return providers.call(facts, provider, "section", data="facts", out="content_markdown", retry=retry).where("content_markdown is not null").select("ord", "title", "section_id", "content_markdown")


def complete(graph: graph_ops.Graph, conflicts: DataFrame, resolutions: DataFrame | None, provider: providers.Provider, retry: providers.Retry = providers.Retry(), snapshots: Snapshots = Snapshots()) -> tuple[UnifiedGraph, DataFrame]:
    """(unified graph, document as one Markdown row) after a person's choices."""
    chosen = graph if resolutions is None else conflict_ops.apply_resolutions(graph, conflicts, resolutions)
    unified = finalize(chosen, provider, retry)
    return unified, sections.compile_document(compile_sections(unified.nodes, provider, retry, snapshots))


def run(messages: DataFrame, provider: providers.Provider | None = None, resolutions: DataFrame | None = None, retry: providers.Retry = providers.Retry(), snapshots: Snapshots = Snapshots()) -> tuple[UnifiedGraph, DataFrame]:
    """Messages to document, with windows mined independently; ``snapshots`` says where the steps' tables go."""
    provider = provider or providers.Rules()
    subgraphs = mining.mine_parallel(mining.chat_windows(messages), provider, retry)
    graph, found = prepare(subgraphs, provider, retry, snapshots)
    return complete(graph, found, resolutions, provider, retry, snapshots)


def subgraph_rows(spark, subgraphs: list[dict]) -> DataFrame:
    """Recorded subgraphs (dicts with nodes, edges, source_ref) as mined rows."""
    lines = [(json.dumps(g, ensure_ascii=False), i) for i, g in enumerate(subgraphs)]
    raw = spark.createDataFrame(lines, "g string, i bigint").select(F.from_json("g", schemas.SUBGRAPH).alias("g"), "i")
    return raw.select(F.lit("replay").alias("source"), F.col("g.source_ref").alias("window_ref"), F.lit(0).cast("bigint").alias("thread_idx"), F.col("i").alias("window_idx"), "g.nodes", "g.edges")


def write_outputs(unified: UnifiedGraph, document: DataFrame, path: str) -> None:
    """The document, the report, the graph as JSON and GraphML, each in its own folder."""
    sinks.write_single_text(document, "markdown", f"{path}/document")
    sinks.write_single_text(decisions.merge_report(unified.decisions), "report", f"{path}/report")
    for name in ("nodes", "edges", "conflicts", "decisions"):
        sinks.write_json(getattr(unified, name), f"{path}/{name}")
    columns = ["id", "label", "name", "description", "properties", "target_section", "seq"]
    sinks.write_graphml(unified.nodes.select(*[c for c in columns if c in unified.nodes.columns]), unified.edges.select("source", "target", "relation", "evidence", "seq"), f"{path}/graphml")
