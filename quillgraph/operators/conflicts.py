"""Conflicts and their resolutions, in two phases: detect, then apply what a person chose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as text_fn
from quillgraph.operators.graph import Graph, ordered_lines, remove_nodes
from quillgraph.operators.ranges import global_number

# How many technical nodes are looked at, their labels, a custom node's description.
CONTEXT_LIMIT = 60
TECHNICAL = ("Component", "Concept", "Requirement")
CUSTOM_DESCRIPTION = "Выбор пользователя"


def technical_nodes(nodes: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The first ``limit`` technical nodes in insertion order, with their context line."""
    first = nodes.where(F.col("label").isin(*TECHNICAL)).orderBy("seq").limit(limit)
    line = text_fn.node_line(F.col("id"), F.col("name"), F.coalesce("description", F.lit("")))
    return first.withColumn("line", line)


def technical_context(nodes: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    return technical_nodes(nodes, limit).agg(ordered_lines(F.col("line"), F.col("seq")).alias("context"))


def number_conflicts(conflicts: DataFrame) -> DataFrame:
    """(number, id, description, option, option_id, option_text): conflicts from 1, options
    from 0, as a person is asked."""
    numbered = global_number(conflicts, ["seq"], "number").withColumn("number", F.col("number") + 1)
    return numbered.select("number", "id", "description", F.posexplode("options").alias("option", "o")).select("number", "id", "description", F.col("option").cast("bigint").alias("option"), F.col("o.id").alias("option_id"), F.col("o.text").alias("option_text"))


def classify_answers(answers: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Resolutions from typed answers (conflict_id, answer): digits choose an option, other
    text is a choice of one's own; blank and out-of-range answers resolve nothing."""
    given = answers.withColumn("answer", text_fn.strip(F.col("answer"))).where("answer <> ''")
    joined = given.join(conflicts.select(F.col("id").alias("conflict_id"), "options"), "conflict_id")
    digits = F.col("answer").rlike("^[0-9]+$")
    at = F.try_element_at("options", F.expr("try_cast(answer as int)") + 1)
    row = joined.select("conflict_id", F.when(digits, at["id"]).alias("selected_option_id"), F.when(~digits, F.col("answer")).alias("custom_text"))
    return row.where("selected_option_id is not null or custom_text is not null")


def match_resolutions(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions with the options of their conflict; the first conflict of an id counts and
    unknown ids are passed over."""
    first = conflicts.groupBy(F.col("id").alias("conflict_id")).agg(F.min_by("options", "seq").alias("options"))
    return resolutions.join(first, "conflict_id")


def losing_nodes(matched: DataFrame) -> DataFrame:
    """(id, conflict_id, foreign_choice): options that a resolution removes.

    ``foreign_choice`` marks a chosen id that isn't among the options (all of them go).
    """
    chosen = F.nullif(F.col("selected_option_id"), F.lit(""))
    custom = F.nullif(F.col("custom_text"), F.lit(""))
    ids = F.transform("options", lambda o: o["id"])
    lost = F.when(chosen.isNotNull(), F.filter(ids, lambda i: i != chosen)).when(custom.isNotNull(), ids)
    foreign = F.coalesce(chosen.isNotNull() & ~F.array_contains(ids, chosen), F.lit(False))
    return matched.select(F.explode(lost).alias("id"), "conflict_id", foreign.alias("foreign_choice"))


def custom_nodes(matched: DataFrame) -> DataFrame:
    """Nodes for choices of one's own; of ids that the cut to 30 characters makes equal the
    later resolution stands, and ``collisions`` counts the others."""
    own = matched.where("coalesce(selected_option_id, '') = '' and coalesce(custom_text, '') <> ''")
    keyed = own.select(text_fn.custom_id(F.col("conflict_id")).alias("id"), F.col("custom_text").alias("name"), "seq")
    last = keyed.groupBy("id").agg(F.max_by("name", "seq").alias("name"), F.max("seq").alias("seq"), (F.count(F.lit(1)) - 1).alias("collisions"))
    return last.select("id", F.lit("Component").alias("label"), "name", F.lit(CUSTOM_DESCRIPTION).alias("description"), F.lit("tech_stack").alias("target_section"), "seq", "collisions")


def apply_resolutions(graph: Graph, conflicts: DataFrame, resolutions: DataFrame) -> Graph:
    """The graph after a person's choices; ``resolutions`` has a ``seq`` of its own."""
    matched = match_resolutions(conflicts, resolutions)
    out = remove_nodes(graph, losing_nodes(matched))
    last = graph.nodes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    fresh = custom_nodes(matched).crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + 1 + F.col("seq"))
    have = [c for c in graph.nodes.columns if c in fresh.columns]
    survivors = out.nodes.join(fresh.select("id"), "id", "left_anti")
    return out.with_(nodes=survivors.unionByName(fresh.select(*have), allowMissingColumns=True).select(*graph.nodes.columns))
