"""Sections of the document: unassigned nodes, assignment, facts and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as text_fn
from quillgraph.operators.graph import ordered_lines
from quillgraph.operators.ranges import global_number

# Batch size, document name and version.
BATCH = 20
PROJECT_NAME = "Техническое Задание (AI Generated)"
VERSION = "1.0.0"


def unassigned(nodes: DataFrame) -> DataFrame:
    """Nodes other than persons that have no section yet."""
    section = F.coalesce("target_section", F.lit(schemas.UNCATEGORIZED))
    return nodes.where(~F.col("label").eqNullSafe("Person") & (section == schemas.UNCATEGORIZED))


def batches(nodes: DataFrame, size: int = BATCH) -> DataFrame:
    """Contiguous batches in insertion order: adds ``n`` and ``batch`` from 0."""
    return global_number(nodes, ["seq"]).withColumn("batch", F.expr(f"n div {size}"))


def batch_prompts(nodes: DataFrame, size: int = BATCH) -> DataFrame:
    line = text_fn.section_line(F.col("id"), F.coalesce("name", F.lit("")))
    return batches(unassigned(nodes), size).groupBy("batch").agg(F.count(F.lit(1)).alias("n_nodes"), ordered_lines(line, F.col("n")).alias("context"))


def assign(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(node_id, target_section, seq) applied to any existing node; the last one stands."""
    last = assignments.groupBy(F.col("node_id").alias("id")).agg(F.max_by("target_section", "seq").alias("_new"))
    out = nodes.join(last, "id", "left").withColumn("target_section", F.coalesce("_new", "target_section"))
    return out.select(*nodes.columns)


def section_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, name, schemas.SECTIONS[name]) for i, name in enumerate(schemas.DOCUMENT_ORDER)]
    return spark.createDataFrame(rows, "ord int, title string, section_id string")


def section_facts(nodes: DataFrame) -> DataFrame:
    """(ord, title, section_id, n_nodes, facts) of sections that have nodes, in document order."""
    line = text_fn.fact_line(F.col("id"), F.col("name"), F.col("description"))
    dim = F.broadcast(section_dimension(nodes.sparkSession))
    known = nodes.join(dim, nodes["target_section"] == dim["section_id"])
    return known.groupBy("ord", "title", "section_id").agg(F.count(F.lit(1)).alias("n_nodes"), ordered_lines(line, F.col("seq")).alias("facts"))


def section_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("target_section", F.lit(schemas.UNCATEGORIZED)).alias("target_section")).agg(F.count(F.lit(1)).alias("n_nodes"))


def section_markdown(title: Column, content: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n\n"), content, F.lit("\n\n---\n\n"))


def compile_document(sections: DataFrame, project: str = PROJECT_NAME, version: str = VERSION, version_label: str = "Версия") -> DataFrame:
    """The Markdown document as one row, from (ord, title, content_markdown); sections without
    content are left out."""
    head = f"# {project}\n**{version_label}:** {version}\n\n---\n\n"
    part = F.struct("ord", section_markdown(F.col("title"), F.col("content_markdown")).alias("md"))
    body = sections.where("content_markdown is not null").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return body.select(F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["md"]), "")).alias("markdown"))


def outline(items: DataFrame) -> DataFrame:
    """Numbered nested outline as Markdown, from (path array<int>, number, title, content):
    the depth of a path gives its heading."""
    head = F.concat(F.repeat(F.lit("#"), F.size("path") + 1), F.lit(" "), F.col("number"), F.lit(" "), F.col("title"))
    text = F.concat_ws("\n\n", head, F.nullif("content", F.lit("")))
    rows = items.agg(F.array_sort(F.collect_list(F.struct("path", text.alias("t")))).alias("p"))
    return rows.select(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("markdown"))
