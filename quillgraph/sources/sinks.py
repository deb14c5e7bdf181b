"""Sinks: JSON, text, GraphML and Markdown, all written by Spark's own writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPHML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON record a row; NULL fields are kept, non-ASCII stays as it is."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_single_text(df: DataFrame, column: str, path: str) -> None:
    """For documents of one row (Markdown, report): one file."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def sanitize(df: DataFrame, name: str) -> Column:
    """A value as GraphML text: scalars as strings, containers as JSON, NULL as ``None``."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    text = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
    return F.coalesce(text, F.lit("None"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _data(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    return F.concat(*[F.concat(F.lit(f'<data key="{kind}_{n}">'), xml_escape(sanitize(df, n)), F.lit("</data>")) for n in names])


def _frame(nodes: DataFrame, edges: DataFrame) -> tuple[list[str], list[str], list[tuple[int, int, str]]]:
    """(data columns of nodes, of edges, the lines before and after the elements as (part, seq, line))."""
    node_names = [c for c in nodes.columns if c not in ("id", "seq")]
    edge_names = [c for c in edges.columns if c not in ("source", "target", "seq")]
    keys = [f'<key id="node_{n}" for="node" attr.name="{n}" attr.type="string"/>' for n in node_names]
    keys += [f'<key id="edge_{n}" for="edge" attr.name="{n}" attr.type="string"/>' for n in edge_names]
    fixed = [(0, 0, GRAPHML_HEAD)] + [(1, i, k) for i, k in enumerate(keys)] + [(1, len(keys), '<graph edgedefault="directed">'), (4, 0, "</graph>\n</graphml>")]
    return node_names, edge_names, fixed


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, seq, n, line): parts 0 head, 1 keys, 2 nodes, 3 edges, 4 tail, a line an element.

    Parallel edges get an id that counts them from 0.
    """
    from pyspark.sql.window import Window

    spark = nodes.sparkSession
    node_names, edge_names, fixed = _frame(nodes, edges)
    parallel = F.row_number().over(Window.partitionBy("source", "target").orderBy("seq")) - 1
    node = F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), _data(nodes, node_names, "node"), F.lit("</node>"))
    numbered = edges.withColumn("_key", parallel)
    edge = F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('" id="'), F.col("_key").cast("string"), F.lit('">'), _data(edges, edge_names, "edge"), F.lit("</edge>"))
    frame = spark.createDataFrame(fixed, "part int, seq bigint, line string")
    return (
        frame.unionByName(nodes.select(F.lit(2).alias("part"), F.col("seq").cast("bigint").alias("seq"), node.alias("line")))
        .unionByName(numbered.select(F.lit(3).alias("part"), F.col("seq").cast("bigint").alias("seq"), edge.alias("line")))
    )


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, single_file: bool = True) -> None:
    """The graph as one GraphML file (a global sort writes the lines; ``coalesce`` keeps its order), or,
    for graphs too large for one task, as a document a range of elements, each with its own
    head; an empty graph then has none."""
    lines = graphml_lines(nodes, edges)
    if single_file:
        lines.orderBy("part", "seq").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    fixed = _frame(nodes, edges)[2]
    before, after = [x for part, _, x in fixed if part < 2], [x for part, _, x in fixed if part > 3]

    def framed(batches):
        import pandas as pd

        empty = True
        for batch in batches:
            if empty and len(batch):
                yield pd.DataFrame({"value": before})
                empty = False
            yield batch
        if not empty:
            yield pd.DataFrame({"value": after})

    elements = lines.where("part in (2, 3)").repartitionByRange("part", "seq").sortWithinPartitions("part", "seq")
    elements.select(F.col("line").alias("value")).mapInPandas(framed, "value string").write.mode("overwrite").text(path)
