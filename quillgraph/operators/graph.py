"""The property multigraph: union, integrity, fixes, merging and validation.

Nodes: (id, label, name, description, target_section, seq), edges: (source, target, relation,
evidence, seq). ``seq`` is insertion order, on which results depend.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as text_fn
from quillgraph.operators.components import connected_components
from quillgraph.operators.ranges import climb, global_number, hot_keys, meet, number_within, roots
from quillgraph.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def with_(self, **parts: DataFrame) -> Graph:
        return replace(self, **parts)


def keep_first(nodes: DataFrame, order: Sequence[str] = ("seq",), key: str = "id") -> DataFrame:
    """One row a key, the first by ``order``. A map-side combined ``min_by``, so a key that
    recurs in a third of all rows is no burden to one task."""
    rest = [c for c in nodes.columns if c != key]
    first = nodes.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*[F.col(key) if c == key else F.col(f"_f.{c}").alias(c) for c in nodes.columns])


def union_subgraphs(subgraphs: DataFrame) -> Graph:
    """Nodes (first definition of an id stands) and the bag of all edges.

    ``subgraphs`` has (seq, nodes, edges); parallel edges stay, and an endpoint nobody
    defined gets no node.
    """
    nodes = subgraphs.select("seq", F.posexplode("nodes").alias("pos", "n")).select("n.*", F.col("seq").alias("g"), "pos")
    nodes = keep_first(nodes, ("g", "pos"))
    edges = subgraphs.select("seq", F.posexplode("edges").alias("pos", "e")).select("e.*", F.col("seq").alias("g"), "pos")
    # Places are as wide apart as the largest subgraph is.
    width = subgraphs.agg(F.max(F.greatest(F.size("nodes"), F.size("edges")))).first()[0] or 1
    order = lambda df: df.withColumn("seq", F.col("g").cast("bigint") * F.lit(max(width, 1)).cast("bigint") + F.col("pos")).drop("g", "pos")
    return Graph(order(nodes), order(edges))


def semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def ghost_filter(nodes: DataFrame, glossary: DataFrame) -> DataFrame:
    """Nodes whose id the glossary knows."""
    return semi(nodes, glossary.select("id"), ["id"])


def edge_integrity(edges: DataFrame, nodes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among the nodes (of the same ``within``) and no self-loop."""
    keep = edges.where("source <> target")
    for end in ("source", "target"):
        ids = nodes.select(*within, F.col("id").alias(end)).distinct()
        keep = semi(keep, ids, [*within, end])
    return keep


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes in ``ids`` and without their edges."""
    gone = ids.select("id").where("id is not null").distinct()
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(*graph.edges.columns))


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without all parallel edges of each (source, target), whatever their relation."""
    return edges.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_anti").select(*edges.columns)


def apply_fixes(graph: Graph, fixes: DataFrame) -> Graph:
    """``remove_node`` and ``remove_edge`` take effect; other actions are recorded only.
    Removals commute, so the order of fixes doesn't matter."""
    out = remove_nodes(graph, fixes.where("action = 'remove_node'").select(F.col("node_id").alias("id")))
    pairs = fixes.where("action = 'remove_edge'").select(F.col("edge_source").alias("source"), F.col("edge_target").alias("target"))
    return out.with_(edges=remove_edges(out.edges, pairs))


def candidate_texts(nodes: DataFrame) -> DataFrame:
    """Nodes that may be duplicates (Decisions never are), with the text to embed."""
    label = F.coalesce("label", F.lit("unknown"))
    return nodes.where(label != "Decision").withColumn("label", label).withColumn("embed_text", text_fn.dedup_text(F.col("name"), F.col("description")))


def duplicate_clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, cluster) of candidate pairs: transitive, named by the smallest id."""
    return connected_components(pairs, a, b).withColumnRenamed("component", "cluster")


def class_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, cluster) like ``duplicate_clusters``, from ``similar_classes``: only representatives are linked, and
    as each is the smallest of its class, a cluster has the smallest id of all its rows."""
    found = duplicate_clusters(pairs).select(F.col("node").alias("rep"), "cluster")
    placed = members.join(found, "rep", "left").where("cluster is not null or size > 1")
    return placed.select(F.col("id").alias("node"), F.coalesce("cluster", "rep").alias("cluster"))


_ASKED = "is_duplicate and size(ids_to_merge) > 1 and unified_id is not null"


def _asked(actions: DataFrame) -> DataFrame:
    """The actions that can be applied, numbered (``ord``) in order."""
    asked = global_number(actions.where(_ASKED), ["seq"], "ord")
    return cut_lineage(asked.select("seq", "ord", "ids_to_merge", "unified_id", "unified_name", "unified_desc"))


def _mentions(graph: Graph, asked: DataFrame) -> DataFrame:
    """(ord, id, unified, member, known, before, alive): an id that an action names, the action before that
    named it (``before``, only if as its unified id), and whether the id exists at the action's time.

    An id named before is gone if it was merged away there. If it was the unified id it exists if any id of that
    action did. An action's unified id is next named by one action, so these links are a forest.
    """
    # No exploded row carries its action's ids or searches them: an action may name thousands.
    members = asked.select("ord", "unified_id", F.explode(F.array_distinct("ids_to_merge")).alias("id")).where("id is not null")
    members = members.select("ord", "id", (F.col("id") == F.col("unified_id")).alias("unified"), F.lit(True).alias("member"))
    others = asked.where(~F.coalesce(F.array_contains("ids_to_merge", F.col("unified_id")), F.lit(False)))
    named = members.unionByName(others.select("ord", F.col("unified_id").alias("id"), F.lit(True).alias("unified"), F.lit(False).alias("member")))
    placed = cut_lineage(number_within(named, ["id"], ["ord"]))
    last = placed.select("id", (F.col("rn") + 1).alias("rn"), F.col("ord").alias("_last"), F.col("unified").alias("_kept"))
    # Only its first mention asks whether a node is given, so no id meets the nodes more than once.
    present = graph.nodes.select("id", F.lit(1).cast("bigint").alias("rn")).distinct().withColumn("_present", F.lit(True))
    linked = placed.join(last, ["id", "rn"], "left").join(present, ["id", "rn"], "left")
    linked = cut_lineage(linked.select("ord", "id", "unified", "member", F.coalesce("_present", F.lit(False)).alias("known"), F.when(F.col("_kept"), F.col("_last")).alias("before")))
    links = linked.where("before is not null").select(F.col("before").alias("child"), F.col("ord").alias("parent"))
    exists = climb(links, linked.where("known").select(F.col("ord").alias("child")).distinct())
    exists = exists.select(F.col("child").alias("before"), F.lit(True).alias("_exists"))
    later = linked.where("before is not null").join(exists, "before", "left").withColumn("alive", F.coalesce("_exists", F.lit(False))).drop("_exists")
    return cut_lineage(linked.where("before is null").withColumn("alive", F.col("known")).unionByName(later))


def _valid(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """The actions with ``valid``: those of their ids that exist at their time, in their order."""
    named = asked.select("ord", F.posexplode("ids_to_merge").alias("_at", "id"))
    alive = named.join(mentions.where("member and alive").select("ord", "id"), ["ord", "id"])
    own = alive.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("_at", "id"))).alias("_own"))
    ids = F.transform("_own", lambda x: x["id"])
    return asked.join(own, "ord", "left").withColumn("valid", F.coalesce(ids, F.array().cast("array<string>"))).drop("_own")


def _origins(valid: DataFrame, mentions: DataFrame) -> DataFrame:
    """(new_id, id, name, description, ord): nodes that actions made and that are there in the end, with the given
    node (``id``) whose other attributes they have: that of their first id, followed back to where it came from."""
    unified = mentions.where("unified").select("ord", F.col("alive").alias("_had"))
    merged = valid.where("size(valid) > 0").join(unified, "ord")
    kept = unified.where("_had").join(valid.where("size(valid) = 0").select("ord", "unified_id"), "ord").select("ord", F.col("unified_id").alias("id"))
    basis = merged.select("ord", F.when(F.col("_had"), F.col("unified_id")).otherwise(F.col("valid")[0]).alias("id")).unionByName(kept)
    steps = cut_lineage(basis.join(mentions.select("ord", "id", "before"), ["ord", "id"]))
    back = roots(steps.where("before is not null").select(F.col("ord").alias("child"), F.col("before").alias("parent")))
    gone = mentions.where("not unified").groupBy(F.col("id").alias("unified_id")).agg(F.max("ord").alias("_gone"))
    made = merged.where("not _had").groupBy("unified_id").agg(F.max_by(F.struct("unified_name", "unified_desc", "ord"), "ord").alias("_m")).select("unified_id", "_m.*")
    made = made.join(gone, "unified_id", "left").where("_gone is null or ord > _gone")
    made = made.join(back.withColumnRenamed("child", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    first = steps.where("before is null").select(F.col("ord").alias("root"), "id")
    rows = made.select("root", F.col("unified_id").alias("new_id"), F.col("unified_name").alias("name"), F.col("unified_desc").alias("description"), "ord")
    return rows.join(first, "root").drop("root")


def _finals(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, final): where the given nodes' edges end up. What an action keeps is what the next action that names
    its unified id keeps, so a node goes with the last such action after the first that names it."""
    ahead = roots(mentions.where("before is not null").select(F.col("before").alias("child"), F.col("ord").alias("parent")))
    starts = mentions.where("known").select("id", F.col("ord").alias("child"))
    ends = cut_lineage(starts.join(ahead, "child", "left").select("id", F.coalesce("root", "child").alias("ord")))
    # An action can be the end of most nodes.
    hot = hot_keys(ends, "ord", ends.count())
    return meet(ends, asked.select("ord", F.col("unified_id").alias("final")), "ord", hot).where("id <> final").select("id", "final")


def merge_outcomes(graph: Graph, actions: DataFrame) -> DataFrame:
    """(seq, unified_id, valid_ids, outcome, reason): what became of each merge action.

    ``valid_ids`` are those of its ids that existed at its time, after the actions before it. An action is
    ``applied`` if there is one, with a reason if nothing was left to merge, else ``rejected`` with the reason.
    """
    asked = _asked(actions)
    log = _valid(asked, _mentions(graph, asked))
    none = F.array().cast("array<string>")
    gone = F.size("valid") == 0
    idle = F.when(F.array_except("valid", F.array("unified_id")) == none, F.lit("nothing left to merge"))
    done = log.select("seq", "unified_id", F.col("valid").alias("valid_ids"), F.when(gone, F.lit("rejected")).otherwise(F.lit("applied")).alias("outcome"), F.when(gone, F.lit("no id exists")).otherwise(idle).alias("reason"))
    why = F.when(~F.coalesce("is_duplicate", F.lit(False)), F.lit("no duplicates")).when(F.col("unified_id").isNull(), F.lit("no unified id")).otherwise(F.lit("fewer than two ids"))
    never = actions.where(f"not coalesce({_ASKED}, false)").select("seq", "unified_id", none.alias("valid_ids"), F.lit("rejected").alias("outcome"), why.alias("reason"))
    return done.unionByName(never)


def merge_nodes(graph: Graph, actions: DataFrame) -> Graph:
    """Apply ordered merge actions (schema MERGE_ACTION and ``seq``): edges keep their number,
    self-loops that arise stay and are flagged by ``merged_loop``.

    Later actions see what earlier ones did: ids that are gone are passed over, a unified id that exists keeps its
    attributes, a new one takes those of its first id and a place after all others. An id that was merged away and
    made again is a new node: edges stay with what took the old one. An action without a unified id is passed over.
    Nothing is folded in order: ids by time are linked and followed by pointer jumping, so neither an id that most
    actions name nor a chain through all of them is one task. ``merge_outcomes`` tells what became of each action.
    """
    asked = _asked(actions)
    mentions = _mentions(graph, asked)
    moved = _origins(_valid(asked, mentions), mentions)
    last = graph.nodes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    fresh = graph.nodes.join(moved.select("id", "new_id", F.col("name").alias("new_name"), F.col("description").alias("new_desc"), "ord"), "id").crossJoin(F.broadcast(last))
    changed = {"id": F.col("new_id"), "name": F.col("new_name"), "description": F.col("new_desc"), "seq": F.col("last") + 1 + F.col("ord")}
    fresh = fresh.select(*[changed.get(c, F.col(c)).alias(c) for c in graph.nodes.columns])
    away = mentions.where("not unified").select("id").distinct()
    return Graph(graph.nodes.join(away, "id", "left_anti").unionByName(fresh), relabel(graph.edges, _finals(asked, mentions)))


def relabel(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """Redirect both ends by (id, final). No hint: Spark broadcasts the map if it is small."""
    out = edges
    for end in ("source", "target"):
        out = out.join(idmap.select(F.col("id").alias(end), F.col("final").alias(f"_{end}")), end, "left")
        out = out.withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    loop = (F.col("source") == F.col("target")).alias("merged_loop")
    return out.select(*edges.columns, loop) if "merged_loop" not in edges.columns else out.select(*edges.columns)


def edge_order(graph: Graph) -> DataFrame:
    """Edges with ``ord``: by their source's place, then the place where the pair first
    occurs, then their own. There may be as many pairs as edges, so they are merged, not broadcast."""
    first = graph.edges.groupBy("source", "target").agg(F.min("seq").alias("pair_seq"))
    places = graph.nodes.select(F.col("id").alias("source"), F.col("seq").alias("source_seq"))
    joined = graph.edges.join(first.hint("merge"), ["source", "target"]).join(places, "source", "left")
    return joined.withColumn("ord", F.struct(F.coalesce("source_seq", F.lit(1 << 62)).alias("s"), F.col("pair_seq").alias("p"), F.col("seq").alias("e"))).drop("pair_seq", "source_seq")


def finalize(graph: Graph) -> tuple[Graph, DataFrame]:
    """(valid graph, rejected nodes): a node needs a known label and a name, an edge a known
    relation; a missing id is filled from ``key``, an unknown section is uncategorized, and
    edges of a rejected node stay."""
    nodes = graph.nodes
    if "key" in nodes.columns:
        nodes = nodes.withColumn("id", F.coalesce("id", "key"))
    nodes = nodes.withColumn("target_section", schemas.section_or_unknown(F.col("target_section")))
    good = F.coalesce(F.col("label").isin(*schemas.NODE_LABELS) & F.col("name").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    fine = F.coalesce(F.col("relation").isin(*schemas.EDGE_RELATIONS), F.lit(False))
    return Graph(nodes.where(good), graph.edges.where(fine)), nodes.where(~good)


def upsert_glossary(entries: DataFrame) -> DataFrame:
    """(id, name, label, description, seq): a slug's last entry, at its first entry's place."""
    keyed = entries.withColumn("id", text_fn.slug(F.col("name")))
    last = keyed.groupBy("id").agg(F.max_by(F.struct("name", "label", "description"), "seq").alias("v"), F.min("seq").alias("seq"))
    return last.select("id", "v.name", "v.label", "v.description", "seq")


def link_entities(entities: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entities with the ``id`` they go by and whether the glossary knew it (equal slugs).

    The offline stand-in for a provider's verdict: one equality join for all entities at once.
    """
    keyed = entities.withColumn("id", text_fn.slug(F.col("name")))
    known = glossary.select("id", F.lit(True).alias("_known")).distinct()
    return keyed.join(known, "id", "left").withColumn("is_duplicate", F.coalesce("_known", F.lit(False))).drop("_known")


def ordered_lines(line: Column, seq: Column) -> Column:
    """Lines joined by line ends in order of ``seq`` (an aggregate)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), line.alias("l")))), lambda x: x["l"]), "\n")
