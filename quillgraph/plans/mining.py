"""From messages to window subgraphs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import providers, votes
from quillgraph.functions import text as text_fn
from quillgraph.functions.embeddings import hashed_embeddings
from quillgraph.operators import threads, windows
from quillgraph.session import batches_of, cut_lineage


def rendered(messages: DataFrame, lexicon: votes.VoteLexicon = votes.RUSSIAN) -> DataFrame:
    """Messages with ``line``: date, author, what they answer, their vote and text."""
    lookup = threads.message_lookup(messages).select("source", F.col("id").alias("reply_to_message_id"), F.col("from").alias("r_from"), F.col("text").alias("r_text"), F.lit(True).alias("r_known"))
    # Merged, as the lookup holds all texts; what answers nothing stays out, as NULL keys would be one task a source.
    joined = messages.where("reply_to_message_id is not null").join(lookup.hint("merge"), ["source", "reply_to_message_id"], "left")
    joined = joined.unionByName(messages.where("reply_to_message_id is null"), allowMissingColumns=True)
    reply = F.when(F.col("r_known"), text_fn.reply_snippet(F.col("r_from"), F.coalesce("r_text", F.lit(""))))
    flag = votes.vote_flag(votes.detect_vote(F.col("text"), lexicon))
    return joined.withColumn("line", text_fn.chat_line(F.col("date"), F.col("from"), F.col("author"), reply, flag, F.col("text"))).drop("r_from", "r_text", "r_known")


def chat_windows(messages: DataFrame, embed=hashed_embeddings, lexicon: votes.VoteLexicon = votes.RUSSIAN, least: float = threads.THREAD_SIMILARITY) -> DataFrame:
    """(source, thread_idx, window_idx, window_ref, n_messages, window_text) of chat messages."""
    valid = embed(threads.valid_messages(messages))
    edges = threads.thread_edges(valid, least=least)
    members = threads.thread_members(valid, edges)
    lines = rendered(messages, lexicon).select("source", "id", "line")
    full = valid.select("source", "id", "pos", "ts", F.char_length("text").alias("chars")).join(members.hint("merge"), ["source", "id"])
    ordered = threads.order_threads(full)
    keys = ["source", "thread", "thread_idx"]
    packed = windows.pack_windows(ordered, keys)
    placed = windows.window_members(packed, ordered, keys).join(lines.hint("merge"), ["source", "id"])
    return windows.window_text(placed, ["source"])


def mine_parallel(windows_df: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """Subgraphs of windows mined independently: (source, window_ref, seq, nodes, edges, fixes).

    Ids are slugs, so equal names meet in the union; near-equal ones meet in deduplication.
    Each window's edges are kept only between its own nodes.
    """
    ordered = windows_df.withColumn("prompt", F.lit(""))
    graphs = providers.parsed(providers.call(ordered, provider, "graph", data="window_text", retry=retry), schemas.SUBGRAPH, out="g")
    judged = providers.call(graphs.withColumn("graph_json", F.to_json("g")), provider, "critique", data="graph_json", retry=retry)
    fixed = providers.parsed(judged, schemas.FIXES, out="f").where("g is not null")
    gone = F.transform(F.filter(F.coalesce("f.fixes", F.array()), lambda x: x["action"] == "remove_node"), lambda x: x["node_id"])
    cut = F.transform(F.filter(F.coalesce("f.fixes", F.array()), lambda x: x["action"] == "remove_edge"), lambda x: F.struct(x["edge_source"].alias("s"), x["edge_target"].alias("t")))
    nodes = F.filter("g.nodes", lambda n: ~F.array_contains(F.col("_gone"), n["id"]))
    ids = F.transform("_nodes", lambda n: n["id"])
    edges = F.filter(
        "g.edges",
        lambda e: (e["source"] != e["target"])
        & F.array_contains(F.col("_ids"), e["source"])
        & F.array_contains(F.col("_ids"), e["target"])
        & ~F.exists("_cut", lambda c: (c["s"] == e["source"]) & (c["t"] == e["target"])),
    )
    full = fixed.withColumn("_gone", gone).withColumn("_cut", cut).withColumn("_nodes", nodes).withColumn("_ids", ids)
    return full.select("source", "window_ref", "thread_idx", "window_idx", F.col("_nodes").alias("nodes"), edges.alias("edges"), F.col("f.fixes").alias("fixes"))


def mine_in_order(windows_df: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """The same with carried state: a project's windows in order, each seeing the glossary and
    memory its predecessors left. One task a project, as every prompt needs the one before;
    ``windows_df`` has ``project``. A window whose calls fail is left out.

    Windows stream through a task in order, so it holds a batch of them and what is carried, never a project."""

    def ask(step: str, prompt: str, data: str) -> dict:
        """The provider's answer; one that fails or is no JSON object is empty."""
        try:
            found = json.loads(retry.call(provider, step, prompt, data) or "{}")
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, glossary, memory = None, {}, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.project_key != current:
                    current, glossary, memory = row.project_key, {}, {}
                for entity in ask("entities", "", row.window_text).get("entities") or []:
                    own = str(entity.get("name") or "").lower().replace(" ", "_").replace("-", "_")
                    link = ask("link", "", json.dumps([entity.get("name"), sorted(glossary)], ensure_ascii=False)) if glossary and own else {}
                    # What the provider knows by another name, or by its own, keeps its entry.
                    if own and not (link.get("is_duplicate") and link.get("target_global_id")):
                        glossary[own] = {"id": own, **entity}
                graph = ask("graph", json.dumps({"glossary": list(glossary), "memory": memory}, ensure_ascii=False), row.window_text)
                if "nodes" not in graph or "edges" not in graph:
                    continue
                fixes = [x for x in ask("critique", "", json.dumps(graph, ensure_ascii=False)).get("fixes") or [] if isinstance(x, dict)]
                gone = {x.get("node_id") for x in fixes if x.get("action") == "remove_node"}
                cut = {(x.get("edge_source"), x.get("edge_target")) for x in fixes if x.get("action") == "remove_edge"}
                kept = [n for n in graph["nodes"] if n["id"] not in gone]
                memory = ask("memory", "", json.dumps({**graph, "nodes": kept}, ensure_ascii=False))
                for n in kept:
                    if n.get("label") == "Decision":  # decisions name themselves
                        glossary.setdefault(n["id"], {k: n.get(k) for k in ("id", "name", "label", "description")})
                nodes = [n for n in kept if n["id"] in glossary]
                ids = {n["id"] for n in nodes}
                edges = [e for e in graph["edges"] if e["source"] != e["target"] and {e["source"], e["target"]} <= ids and (e["source"], e["target"]) not in cut]
                out.append((row.source, row.window_ref, row.thread_idx, row.window_idx, *[json.dumps(x, ensure_ascii=False) for x in (nodes, edges, fixes)]))
            yield pd.DataFrame(out, columns=["source", "window_ref", "thread_idx", "window_idx", "nodes", "edges", "fixes"])

    # As text, so that rows without a project are one project too.
    keyed = windows_df.withColumn("project_key", F.to_json(F.struct("project")))
    order = [F.asc_nulls_last(c) for c in ("source_seq", "thread_idx", "window_idx")]
    # A number of partitions, as projects of few bytes would be put together in one task.
    dealt = keyed.repartition(int(windows_df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project_key").sortWithinPartitions("project_key", *order)
    rows = dealt.select("project_key", "source", "window_ref", "thread_idx", "window_idx", "window_text").mapInPandas(mine, "source string, window_ref string, thread_idx bigint, window_idx bigint, nodes string, edges string, fixes string")
    graph = schemas.struct(schemas.SUBGRAPH)
    nodes, edges = graph["nodes"].dataType, graph["edges"].dataType
    fixes = schemas.struct(schemas.FIXES)["fixes"].dataType
    parsed = rows.withColumn("nodes", F.from_json("nodes", nodes)).withColumn("edges", F.from_json("edges", edges)).withColumn("fixes", F.from_json("fixes", fixes))
    with batches_of(windows_df.sparkSession, providers.BATCH):
        return cut_lineage(parsed)


def entity_rows(windows_df: DataFrame, provider: providers.Provider, retry: providers.Retry = providers.Retry()) -> DataFrame:
    """(window_ref, name, label, description) of each entity a provider finds in a window."""
    raw = providers.call(windows_df.withColumn("prompt", F.lit("")), provider, "entities", data="window_text", retry=retry)
    return providers.parsed(raw, schemas.RAW_ENTITIES, out="v").select("source", "window_ref", F.inline("v.entities"))
