"""Votes on decisions: options, counts, outcome and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.graph import Graph, edge_order


@dataclass(frozen=True)
class Wording:
    """Texts of resolutions and of the report (fixed values by default)."""

    no_votes: str = "Голосов не обнаружено. Решение не принято."
    tie: tuple[str, str, str] = ("Ничья между: ", " (счёт ", "). Требуется ручное решение.")
    evidence: tuple[str, str, str] = ("Победитель голосования: ", " за, ", " против")
    votes_title: str = "🗳️  ИТОГИ ГОЛОСОВАНИЙ"
    conflicts_title: str = "⚡ КОНФЛИКТЫ ГРАФА (требуют внимания)"
    voters: tuple[str, str] = ("За", "Против")
    marks: tuple[str, str] = ("✅", "❌")
    crown: str = "👑 "
    tied: str = "⚠️  КОНФЛИКТ: "
    accepted: str = "✅ ПРИНЯТО: "
    nothing: str = "✅ Голосований и конфликтов не обнаружено."


WORDING = Wording()


def decision_options(graph: Graph) -> DataFrame:
    """(decision_id, decision_name, decision_seq, option_id, option_name, option_ord): targets
    of RELATES_TO edges, once each at their first place; unknown options go by their id."""
    decisions = graph.nodes.where("label = 'Decision'").select(F.col("id").alias("decision_id"), F.coalesce("name", "id").alias("decision_name"), F.col("seq").alias("decision_seq"))
    out = edge_order(graph).where("relation = 'RELATES_TO'").select(F.col("source").alias("decision_id"), F.col("target").alias("option_id"), "ord")
    options = out.join(decisions, "decision_id").groupBy("decision_id", "decision_name", "decision_seq", "option_id").agg(F.min("ord").alias("option_ord"))
    names = graph.nodes.select(F.col("id").alias("option_id"), F.col("name").alias("_name"))
    return options.join(names, "option_id", "left").withColumn("option_name", F.coalesce("_name", "option_id")).drop("_name")


def vote_counts(graph: Graph) -> DataFrame:
    """Options with votes_for, votes_against, score and the voters' names in edge order.

    Edges count, not voters; a vote for an option counts in every decision that lists it.
    """
    options = decision_options(graph)
    votes = edge_order(graph).where("relation in ('VOTED_FOR', 'VOTED_AGAINST')")
    voters = graph.nodes.select(F.col("id").alias("source"), F.col("name").alias("_name"))
    named = votes.join(voters, "source", "left").select(F.col("target").alias("option_id"), "relation", "ord", F.coalesce("_name", "source").alias("voter"))

    def names(relation: str) -> Column:
        gathered = F.array_sort(F.collect_list(F.when(F.col("relation") == relation, F.struct("ord", "voter"))))
        return F.transform(gathered, lambda x: x["voter"])

    # Counted by option once, then given to each decision that lists it; merged, as an option's row names all its voters.
    per_option = named.groupBy("option_id").agg(
        F.count_if(F.col("relation") == "VOTED_FOR").alias("votes_for"),
        F.count_if(F.col("relation") == "VOTED_AGAINST").alias("votes_against"),
        names("VOTED_FOR").alias("voters_for"),
        names("VOTED_AGAINST").alias("voters_against"),
    )
    none = F.array().cast("array<string>")
    full = options.join(per_option.hint("merge"), "option_id", "left").na.fill(0, ["votes_for", "votes_against"])
    full = full.withColumn("voters_for", F.coalesce("voters_for", none)).withColumn("voters_against", F.coalesce("voters_against", none))
    return full.withColumn("score", F.col("votes_for") - F.col("votes_against"))


def resolve_decisions(graph: Graph, wording: Wording = WORDING) -> DataFrame:
    """One row a decision with options: winner, or tie with its description, and ``options``."""
    counts = vote_counts(graph)
    by_score = Window.partitionBy("decision_id").orderBy(F.desc("score"), "option_ord")
    whole = Window.partitionBy("decision_id")
    ranked = (
        counts.withColumn("rk", F.row_number().over(by_score))
        .withColumn("next_score", F.lead("score").over(by_score))
        .withColumn("most", F.max(F.col("votes_for") + F.col("votes_against")).over(whole))
        .withColumn("top", F.max("score").over(whole))
    )
    option = F.struct("option_ord", "rk", "option_id", "option_name", "votes_for", "votes_against", "voters_for", "voters_against", "score")
    tied = F.array_sort(F.collect_list(F.when(F.col("score") == F.col("top"), F.struct("rk", "option_name"))))
    head = lambda c: F.max(F.when(F.col("rk") == 1, F.col(c)))
    rows = ranked.groupBy("decision_id", "decision_name", "decision_seq").agg(
        F.max("most").alias("most"),
        F.max("top").alias("top"),
        head("next_score").alias("second"),
        head("option_id").alias("first_id"),
        head("option_name").alias("first_name"),
        head("votes_for").alias("first_for"),
        head("votes_against").alias("first_against"),
        F.transform(tied, lambda x: x["option_name"]).alias("tied"),
        F.array_sort(F.collect_list(option)).alias("options"),
    )
    is_tie = (F.col("most") == 0) | F.coalesce(F.col("top") == F.col("second"), F.lit(False))
    a, b, c = wording.tie
    text = F.concat(F.lit(a), F.array_join("tied", ", "), F.lit(b), F.col("top").cast("string"), F.lit(c))
    return rows.select(
        "decision_id",
        "decision_name",
        "decision_seq",
        F.when(~is_tie, F.col("first_id")).alias("winner_id"),
        F.when(~is_tie, F.col("first_name")).alias("winner_name"),
        is_tie.alias("is_tie"),
        F.when(F.col("most") == 0, F.lit(wording.no_votes)).when(is_tie, text).alias("conflict_description"),
        F.when(~is_tie, F.concat(F.lit(wording.evidence[0]), F.col("first_for").cast("string"), F.lit(wording.evidence[1]), F.col("first_against").cast("string"), F.lit(wording.evidence[2]))).alias("evidence"),
        "options",
    )


def resolved_edges(resolutions: DataFrame) -> DataFrame:
    """RESOLVED_TO edges of the decisions that have a winner."""
    won = resolutions.where("winner_id is not null")
    return won.select(F.col("decision_id").alias("source"), F.col("winner_id").alias("target"), F.lit("RESOLVED_TO").alias("relation"), "evidence", F.col("decision_seq").alias("seq"))


def report_blocks(resolutions: DataFrame, wording: Wording = WORDING) -> DataFrame:
    """(decision_seq, decision_id, block): the report's lines about each decision."""

    def voters(names: Column, word: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(" " * 11 + "  " + word + ": "), F.array_join(names, ", ")))

    def option(o: Column) -> Column:
        mark = F.when(o["option_id"] == F.col("winner_id"), F.lit(wording.crown)).otherwise(F.lit("   "))
        bars = F.concat(F.repeat(F.lit(wording.marks[0]), o["votes_for"].cast("int")), F.repeat(F.lit(wording.marks[1]), o["votes_against"].cast("int")))
        padded = F.when(F.char_length(o["option_name"]) < 25, F.rpad(o["option_name"], 25, " ")).otherwise(o["option_name"])
        signed = F.concat(F.when(o["score"] >= 0, F.lit("+")).otherwise(F.lit("")), o["score"].cast("string"))
        line = F.concat(F.lit("  "), mark, padded, F.lit(" "), bars, F.lit("  ["), signed, F.lit("]"))
        return F.concat_ws("\n", line, voters(o["voters_for"], wording.voters[0]), voters(o["voters_against"], wording.voters[1]))

    ranked = F.array_sort(F.transform("options", lambda o: F.struct(o["rk"].alias("rk"), option(o).alias("text"))))
    body = F.array_join(F.transform(ranked, lambda x: x["text"]), "\n")
    outcome = F.when(F.col("is_tie"), F.concat(F.lit("\n  " + wording.tied), F.col("conflict_description"))).otherwise(F.concat(F.lit("\n  " + wording.accepted), F.col("winner_name")))
    block = F.concat_ws("\n", F.concat(F.lit("\n📌 "), F.col("decision_name")), F.lit("-" * 40), body, outcome)
    return resolutions.select("decision_seq", "decision_id", block.alias("block"))


def merge_report(resolutions: DataFrame, conflicts: DataFrame | None = None, wording: Wording = WORDING) -> DataFrame:
    """The whole report as one row (``report``); its size is that of the decisions."""
    rule = "=" * 60
    blocks = report_blocks(resolutions, wording).select(F.lit(1).alias("part"), F.struct("decision_seq", "decision_id").alias("ord"), F.col("block"))
    if conflicts is not None:
        lines = F.concat_ws(
            "\n",
            F.concat(F.lit("\n  •["), F.col("node_id"), F.lit("] "), F.col("description")),
            F.nullif(F.array_join(F.transform("conflicting_values", lambda v: F.concat(F.lit("      ↳ "), v)), "\n"), F.lit("")),
        )
        blocks = blocks.unionByName(conflicts.select(F.lit(2).alias("part"), F.struct(F.lit(0).cast("bigint").alias("decision_seq"), F.col("id").alias("decision_id")).alias("ord"), lines.alias("block")))
    gathered = blocks.agg(F.array_sort(F.collect_list(F.struct("part", "ord", "block"))).alias("b"))

    def section(part: int, head: str) -> Column:
        own = F.filter("b", lambda x: x["part"] == part)
        return F.when(F.size(own) > 0, F.concat(F.lit(head), F.array_join(F.transform(own, lambda x: x["block"]), "\n")))

    votes = section(1, f"{rule}\n{wording.votes_title}\n{rule}\n")
    clashes = section(2, f"\n{rule}\n{wording.conflicts_title}\n{rule}\n")
    return gathered.select(F.when(F.size("b") == 0, F.lit(wording.nothing)).otherwise(F.concat_ws("\n", votes, clashes)).alias("report"))
