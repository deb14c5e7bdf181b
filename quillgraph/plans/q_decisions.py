"""Queries on votes: purchases vote for an option, errors against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import conflicts as c
from quillgraph.operators import decisions
from quillgraph.operators import graph as g
from quillgraph.plans.registry import query, table


def vote_graph(spark: SparkSession, sf_dir: str) -> g.Graph:
    """Decisions are the keys of the events' properties, options a key with user_id % 3."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    decision = F.concat(F.lit("decision_"), F.col("k").cast("string"))
    option = F.concat(F.lit("option_"), F.col("k").cast("string"), F.lit("_"), (F.col("user_id") % 3).cast("string"))
    voter = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    relates = e.where("event_type = 'view'").select(decision.alias("source"), option.alias("target"), F.lit("RELATES_TO").alias("relation"), F.lit("").alias("evidence"), F.col("event_id").alias("seq"))
    relation = F.when(F.col("event_type") == "purchase", F.lit("VOTED_FOR")).otherwise(F.lit("VOTED_AGAINST"))
    voted = e.where("event_type in ('purchase', 'error')").select(voter.alias("source"), option.alias("target"), relation.alias("relation"), F.lit("").alias("evidence"), F.col("event_id").alias("seq"))

    def nodes(node, label: str, name, rank: int) -> DataFrame:
        found = e.groupBy(node.alias("id"), name.alias("name")).agg(F.min("event_id").alias("first"))
        return found.select("id", F.lit(label).alias("label"), "name", F.lit("").alias("description"), F.lit(None).cast("string").alias("target_section"), (F.col("first") + F.lit(rank).cast("bigint") * 1_000_000_000_000).alias("seq"))

    # Every tenth user has no name and goes by the id.
    named = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("User "), F.col("user_id").cast("string")))
    all_nodes = nodes(decision, "Decision", F.concat(F.lit("Decision "), F.col("k").cast("string")), 0)
    all_nodes = all_nodes.unionByName(nodes(option, "Component", option, 1)).unionByName(nodes(voter, "Person", named, 2))
    return g.Graph(all_nodes, relates.unionByName(voted))


TALLY = """e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    'option_' || CAST(json_extract(props, '$.k') AS INTEGER) || '_' || (user_id % 3) AS option_id FROM events),
ds AS (SELECT k, min(event_id) AS seq FROM e GROUP BY k),
us AS (SELECT user_id, min(event_id) AS useq, CASE WHEN user_id % 10 <> 0 THEN 'User ' || user_id ELSE 'user_' || user_id END AS uname FROM e GROUP BY user_id),
opts AS (SELECT k, option_id, min(event_id) AS first_seq FROM e WHERE event_type = 'view' GROUP BY k, option_id),
vt AS (SELECT e.option_id, e.event_type, us.uname, us.useq, e.event_id, min(e.event_id) OVER (PARTITION BY e.user_id, e.option_id) AS pseq
  FROM e JOIN us USING (user_id) WHERE event_type IN ('purchase', 'error')),
vc AS (SELECT option_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS vf, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS va,
  string_agg(uname, ', ' ORDER BY useq, pseq, event_id) FILTER (WHERE event_type = 'purchase') AS nf,
  string_agg(uname, ', ' ORDER BY useq, pseq, event_id) FILTER (WHERE event_type = 'error') AS na FROM vt GROUP BY option_id),
o AS (SELECT opts.k, opts.option_id, opts.first_seq, coalesce(vf, 0) AS votes_for, coalesce(va, 0) AS votes_against, coalesce(vf, 0) - coalesce(va, 0) AS score,
  coalesce(nf, '') AS voters_for, coalesce(na, '') AS voters_against FROM opts LEFT JOIN vc USING (option_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, first_seq) AS rk, lead(score) OVER (PARTITION BY k ORDER BY score DESC, first_seq) AS nxt,
  max(votes_for + votes_against) OVER (PARTITION BY k) AS most, max(score) OVER (PARTITION BY k) AS top FROM o),
t AS (SELECT k, string_agg(option_id, ', ' ORDER BY rk) FILTER (WHERE score = top) AS tied FROM rk GROUP BY k),
res AS (SELECT rk.*, t.tied, ds.seq, (most = 0 OR coalesce(top = nxt, false)) AS is_tie FROM rk JOIN t USING (k) JOIN ds USING (k) WHERE rk = 1)"""


@query(f"WITH {TALLY} SELECT 'decision_' || k AS decision_id, option_id, first_seq AS option_seq FROM opts")
def decision_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F12, F13, A10, J7."""
    return decisions.decision_options(vote_graph(spark, sf_dir)).select("decision_id", "option_id", F.col("option_ord.p").alias("option_seq"))


@query(f"WITH {TALLY} SELECT 'decision_' || k AS decision_id, option_id, votes_for, votes_against, score, voters_for, voters_against FROM o")
def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, A9, J8, J9."""
    v = decisions.vote_counts(vote_graph(spark, sf_dir))
    return v.select("decision_id", "option_id", "votes_for", "votes_against", "score", F.array_join("voters_for", ", ").alias("voters_for"), F.array_join("voters_against", ", ").alias("voters_against"))


@query(f"""WITH {TALLY} SELECT 'decision_' || k AS decision_id, 'Decision ' || k AS decision_name, CASE WHEN NOT is_tie THEN option_id END AS winner_id, is_tie,
  CASE WHEN most = 0 THEN 'Голосов не обнаружено. Решение не принято.' WHEN is_tie THEN 'Ничья между: ' || tied || ' (счёт ' || top || '). Требуется ручное решение.' END AS conflict_description FROM res""")
def resolve_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, F14, A11, O3, W5, W6, T18."""
    return decisions.resolve_decisions(vote_graph(spark, sf_dir)).select("decision_id", "decision_name", "winner_id", "is_tie", "conflict_description")


@query(f"""WITH {TALLY} SELECT 'decision_' || k AS source, option_id AS target, 'RESOLVED_TO' AS relation,
  'Победитель голосования: ' || votes_for || ' за, ' || votes_against || ' против' AS evidence FROM res WHERE NOT is_tie""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4."""
    return decisions.resolved_edges(decisions.resolve_decisions(vote_graph(spark, sf_dir))).select("source", "target", "relation", "evidence")


@query(f"""WITH {TALLY}, ln AS (SELECT rk.k, rk.rk, '  ' || CASE WHEN NOT res.is_tie AND rk.option_id = res.option_id THEN '👑 ' ELSE '   ' END || rpad(rk.option_id, 25, ' ') || ' ' ||
    repeat('✅', rk.votes_for) || repeat('❌', rk.votes_against) || '  [' || CASE WHEN rk.score >= 0 THEN '+' ELSE '' END || rk.score || ']' ||
    CASE WHEN rk.voters_for <> '' THEN chr(10) || repeat(' ', 13) || 'За: ' || rk.voters_for ELSE '' END ||
    CASE WHEN rk.voters_against <> '' THEN chr(10) || repeat(' ', 13) || 'Против: ' || rk.voters_against ELSE '' END AS line FROM rk JOIN res ON rk.k = res.k),
b AS (SELECT res.k, res.seq, chr(10) || '📌 Decision ' || res.k || chr(10) || repeat('-', 40) || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY ln.rk) FROM ln WHERE ln.k = res.k) || chr(10) ||
    CASE WHEN is_tie THEN chr(10) || '  ⚠️  КОНФЛИКТ: ' || CASE WHEN most = 0 THEN 'Голосов не обнаружено. Решение не принято.' ELSE 'Ничья между: ' || tied || ' (счёт ' || top || '). Требуется ручное решение.' END
      ELSE chr(10) || '  ✅ ПРИНЯТО: ' || option_id END AS block FROM res)
SELECT repeat('=', 60) || chr(10) || '🗳️  ИТОГИ ГОЛОСОВАНИЙ' || chr(10) || repeat('=', 60) || chr(10) || string_agg(block, chr(10) ORDER BY seq) AS report FROM b""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, O4, K8."""
    return decisions.merge_report(decisions.resolve_decisions(vote_graph(spark, sf_dir)))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Component").alias("label"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("target_section"), F.col("p_partkey").alias("seq"), "p_brand", "p_size")


def _conflicts(parts: DataFrame) -> DataFrame:
    option = F.struct(F.col("id").alias("id"), F.col("name").alias("text"), F.lit("").alias("evidence"))
    small = parts.where("p_size <= 5")
    return small.groupBy("p_brand").agg(F.array_sort(F.collect_list(option)).alias("options"), F.min("seq").alias("seq")).select(F.concat(F.lit("conflict about "), "p_brand", F.lit(" and its parts")).alias("id"), "options", "seq", F.col("p_brand").alias("description"))


def _graph(parts: DataFrame) -> g.Graph:
    nodes = parts.drop("p_brand", "p_size")
    edges = nodes.select(F.col("id").alias("source"), F.lit("part_0").alias("target"), F.lit("RELATES_TO").alias("relation"), F.lit("").alias("evidence"), "seq")
    return g.Graph(nodes, edges)


CONFLICTS = """s AS (SELECT 'part_' || p_partkey AS id, p_brand, p_partkey FROM part WHERE p_size <= 5),
ch AS (SELECT p_brand, min(id) AS chosen FROM s GROUP BY p_brand)"""


@query(f"""WITH {CONFLICTS}, lost AS (SELECT id FROM s JOIN ch USING (p_brand) WHERE id <> chosen)
SELECT 'part_' || p_partkey AS id, p_name AS name FROM part WHERE 'part_' || p_partkey NOT IN (SELECT id FROM lost)""")
def apply_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option chosen stays, the others go; unknown conflicts do nothing."""
    parts = _parts(spark, sf_dir)
    found = _conflicts(parts)
    chosen = found.select(F.col("id").alias("conflict_id"), F.array_min(F.transform("options", lambda o: o["id"])).alias("selected_option_id"), F.lit("unused").alias("custom_text"), "seq")
    unknown = spark.createDataFrame([("no such conflict", "part_1", None, 0)], "conflict_id string, selected_option_id string, custom_text string, seq bigint")
    return c.apply_resolutions(_graph(parts), found, chosen.unionByName(unknown)).nodes.select("id", "name")


@query(f"""WITH {CONFLICTS}, k AS (SELECT 'part_' || p_partkey AS id, p_name AS name, 'Component' AS label FROM part WHERE 'part_' || p_partkey NOT IN (SELECT id FROM s)),
n AS (SELECT left('custom_conflict about ' || p_brand || ' and its parts', 30) AS id, p_brand, min(p_partkey) AS seq FROM s GROUP BY p_brand)
SELECT * FROM k UNION ALL SELECT id, 'own choice for ' || arg_max(p_brand, seq), 'Component' FROM n GROUP BY id""")
def apply_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice of one's own replaces all options by a new node."""
    parts = _parts(spark, sf_dir)
    found = _conflicts(parts)
    own = found.select(F.col("id").alias("conflict_id"), F.lit(None).cast("string").alias("selected_option_id"), F.concat(F.lit("own choice for "), "description").alias("custom_text"), "seq")
    return c.apply_resolutions(_graph(parts), found, own).nodes.select("id", "name", "label")


@query(f"""WITH {CONFLICTS}, n AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) AS number FROM s GROUP BY p_brand)
SELECT number, row_number() OVER (PARTITION BY p_brand ORDER BY id) - 1 AS option, id AS option_id FROM s JOIN n USING (p_brand)""")
def number_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts from 1, options from 0."""
    return c.number_conflicts(_conflicts(_parts(spark, sf_dir))).select("number", "option", "option_id")


@query(f"""WITH {CONFLICTS}, o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY id) - 1 AS i FROM s),
a AS (SELECT p_brand, CASE hash_no % 4 WHEN 0 THEN '0' WHEN 1 THEN ' my own ' WHEN 2 THEN '99999' ELSE '  ' END AS answer FROM (SELECT p_brand, length(p_brand) + CAST(right(p_brand, 1) AS INTEGER) AS hash_no FROM s GROUP BY p_brand))
SELECT 'conflict about ' || p_brand || ' and its parts' AS conflict_id, CASE WHEN answer = '0' THEN (SELECT id FROM o WHERE o.p_brand = a.p_brand AND i = 0) END AS selected_option_id,
  CASE WHEN answer = ' my own ' THEN 'my own' END AS custom_text FROM a WHERE answer IN ('0', ' my own ')""")
def classify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits choose, other text is one's own, blank and out of range do nothing."""
    found = _conflicts(_parts(spark, sf_dir))
    k = (F.char_length("description") + F.substring("description", -1, 1).cast("int")) % 4
    answer = F.when(k == 0, "0").when(k == 1, " my own ").when(k == 2, "99999").otherwise("  ")
    return c.classify_answers(found.select(F.col("id").alias("conflict_id"), answer.alias("answer")), found)
