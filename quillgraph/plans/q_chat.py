"""Queries on messages: scans, text functions, threads and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as text_fn
from quillgraph.functions import votes
from quillgraph.functions.vectors import cosine, norm
from quillgraph.operators import communities, similarity, threads, windows
from quillgraph.operators.components import connected_components
from quillgraph.operators.ranges import number_within
from quillgraph.plans import mining
from quillgraph.plans.registry import query, table
from quillgraph.sources.chat import conversation_messages, document_windows

MESSAGES = """m AS (
  SELECT 'conv_' || conv_id AS source, CAST(turn AS BIGINT) AS pos, CAST(conv_id * 1000 + turn AS BIGINT) AS id, role AS author, text,
         CASE WHEN turn % 2 = 1 THEN CAST(conv_id * 1000 + turn - 1 AS BIGINT) END AS reply_to,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS BIGINT)) AS ts
  FROM conversations),
v AS (SELECT * FROM m WHERE text IS NOT NULL AND text <> '')"""


@query(f"""WITH {MESSAGES}
SELECT source, id, coalesce(nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), 'empty') AS embed_text FROM v""")
def valid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, F1."""
    return threads.valid_messages(conversation_messages(spark, sf_dir)).select("source", "id", "embed_text")


@query("""WITH e AS (SELECT 'u' || user_id % 50 AS source, event_id // 3 AS id, event_type, event_id FROM events)
SELECT source, id, arg_max(event_type, event_id) AS text FROM e GROUP BY source, id""")
def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of an id stands."""
    e = table(spark, sf_dir, "events")
    m = e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("source"),
        F.expr("event_id div 3").alias("id"),
        F.lit("message").alias("type"),
        F.lit(None).cast("string").alias("from"),
        F.col("event_type").alias("text"),
        F.col("event_id").alias("pos"),
    )
    return threads.message_lookup(m).select("source", "id", "text")


@query(f"""WITH {MESSAGES}
SELECT a.source, a.id, a.reply_to AS target, CAST(15.0 AS DOUBLE) AS weight FROM v a JOIN v b ON a.source = b.source AND a.reply_to = b.id""")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, J1."""
    return threads.reply_edges(threads.valid_messages(conversation_messages(spark, sf_dir)))


@query(f"""WITH {MESSAGES}
SELECT a.source, a.id, regexp_replace('[' || strftime(a.ts, '%Y-%m-%dT%H:%M:%S') || '] ' || a.author ||
  CASE WHEN b.id IS NULL THEN '' ELSE '[в ответ ' || b.author || ': "' || replace(substr(coalesce(b.text, ''), 1, 40), chr(10), ' ') || '..."]' END ||
  ': ' || coalesce(a.text, ''), '^\\s+|\\s+$', '', 'g') AS line
FROM m a LEFT JOIN m b ON a.source = b.source AND a.reply_to = b.id""")
def format_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, T4, T5."""
    return mining.rendered(conversation_messages(spark, sf_dir)).select("source", "id", "line")


_VOTES = [
    "я за React, да", "голосую за C++ и C#", "из-за ошибки", "не за Vue", "поддерживаю Redis", "против Vue!", "не хочу Mongo", "Ок!", "не надо",
    "Ок, принято.", "  Да  ", "тоже за Go\n", "согласен", "+", "-", "просто текст", "Я против Java 8.", "",
]


def _vote_sql(lexicon: votes.VoteLexicon, text: str, rows: str) -> str:
    whens = []
    for direction, patterns in (("for", lexicon.for_patterns), ("against", lexicon.against_patterns)):
        for p in patterns:
            whole = p + votes.TARGET
            whens.append((f"regexp_matches(low, '{whole}')", direction, f"regexp_replace(regexp_extract(low, '{whole}', 1), '^\\s+|\\s+$', '', 'g')"))
    for direction, words in (("for", lexicon.confirmations), ("against", lexicon.rejections)):
        listed = ", ".join(f"'{w}'" for w in words)
        whens.append((f"answer IN ({listed})", direction, "NULL"))
    case = lambda k: "CASE " + " ".join(f"WHEN {w[0]} THEN {w[k] if k == 2 else repr(w[k])}" for w in whens) + " END"
    return f"""WITH src AS ({rows}),
    low AS (SELECT *, regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g') AS low FROM src),
    ans AS (SELECT *, regexp_replace(low, '^[,.!?:]+|[,.!?:]+$', '', 'g') AS answer FROM low),
    d AS (SELECT *, {case(1)} AS direction, {case(2)} AS target FROM ans)"""


_LITERALS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_VOTES)) + ") t(id, text)"


def _flags(d: DataFrame, lexicon: votes.VoteLexicon) -> DataFrame:
    v = d.withColumn("v", votes.detect_vote(F.col("text"), lexicon))
    return v.select(F.col("id").cast("bigint").alias("id"), F.col("v.direction").alias("direction"), F.col("v.target").alias("target"), votes.vote_flag(F.col("v")).alias("flag"))


_FLAG_SQL = " SELECT CAST(id AS BIGINT) AS id, direction, target, CASE WHEN direction IS NOT NULL THEN '[VOTE_' || upper(direction) || ':' || coalesce(nullif(target, ''), 'LAST_MENTIONED') || ']' END AS flag FROM d"


#: Every customer says one of the literals and a name of its own.
_SAID = f"SELECT c_custkey AS id, l.text || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || c_mktsegment END AS text FROM customer JOIN ({_LITERALS}) l ON l.id = c_custkey % {len(_VOTES)}"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = F.get(F.array(*map(F.lit, _VOTES)), (F.col("c_custkey") % len(_VOTES)).cast("int"))
    text = F.concat(literal, F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), text.alias("text"))


@query(_vote_sql(votes.RUSSIAN, "text", _SAID) + _FLAG_SQL)
def vote_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8 in the default locale, on what all customers say."""
    return _flags(_said(spark, sf_dir), votes.RUSSIAN)


_ENGLISH_ROWS = """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'I vote for ' || event_type || '!' WHEN 1 THEN 'we do not want ' || event_type
  WHEN 2 THEN ' Yes. ' WHEN 3 THEN 'No' WHEN 4 THEN 'I support ' || event_type || ', really' WHEN 5 THEN event_type ELSE 'vote against ' || event_type END AS text FROM events"""


@query(_vote_sql(votes.ENGLISH, "text", _ENGLISH_ROWS) + _FLAG_SQL)
def vote_flags_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8 with another locale table, on all events."""
    k, t = F.col("event_id") % 7, F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit("I vote for "), t, F.lit("!")))
        .when(k == 1, F.concat(F.lit("we do not want "), t))
        .when(k == 2, F.lit(" Yes. "))
        .when(k == 3, F.lit("No"))
        .when(k == 4, F.concat(F.lit("I support "), t, F.lit(", really")))
        .when(k == 5, t)
        .otherwise(F.concat(F.lit("vote against "), t))
    )
    return _flags(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text")), votes.ENGLISH)


def _short_sql(rows: str) -> str:
    return f"""WITH src AS ({rows}),
a AS (SELECT *, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '^[,.!?:]+|[,.!?:]+$', '', 'g') AS answer FROM src)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN answer IN ({", ".join(f"'{w}'" for w in votes.RUSSIAN.confirmations)}) THEN '[FLAG: CONFIRMATION]'
  WHEN answer IN ({", ".join(f"'{w}'" for w in votes.RUSSIAN.rejections)}) THEN '[FLAG: REJECTION]' ELSE text END AS normalized FROM a"""


@query(_short_sql(_SAID))
def short_answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 on what all customers say."""
    return _said(spark, sf_dir).select("id", votes.short_answer(F.col("text")).alias("normalized"))


#: Every event with a literal, and every message of the conversations with its own text.
_TALK = f"""SELECT event_id AS id, l.text FROM events JOIN ({_LITERALS}) l ON l.id = event_id % {len(_VOTES)}
  UNION ALL SELECT 1000000000000 + conv_id * 1000 + turn, text FROM conversations"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("id"), F.get(F.array(*map(F.lit, _VOTES)), F.pmod("event_id", F.lit(len(_VOTES))).cast("int")).alias("text"))
    return events.unionByName(table(spark, sf_dir, "conversations").select((F.lit(10**12) + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("id"), "text"))


@query(_short_sql(_TALK))
def short_answers_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 on all events and conversations."""
    return _talk(spark, sf_dir).select("id", votes.short_answer(F.col("text")).alias("normalized"))


@query(_vote_sql(votes.RUSSIAN, "text", _TALK) + _FLAG_SQL)
def vote_flags_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8 on all events and conversations."""
    return _flags(_talk(spark, sf_dir), votes.RUSSIAN)


@query("""SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '-', '_') AS slug, left('custom_' || p_name || p_type, 30) AS custom_id FROM part""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, T13."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text_fn.slug(F.col("p_name")).alias("slug"), text_fn.custom_id(F.concat("p_name", "p_type")).alias("custom_id"))


@query("SELECT page_id, replace(replace(url, ':', '_'), '/', '_') AS safe_ref, length(html) AS chars FROM pages")
def safe_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12, T19."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text_fn.safe_ref(F.col("url")).alias("safe_ref"), F.char_length("html").cast("bigint").alias("chars"))


@query("SELECT CAST(page_id AS VARCHAR) AS window_ref, 'page_' || page_id AS source, length(html) AS chars FROM pages")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is one window."""
    w = document_windows(table(spark, sf_dir, "pages"), "page_id", "html")
    return w.select("window_ref", F.concat(F.lit("page_"), "source").alias("source"), F.char_length("window_text").cast("bigint").alias("chars"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), "ts", "value")


@query("""WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT x.event_id AS pos, y.event_id AS prev_pos FROM e x JOIN e y ON x.user_id = y.user_id AND y.rn < x.rn AND y.rn >= x.rn - 20
WHERE x.ts - y.ts <= INTERVAL 4 HOURS""")
def lookback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join as an equality join on buckets."""
    return threads.lookback_pairs(_events(spark, sf_dir), ["user_id"]).select("pos", "prev_pos")


@query("""WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
p AS (SELECT x.vec_id AS id, y.vec_id AS t, y.rn AS yr, round(list_cosine_similarity(x.v, y.v), 6) AS s
  FROM e x JOIN e y ON x.label = y.label AND y.rn < x.rn AND y.rn >= x.rn - 20),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, yr) AS k FROM p WHERE s > 0)
SELECT id, t AS target, s AS similarity FROM r WHERE k = 1 AND s >= 0.2""")
def lookback_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of the last 20 rows, ties to the earliest."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("embedding").cast("array<double>").alias("vec"))
    e = e.withColumn("norm", norm(F.col("vec")))
    s = F.round(cosine(F.col("vec"), F.col("prev_vec"), F.col("norm"), F.col("prev_norm")), 6)
    return threads.best_previous(threads.lookback_pairs(e, ["label"]), ["id"], "prev_id", s, 0.2)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


PAIRS = """e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id),
q AS (SELECT * FROM p WHERE s >= 0.3)"""


@query(f"WITH {PAIRS} SELECT label, a, b, round(s, 6) AS similarity FROM q")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a label over the threshold (0.3 here; 0.88 is the default)."""
    return similarity.similar_pairs(_vectors(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {PAIRS}, b AS (SELECT a AS u, b AS v FROM q UNION SELECT b, a FROM q),
r AS (SELECT u, u AS n FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.n = b.u)
SELECT u AS node, min(n) AS cluster FROM r GROUP BY u""")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive clusters of similar pairs."""
    pairs = similarity.similar_pairs(_vectors(spark, sf_dir), 0.3)
    return connected_components(pairs, "a", "b").withColumnRenamed("component", "cluster")


@query(f"""WITH {MESSAGES}, e AS (SELECT a.id, a.reply_to AS t FROM v a JOIN v b ON a.source = b.source AND a.reply_to = b.id),
c AS (SELECT id, t AS c FROM e UNION SELECT t, t FROM e)
SELECT v.source, v.id, coalesce(min(c.c), v.id) AS thread FROM v LEFT JOIN c USING (id) GROUP BY v.source, v.id""")
def thread_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, A4: threads as components of the reply graph; messages alone are threads."""
    valid = threads.valid_messages(conversation_messages(spark, sf_dir))
    members = threads.thread_members(valid, threads.reply_edges(valid))
    return members.select("source", "id", F.element_at(F.split("thread", "\x1f"), -1).cast("bigint").alias("thread"))


THREADS = f"""{MESSAGES}, t AS (
  SELECT v.*, coalesce(b.id, v.id) AS thread, length(v.text) AS chars FROM (SELECT v.*, CASE WHEN reply_to IS NOT NULL THEN reply_to END AS rt FROM v) v
  LEFT JOIN v b ON v.source = b.source AND v.rt = b.id),
h AS (SELECT source, thread, min(ts) AS start_ts, arg_min(pos, (ts, pos)) AS start_pos FROM t GROUP BY source, thread),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_ts, start_pos) - 1 AS thread_idx FROM h),
o AS (SELECT t.*, i.thread_idx, row_number() OVER (PARTITION BY t.source, t.thread ORDER BY t.ts, t.pos) AS rn FROM t JOIN i USING (source, thread))"""


@query(f"WITH {THREADS} SELECT source, thread_idx, rn, id FROM o")
def thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2, W4."""
    valid = threads.valid_messages(conversation_messages(spark, sf_dir))
    members = threads.thread_members(valid, threads.reply_edges(valid)).join(valid.select("source", "id", "pos", "ts"), ["source", "id"])
    return threads.order_threads(members).select("source", "thread_idx", "rn", "id")


def _packing_sql(rows: str, limit: int, overlap: int) -> str:
    return f"""WITH RECURSIVE d AS ({rows}),
n AS (SELECT source, doc_id, len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM d),
p AS (SELECT *, sum(len) OVER (PARTITION BY source ORDER BY rn) AS prefix, lead(len) OVER (PARTITION BY source ORDER BY rn) AS nxt FROM n),
w AS (SELECT source, rn, CAST(1 AS BIGINT) AS st FROM p WHERE rn = 1
  UNION ALL
  SELECT w.source, w.rn + 1, CASE WHEN (c.prefix - coalesce(b.prefix, 0)) + c.nxt > {limit} AND w.rn + 1 - w.st > {overlap} THEN w.rn + 1 - {overlap} ELSE w.st END
  FROM w JOIN p c ON c.source = w.source AND c.rn = w.rn LEFT JOIN p b ON b.source = w.source AND b.rn = w.st - 1 WHERE c.nxt IS NOT NULL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY st) - 1 AS window_idx, st AS first_rn, max(rn) AS last_rn FROM w GROUP BY source, st"""


@query(_packing_sql("SELECT source, doc_id, length(text) AS len FROM documents", 6000, 4))
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy windows of 6000 characters that overlap by 4."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.char_length("text").alias("chars"))
    return windows.pack_windows(number_within(d, ["source"], ["doc_id"]), ["source"])


@query(f"""WITH {THREADS}, l AS (
  SELECT o.source, o.thread_idx, o.rn, o.id, regexp_replace('[' || strftime(o.ts, '%Y-%m-%dT%H:%M:%S') || '] ' || o.author ||
    CASE WHEN b.id IS NULL THEN '' ELSE '[в ответ ' || b.author || ': "' || replace(substr(coalesce(b.text, ''), 1, 40), chr(10), ' ') || '..."]' END ||
    ': ' || o.text, '^\\s+|\\s+$', '', 'g') AS line FROM o LEFT JOIN m b ON o.source = b.source AND o.reply_to = b.id)
SELECT source, thread_idx, CAST(0 AS BIGINT) AS window_idx, 'thread_' || thread_idx || '_msg_' || arg_min(id, rn) || '_to_' || arg_max(id, rn) AS window_ref,
  count(*) AS n_messages, string_agg(line, chr(10) ORDER BY rn) AS window_text FROM l GROUP BY source, thread_idx""")
def window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reply threads, packed into windows, with their text.

    Reply threads of this table have two messages, so each is one window.
    """
    messages = conversation_messages(spark, sf_dir)
    valid = threads.valid_messages(messages)
    members = threads.thread_members(valid, threads.reply_edges(valid))
    full = valid.select("source", "id", "pos", "ts", F.char_length("text").alias("chars")).join(members, ["source", "id"])
    ordered = threads.order_threads(full)
    keys = ["source", "thread", "thread_idx"]
    placed = windows.window_members(windows.pack_windows(ordered, keys), ordered, keys)
    lines = mining.rendered(messages).select("source", "id", "line")
    return windows.window_text(placed.join(lines, ["source", "id"]), ["source"])


@query("""SELECT 'group_' || c_custkey // 100 AS source, c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_custkey // 10) AS community FROM customer""")
def louvain_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: seeded communities; tens of customers hang together closely, and each to the next loosely."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"))
    c = c.select(F.concat(F.lit("group_"), F.expr("id div 100")).alias("source"), "id", F.expr("id div 10").alias("ten"))
    others = c.select(F.col("id").alias("target"), F.col("ten").alias("near"))
    close = c.join(others, F.col("ten") == F.col("near")).where("id > target").withColumn("weight", F.lit(1.0))
    loose = c.where("id % 10 = 0 and id % 100 > 0").withColumn("target", F.col("id") - 1).withColumn("weight", F.lit(0.1))
    edges = close.select("source", "id", "target", "weight").unionByName(loose.select("source", "id", "target", "weight"))
    return communities.thread_communities(c.select("source", "id"), edges)


@query("""WITH e AS (SELECT label, vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN vec_id - 40 END AS reply_to, CAST(embedding AS DOUBLE[]) AS v,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
r AS (SELECT x.label, x.id, y.id AS target, CAST(15.0 AS DOUBLE) AS weight FROM e x JOIN e y ON x.label = y.label AND x.reply_to = y.id),
p AS (SELECT x.label, x.id, y.id AS target, y.rn AS yr, list_cosine_similarity(x.v, y.v) AS s FROM e x JOIN e y ON x.label = y.label AND y.rn < x.rn AND y.rn >= x.rn - 20
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.label = x.label AND r.id = x.id)),
b AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY s DESC, yr) AS k FROM p WHERE s > 0),
a AS (SELECT label, id, target, weight FROM r UNION ALL SELECT label, id, target, s FROM b WHERE k = 1 AND s >= 0.25),
l AS (SELECT *, row_number() OVER (PARTITION BY label, least(id, target), greatest(id, target) ORDER BY id DESC) AS k FROM a)
SELECT label AS source, id, target, round(weight, 6) AS weight FROM l WHERE k = 1""")
def thread_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply edges hide the similarity of their message; others have their best look-back edge."""
    e = table(spark, sf_dir, "embeddings")
    m = e.select(
        F.col("label").alias("source"),
        F.col("vec_id").alias("pos"),
        F.col("vec_id").alias("id"),
        F.timestamp_seconds(F.lit(0)).alias("ts"),
        F.when(F.col("vec_id") % 4 == 0, F.col("vec_id") - 40).alias("reply_to_message_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    return threads.thread_edges(m, least=0.25).select("source", "id", "target", F.round("weight", 6).alias("weight"))


@query("""WITH o AS (SELECT label, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT * FROM o UNION ALL SELECT label, id + 1000000000, list_transform(range(1, len(v) + 1), lambda i: v[i] + 0.15 * v[i % len(v) + 1]) FROM o),
p AS (SELECT x.label, x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM e x JOIN e y ON x.label = y.label AND x.id < y.id)
SELECT label, a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.88""")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 by sign hashes: all vectors and a blurred copy of each (cosines of about 0.99, which no band misses)."""
    e = _vectors(spark, sf_dir)
    blurred = F.transform("vec", lambda x, i: x + 0.15 * F.element_at("vec", ((i + 1) % F.size("vec") + 1).cast("int")))
    both = e.unionByName(e.select("label", (F.col("id") + 1_000_000_000).alias("id"), blurred.alias("vec")))
    return similarity.lsh_pairs(both).withColumn("similarity", F.round("similarity", 6))


_TALKED = ("we store it in PostgreSQL", "MySQL and Redis, please", "the screen needs JWT", "я за React, да", "nothing to add")


def customer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message a customer, a source a market segment; every seventh answers the one seven before."""
    key = F.col("c_custkey").cast("bigint")
    said = F.get(F.array(*map(F.lit, _TALKED)), (key % len(_TALKED)).cast("int"))
    ts = F.timestamp_seconds(key * 60)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("segment_"), "c_mktsegment").alias("source"),
        key.alias("pos"),
        key.alias("id"),
        F.lit("message").alias("type"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("from"),
        F.lit(None).cast("string").alias("author"),
        F.concat(said, F.lit(" "), F.col("c_name")).alias("text"),
        F.when(key % 7 == 0, key - 7).alias("reply_to_message_id"),
        ts.alias("ts"),
    )


@query()
def provider_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 to L5 with the rule provider, on the threads of what all customers say."""
    from quillgraph.functions.providers import Rules

    mined = mining.mine_parallel(mining.chat_windows(customer_messages(spark, sf_dir)), Rules())
    return mined.select("source", "window_ref", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))
