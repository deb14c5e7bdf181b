"""Sources: chat exports, whole documents, fixtures and the source envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as text_fn


def describe_sources(spark: SparkSession, rows: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """(source_type, file_name, metadata) descriptors; unknown types raise."""
    bad = {t for t, *_ in rows} - set(schemas.SOURCE_TYPES)
    if bad:
        raise ValueError(f"unknown source types: {sorted(bad)}")
    return spark.createDataFrame(rows, "source_type string, file_name string, metadata map<string,string>")


def with_times(messages: DataFrame) -> DataFrame:
    """Adds ``ts``; a date that can't be read is NULL (it sorts last and links to nothing)."""
    return messages.withColumn("ts", text_fn.parse_timestamp(F.col("date")))


def read_chat_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Messages of a JSON-lines chat export. Rich text (lists) is flattened; fields that are
    absent are NULL; malformed lines are dropped, so one bad line loses nothing else."""
    fields = "id bigint, type string, date string, `from` string, author string, text string, reply_to_message_id bigint, _bad string"
    raw = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    order = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    kept = raw.withColumn("_o", order).where("_bad is null")
    from quillgraph.operators.ranges import global_number

    placed = global_number(kept.withColumn("_f", F.col("_o.col1")).withColumn("_i", F.col("_o.col2")).drop("_o", "_bad"), ["_f", "_i"], "pos")
    out = placed.withColumn("text", text_fn.rich_text(F.col("text"))).withColumn("source", F.lit(source))
    return with_times(out.select("source", "pos", "id", "type", "date", "from", "author", "text", "reply_to_message_id"))


def create_messages(spark: SparkSession, rows: list[tuple], source: str) -> DataFrame:
    """Messages from (id, author, text, date, reply_to) tuples, in list order."""
    full = [(source, pos, i, "message", date, author, None, text, reply) for pos, (i, author, text, date, reply) in enumerate(rows)]
    return with_times(spark.createDataFrame(full, schemas.MESSAGE))


# Sample conversations of two teams, at fixed times.
BACKEND_CHAT = [
    (1, "Анна", "Коллеги, выбираем базу данных. Предлагаю PostgreSQL.", "2024-01-01T00:00:00", None),
    (2, "Борис", "Поддерживаю PostgreSQL", "2024-01-01T00:02:00", 1),
    (3, "Анна", "Авторизация пойдёт через JWT, таблица users уже описана.", "2024-01-01T00:05:00", None),
    (4, "Вера", "Деплой сервиса делаем через Docker.", "2024-01-01T03:00:00", None),
    (5, "Борис", "Против Docker, хватит systemd", "2024-01-01T03:10:00", None),
    (6, "Анна", "Ок!", "2024-01-01T03:12:00", None),
]
FRONTEND_CHAT = [
    (101, "Галина", "Экран входа рисуем на React?", "2024-01-02T00:00:00", None),
    (102, "Денис", "Я за React, да", "2024-01-02T00:05:00", 101),
    (103, "Галина", "Тогда форма входа обращается к JWT.", "2024-01-02T00:07:00", None),
    (104, "Денис", "Для платежей берём Stripe.", "2024-01-02T05:00:00", None),
    (105, "Борис", "Stripe не работает с рублями, нужен YooKassa.", "2024-01-02T05:20:00", None),
    (106, "Денис", "Голосую за YooKassa", "2024-01-02T05:22:00", None),
    (107, "Галина", "Согласен", "2024-01-02T05:25:00", None),
]


def sample_chats(spark: SparkSession) -> DataFrame:
    return create_messages(spark, BACKEND_CHAT, "chat_backend_team").unionByName(create_messages(spark, FRONTEND_CHAT, "chat_frontend_team"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as windows: (source, window_ref, window_text); one window a file."""
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return raw.select("source", F.col("source").alias("window_ref"), F.col("value").alias("window_text"))


def document_windows(docs: DataFrame, ref: str, text: str) -> DataFrame:
    """Rows of a table as one window each."""
    name = F.col(ref).cast("string")
    return docs.select(name.alias("source"), name.alias("window_ref"), F.col(text).alias("window_text"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files as written by the sink: key declarations name the
    attributes; each file is parsed in its own task."""
    raw = spark.read.text(path, wholetext=True)

    def parse(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for batch in batches:
            out = []
            for value in batch["value"]:
                root = ET.fromstring(value)
                strip = lambda tag: tag.rpartition("}")[2]
                keys = {k.get("id"): k.get("attr.name") for k in root.iter() if strip(k.tag) == "key"}
                for seq, e in enumerate(x for x in root.iter() if strip(x.tag) in ("node", "edge")):
                    data = {keys.get(d.get("key"), d.get("key")): d.text for d in e}
                    out.append((strip(e.tag), e.get("id"), e.get("source"), e.get("target"), data, seq))
            yield pd.DataFrame(out, columns=["kind", "id", "source", "target", "data", "seq"])

    rows = raw.mapInPandas(parse, "kind string, id string, source string, target string, data map<string,string>, seq bigint")
    take = lambda *names: [F.col("data")[n].alias(n) for n in names]
    nodes = rows.where("kind = 'node'").select("id", *take("label", "name", "description", "target_section"), "seq")
    edges = rows.where("kind = 'edge'").select("source", "target", *take("relation", "evidence"), "seq")
    return nodes, edges


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as messages: a conversation is a source, odd turns answer
    the turn before, a turn comes a minute after another."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    msg_id = F.col("conv_id") * 1000 + F.col("turn")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    return c.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source"),
        F.col("turn").cast("bigint").alias("pos"),
        msg_id.cast("bigint").alias("id"),
        F.lit("message").alias("type"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("role").alias("from"),
        F.lit(None).cast("string").alias("author"),
        "text",
        F.when(F.col("turn") % 2 == 1, (msg_id - 1).cast("bigint")).alias("reply_to_message_id"),
        ts.alias("ts"),
    )
