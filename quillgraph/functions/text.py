"""Scalar text functions as column expressions (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a quoted reply, of a custom id; the frame of a quoted reply.
REPLY_SNIPPET = 40
CUSTOM_ID_CHARS = 30
REPLY_FRAME = ('[в ответ ', ': "', '..."]')


def strip(text: Column) -> Column:
    """Trim every kind of white space; ``trim`` would leave line ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def embedding_text(text: Column) -> Column:
    """The stripped text, or the word ``empty`` where nothing is left."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit("empty"))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with or without zone (``Z`` included); NULL where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def rich_text(text: Column) -> Column:
    """Plain text of a message body: a string as it is; a JSON list of strings and of objects
    with ``text`` is joined; other JSON containers give an empty string."""
    variant = F.try_parse_json(text)
    kind = F.schema_of_variant(variant)
    parts = F.from_json(text, "array<string>")
    plain = F.transform(parts, lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    return (
        F.when(text.isNull(), F.lit(""))
        .when(variant.isNull() | ~text.rlike(r"^\s*[\[{]"), text)
        .when(kind.startswith("ARRAY"), F.array_join(plain, "", ""))
        .otherwise(F.lit(""))
    )


def slug(name: Column) -> Column:
    """Lower case, spaces and hyphens to underscores, nothing else."""
    return F.translate(F.lower(name), " -", "__")


def safe_ref(ref: Column) -> Column:
    return F.translate(ref, ":/", "__")


def custom_id(conflict_id: Column) -> Column:
    return F.substring(F.concat(F.lit("custom_"), conflict_id), 1, CUSTOM_ID_CHARS)


def window_ref(thread: Column, first_id: Column, last_id: Column) -> Column:
    return F.concat(F.lit("thread_"), thread.cast("string"), F.lit("_msg_"), first_id.cast("string"), F.lit("_to_"), last_id.cast("string"))


def glossary_line(node_id: Column, label: Column, name: Column) -> Column:
    return F.concat(F.lit("- "), node_id, F.lit(" ("), label, F.lit("): "), name)


def node_line(node_id: Column, name: Column, description: Column) -> Column:
    return F.concat(F.lit("ID: "), node_id, F.lit(" | "), name, F.lit(" | "), description)


def section_line(node_id: Column, name: Column) -> Column:
    return F.concat(F.lit("ID:"), node_id, F.lit(" | "), name)


def fact_line(node_id: Column, name: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(" (ID: "), node_id, F.lit("): "), F.coalesce(description, F.lit("")))


def dedup_text(name: Column, description: Column) -> Column:
    return strip(F.concat_ws(" ", name, description))


def prompt_with_data(prompt: Column, data: Column, separator: str = "\n\nDATA:\n") -> Column:
    return F.when(F.coalesce(data, F.lit("")) == "", prompt).otherwise(F.concat(prompt, F.lit(separator), data))


def reply_snippet(author: Column, text: Column, frame: tuple[str, str, str] = REPLY_FRAME) -> Column:
    """The first 40 characters of the message answered, line ends as spaces."""
    snippet = F.replace(F.substring(text, 1, REPLY_SNIPPET), F.lit("\n"), F.lit(" "))
    a, b, c = frame
    return F.concat(F.lit(a), F.coalesce(author, F.lit("Unknown")), F.lit(b), snippet, F.lit(c))


def chat_line(date: Column, sender: Column, author: Column, reply: Column, vote: Column, text: Column) -> Column:
    """``[date] author[reply][vote]: text``."""
    who = F.coalesce(sender, author, F.lit("Unknown"))
    none = F.lit("")
    line = F.concat(F.lit("["), F.coalesce(date, F.lit("Unknown Date")), F.lit("] "), who, F.coalesce(reply, none), F.coalesce(vote, none), F.lit(": "), F.coalesce(text, none))
    return strip(line)
