"""Model-backed steps behind a replaceable provider.

A provider is a picklable callable ``(step, prompt, data) -> JSON text or plain text``, which threads
may call at the same time. Calls run in Arrow batches on the executors with retries, several at once, and
once for equal prompts; a call that keeps failing gives NULL. Results are written at once, so that
a later recomputation doesn't repeat the calls.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.votes import RUSSIAN, VoteLexicon
from quillgraph.session import batches_of, cut_lineage

Provider = Callable[[str, str, str], str]


@dataclass(frozen=True)
class Retry:
    # Attempts, first and longest pause of a provider call.
    attempts: int = 12
    first_delay: float = 4.0
    longest_delay: float = 120.0

    def call(self, provider: Provider, step: str, prompt: str, data: str) -> str | None:
        delay = self.first_delay
        for attempt in range(self.attempts):
            try:
                return provider(step, prompt, data)
            except Exception:
                if attempt + 1 < self.attempts:
                    time.sleep(delay)
                    delay = min(2 * delay, self.longest_delay)
        return None


#: Calls that one task has in flight at once.
IN_FLIGHT = 8
#: Prompts that a task holds at once, with their answers.
BATCH = 256


def call(
    df: DataFrame,
    provider: Provider,
    step: str,
    prompt: str = "prompt",
    data: str = "data",
    out: str = "response",
    retry: Retry = Retry(),
    concurrency: int | None = None,
    in_flight: int = IN_FLIGHT,
    answers: str | None = None,
) -> DataFrame:
    """Adds ``out``: the provider's answer to each row; rows with equal prompt and data share one call.

    ``concurrency`` bounds the tasks that call at once and ``in_flight`` the calls that a task has open (together
    a rate limit). ``answers`` names a folder of answers by the hash of step, prompt and data, shared by runs: what
    it has isn't asked again, and what is asked now is added; a call that failed (NULL) is asked again next time.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws("\x1e", F.lit(step), F.char_length(text(prompt)).cast("string"), text(prompt), text(data)), 256)
    keyed = cut_lineage(df.withColumn("_key", key))
    asked = keyed.groupBy("_key").agg(F.first(text(prompt)).alias("prompt"), F.first(text(data)).alias("data"))
    known = None
    if answers is not None and _exists(df, answers):
        known = df.sparkSession.read.schema("_key string, answer string").parquet(answers).where("answer is not null").groupBy("_key").agg(F.min("answer").alias("answer"))
        asked = asked.join(known.hint("merge"), "_key", "left_anti")
    if concurrency is not None:
        asked = asked.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                found = pool.map(lambda row: retry.call(provider, step, *row), zip(batch["prompt"], batch["data"], strict=True))
                yield pd.DataFrame({"_key": batch["_key"], "answer": pd.Series(list(found), index=batch.index, dtype=object)})

    with batches_of(df.sparkSession, BATCH):
        fresh = cut_lineage(asked.select("_key", "prompt", "data").mapInPandas(run, "_key string, answer string"))
    if answers is not None:
        fresh.write.mode("append").parquet(answers)
    found = fresh if known is None else fresh.unionByName(known)
    # Answers are much alike, so their files are small; as a broadcast all would be held by the driver at once.
    return keyed.join(found.withColumnRenamed("answer", out).hint("merge"), "_key", "left").select(*df.columns, out)


def _exists(df: DataFrame, path: str) -> bool:
    try:
        return bool(df.sparkSession.read.schema("_key string").parquet(path).inputFiles())
    except AnalysisException:
        return False


def parsed(df: DataFrame, schema: str, column: str = "response", out: str = "value") -> DataFrame:
    return df.withColumn(out, F.from_json(column, schema)).drop(column)


@dataclass
class Replay:
    """Recorded answers by (step, data); anything else is an error."""

    recorded: dict[tuple[str, str], str]

    def __call__(self, step: str, prompt: str, data: str) -> str:
        return self.recorded[step, data]


@dataclass
class Remote:
    """A service: ``send`` posts a prompt and returns text; made once in each worker."""

    connect: Callable[[], Callable[[str, float], str]]
    temperatures: dict[str, float] = field(default_factory=lambda: {"section": 0.2})
    default_temperature: float = 0.3

    def __call__(self, step: str, prompt: str, data: str) -> str:
        send = self.__dict__.get("_send")
        if send is None:
            send = self.__dict__["_send"] = self.connect()
        text = f"{prompt}\n\nDATA:\n{data}" if data else prompt
        return send(text, self.temperatures.get(step, self.default_temperature))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_send"}


#: Words that the rules know, with their labels.
DICTIONARY = {
    "PostgreSQL": "Component", "MySQL": "Component", "MongoDB": "Component", "Redis": "Component", "Docker": "Component",
    "systemd": "Component", "React": "Component", "Vue": "Component", "JWT": "Concept", "Stripe": "Component",
    "YooKassa": "Component", "экран входа": "Requirement", "форма входа": "Requirement", "авторизация": "Concept", "деплой": "Task",
}
#: Technologies that exclude each other in a role.
ROLES = {
    "primary database": ("postgresql", "mysql", "mongodb"),
    "frontend framework": ("react", "vue"),
    "payment gateway": ("stripe", "yookassa"),
    "process manager": ("docker", "systemd"),
}
INTERFACE_WORDS = ("экран", "форма", "screen", "form", "button", "ui")
_LINE = re.compile(r"^\[[^\]]*\] ([^:\[]+)((?:\[[^\]]*\])*): ?(.*)$")


@dataclass
class Rules:
    """A deterministic stand-in for every step, from word lists."""

    dictionary: dict[str, str] = field(default_factory=lambda: dict(DICTIONARY))
    roles: dict[str, Sequence[str]] = field(default_factory=lambda: dict(ROLES))
    lexicon: VoteLexicon = RUSSIAN

    def slug(self, name: str) -> str:
        return name.lower().replace(" ", "_").replace("-", "_")

    def found(self, text: str) -> list[tuple[str, str]]:
        low = text.lower()
        # A plain search goes first: most texts hold few of the words.
        return [(name, label) for name, label in self.dictionary.items() if (word := name.lower()) in low and re.search(rf"(?<!\w){re.escape(word)}(?!\w)", low)]

    def lines(self, text: str) -> list[tuple[str, str, str]]:
        return [(m[1].strip(), m[2], m[3]) for line in text.split("\n") if (m := _LINE.match(line))]

    def __call__(self, step: str, prompt: str, data: str) -> str:
        return getattr(self, f"do_{step}")(data)

    def do_entities(self, data: str) -> str:
        people = dict.fromkeys(who for who, _, _ in self.lines(data))
        rows = [{"name": p, "label": "Person", "description": ""} for p in people]
        rows += [{"name": n, "label": label, "description": f"упоминается как {n}"} for n, label in self.found(data)]
        return json.dumps({"entities": rows}, ensure_ascii=False)

    def do_link(self, data: str) -> str:
        entity, glossary = json.loads(data)
        known = self.slug(entity) in glossary
        return json.dumps({"is_duplicate": known, "target_global_id": self.slug(entity) if known else None, "new_id": None})

    def do_graph(self, data: str) -> str:
        entities = json.loads(self.do_entities(data))["entities"]
        nodes = [{"id": self.slug(e["name"]), "label": e["label"], "name": e["name"], "description": e["description"], "properties": [], "target_section": "uncategorized"} for e in entities]
        edges, last = [], None
        for who, flags, text in self.lines(data):
            ids = [self.slug(n) for n, label in self.found(text) if label != "Person"]
            vote = re.search(r"\[VOTE_(FOR|AGAINST):([^\]]*)\]", flags)
            last = ids[0] if ids else last
            for i in ids:
                edges.append({"source": self.slug(who), "target": i, "relation": "MENTIONS", "evidence": text})
            if vote and (target := next((i for i in ids if i in self.slug(vote[2])), last if vote[2] == "LAST_MENTIONED" else None)):
                edges.append({"source": self.slug(who), "target": target, "relation": f"VOTED_{vote[1]}", "evidence": text})
        present = {n["id"] for n in nodes}
        for role, members in self.roles.items():
            if options := [m for m in members if m in present]:
                decision = f"decision_{self.slug(role)}"
                nodes.append({"id": decision, "label": "Decision", "name": role, "description": f"выбор: {role}", "properties": [], "target_section": "uncategorized"})
                edges += [{"source": decision, "target": o, "relation": "RELATES_TO", "evidence": "одна роль"} for o in options]
        return json.dumps({"summary": "", "nodes": nodes, "edges": edges, "source_ref": ""}, ensure_ascii=False)

    def do_critique(self, data: str) -> str:
        return json.dumps({"fixes": []})

    def do_memory(self, data: str) -> str:
        graph = json.loads(data)
        return json.dumps({"key_entities": sorted({n["id"] for n in graph["nodes"]}), "open_decisions": [], "resolved_decisions": [], "last_mentioned": {}})

    def do_cluster(self, data: str) -> str:
        rows = json.loads(data)
        best = min(rows, key=lambda r: (len(r["id"]), r["seq"]))
        action = {"is_duplicate": True, "ids_to_merge": [r["id"] for r in rows], "unified_id": best["id"], "unified_name": best["name"], "unified_desc": best["description"]}
        return json.dumps({"actions": [action]}, ensure_ascii=False)

    def do_conflicts(self, data: str) -> str:
        ids = {m[1]: m[2] for line in data.split("\n") if (m := re.match(r"ID: (\S+) \| ([^|]*?) \|", line))}
        out = []
        for role, members in self.roles.items():
            if len(options := [m for m in members if m in ids]) >= 2:
                choices = [{"id": o, "text": ids[o], "evidence": ""} for o in options]
                out.append({"id": f"conflict_{self.slug(role)}", "category": role, "description": f"{role}: " + ", ".join(ids[o] for o in options), "options": choices, "ai_recommendation": ids[options[0]]})
        return json.dumps({"conflicts": out}, ensure_ascii=False)

    def do_sections(self, data: str) -> str:
        out = []
        for row in json.loads(data):
            text = f"{row['id']} {row['name']}".lower()
            if any(w in text for w in INTERFACE_WORDS):
                section = "ui_ux"
            else:
                section = {"Requirement": "functional_req", "Component": "tech_stack", "Decision": "tech_stack"}.get(row["label"], "general_info")
            out.append({"node_id": row["id"], "target_section": section})
        return json.dumps({"assignments": out})

    def do_section(self, data: str) -> str:
        return data
