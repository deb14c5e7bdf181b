"""Vote detection in text by a table of patterns and word lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import strip

#: What a vote may name. \p{L} and \p{N} read the same in Java and RE2, unlike \w.
TARGET = r"([\p{L}\p{N}_\s+#.]+)"


@dataclass(frozen=True)
class VoteLexicon:
    """Patterns are tried in order, those for before those against; the words of an answer
    that is nothing else come last."""

    for_patterns: tuple[str, ...]
    against_patterns: tuple[str, ...]
    confirmations: tuple[str, ...]
    rejections: tuple[str, ...]


# Wording by which messages vote.
RUSSIAN = VoteLexicon(
    for_patterns=(r"(?:я\s+)?за\s+", r"голосую\s+за\s+", r"поддерживаю\s+", r"тоже\s+за\s+"),
    against_patterns=(r"(?:я\s+)?против\s+", r"не\s+хочу\s+"),
    confirmations=("ок", "да", "давайте", "плюс", "+", "ага", "согласен", "добро", "принято", "хорошо"),
    rejections=("не", "нет", "не надо", "минус", "-", "отмена", "против", "не согласен"),
)
ENGLISH = VoteLexicon(
    for_patterns=(r"(?:i\s+)?vote\s+for\s+", r"i\s+support\s+", r"in\s+favou?r\s+of\s+"),
    against_patterns=(r"(?:i\s+)?vote\s+against\s+", r"do\s+not\s+want\s+"),
    confirmations=("ok", "yes", "agreed", "+", "fine"),
    rejections=("no", "not", "-", "never", "disagree"),
)


def _answer(text: Column) -> Column:
    return F.regexp_replace(strip(F.lower(text)), r"^[,.!?:]+|[,.!?:]+$", "")


def short_answer(text: Column, lexicon: VoteLexicon = RUSSIAN) -> Column:
    """A flag for a message that is only a yes or a no, else the text; NULL gives ''."""
    return (
        F.when(text.isNull(), F.lit(""))
        .when(_answer(text).isin(*lexicon.confirmations), F.lit("[FLAG: CONFIRMATION]"))
        .when(_answer(text).isin(*lexicon.rejections), F.lit("[FLAG: REJECTION]"))
        .otherwise(text)
    )


def detect_vote(text: Column, lexicon: VoteLexicon = RUSSIAN) -> Column:
    """struct<direction,target>: the first pattern found anywhere in the text wins."""
    low = strip(F.lower(text))
    chain = None

    def add(chain, condition, direction, target):
        value = F.struct(F.lit(direction).alias("direction"), target.alias("target"))
        return F.when(condition, value) if chain is None else chain.when(condition, value)

    for direction, patterns in (("for", lexicon.for_patterns), ("against", lexicon.against_patterns)):
        for p in patterns:
            chain = add(chain, low.rlike(p + TARGET), direction, strip(F.regexp_extract(low, p + TARGET, 1)))
    none = F.lit(None).cast("string")
    chain = add(chain, _answer(text).isin(*lexicon.confirmations), "for", none)
    chain = add(chain, _answer(text).isin(*lexicon.rejections), "against", none)
    return chain.otherwise(F.struct(none.alias("direction"), none.alias("target")))


def vote_flag(vote: Column) -> Column:
    """``[VOTE_FOR:target]``; an answer without target refers to what was mentioned last."""
    target = F.coalesce(F.nullif(vote["target"], F.lit("")), F.lit("LAST_MENTIONED"))
    return F.when(vote["direction"].isNotNull(), F.concat(F.lit("[VOTE_"), F.upper(vote["direction"]), F.lit(":"), target, F.lit("]")))
