"""Text embeddings: a deterministic offline default and a provider-backed variant."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.providers import Retry
from quillgraph.session import cut_lineage

BATCH = 20


def hashed_embeddings(rows: DataFrame, text: str = "embed_text", out: str = "vec", width: int = 256) -> DataFrame:
    """Unit vectors of hashed word counts, in JVM transformers: no model and no network."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True).transform(rows.withColumn(text, F.coalesce(text, F.lit(""))))
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_unit")


#: Attempts, first and longest pause of an embedding batch.
EMBED_RETRY = Retry(6, 2.0, 60.0)


def provided_embeddings(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "embed_text", out: str = "vec", retry: Retry = EMBED_RETRY) -> DataFrame:
    """Vectors of a service in batches of 20; a batch that keeps failing gives NULL vectors,
    which join nothing. Checkpointed at once, so that no later step calls again."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors: list = []
            for a in range(0, len(batch), BATCH):
                part = batch[text].iloc[a : a + BATCH].tolist()
                found = retry.call(lambda *_, part=part: embed(part), "embed", "", "")
                vectors += [None] * len(part) if found is None else list(found)
            yield batch.assign(**{out: pd.Series(vectors, index=batch.index, dtype=object)})

    return cut_lineage(rows.mapInPandas(run, schema))
