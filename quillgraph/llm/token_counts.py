"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie end to end in one symbol array. In each round every sequence
finds its lowest-ranked adjacent pair and all sequences merge theirs at once; what is left
of a sequence when no pair of it has a rank is its count of tokens. No ids are kept.

Only pre-tokens not seen lately are merged: a bounded table in each Python worker holds
the counts of the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from quillgraph.llm import _shared

#: The pre-token pattern of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters whose classes may differ between versions of Unicode.
BEYOND = re.compile("[\u0530-\U0010ffff]")

#: Pre-tokens remembered by a worker before the table starts afresh.
REMEMBERED = 600_000

_SLOT_BITS = 21

_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: bytes that print stand for themselves, the
    others follow from U+0100 on in byte order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, after = {}, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], after = chr(after), after + 1
    return out


@lru_cache(maxsize=1)
def plain_pattern() -> re.Pattern:
    """PATTERN for texts without BEYOND characters, its classes written out as ranges for
    the faster engine of the standard library."""
    below = [chr(c) for c in range(0x530)]

    def ranges(kind: str) -> str:
        test, out = regex.compile(kind).match, []
        for c in filter(test, below):
            if out and ord(c) == ord(out[-1][1]) + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in out)

    letter, number, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def slots(keys: np.ndarray, odd: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - _SLOT_BITS)


def pair_tables(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Hash tables from pair key to rank; a key whose slot is taken goes to the next one.

    A slot names a rank and the caller compares the key, so free slots may name rank 0.
    """
    out, odd, left = [], 0x9E3779B97F4A7C15, np.arange(len(keys))
    while len(left):
        table = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        at = slots(keys[left], odd)
        table[at[::-1]] = left[::-1]
        out.append((odd, table))
        left = left[table[at] != left]
        odd = (odd * 0xD1342543DE82EF95 | 1) % (1 << 64)
    return out


class RankMerger:
    """Counts of tokens by the merges of a byte-level BPE vocabulary file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.width + right
        self.keys, self.made = keys, made
        self.tables = pair_tables(keys)
        # A pair ranked before the merge that makes one of its halves would have to go
        # first in between; then a round may merge the leftmost place only.
        born = np.full(self.width, -1, dtype=np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        self.single = bool((np.maximum(born[left], born[right]) > np.arange(len(made))).any())
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pattern = plain_pattern().findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens. Unicode versions disagree on some characters beyond the first
        blocks, so the library itself splits texts that hold any."""
        if BEYOND.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern(text)

    def rank(self, pair: np.ndarray) -> np.ndarray:
        out = np.full(len(pair), _NONE, dtype=np.int32)
        for odd, table in self.tables:
            at = table[slots(pair, odd)]
            same = self.keys[at] == pair
            out[same] = at[same]
        return out

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte string."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        alive = np.nonzero(lengths)[0]
        lengths = lengths[alive]
        while len(alive):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ranks = np.full(len(symbols), _NONE, dtype=np.int32)
            ranks[:-1] = self.rank(symbols[:-1] * self.width + symbols[1:])
            ranks[starts + lengths - 1] = _NONE
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != _NONE
            counts[alive[~going]] = lengths[~going]
            if not going.all():
                keep = np.repeat(going, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                alive, lengths, lowest = alive[going], lengths[going], lowest[going]
                if not len(alive):
                    break
            owner = np.repeat(np.arange(len(alive)), lengths)
            hits = np.nonzero(ranks == lowest[owner])[0]
            if self.single:
                hits = hits[np.unique(owner[hits], return_index=True)[1]]
            else:
                # Of overlapping places (a run of one symbol) every second one merges.
                fresh = np.concatenate(([True], np.diff(hits) != 1))
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
            symbols[hits] = self.made[lowest[owner[hits]]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hits + 1] = False
            symbols = symbols[stay]
            lengths = lengths - np.bincount(owner[hits], minlength=len(alive))
        return counts

    def count(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text; an added token's string inside a text is one token."""
        split, out = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            split.append((len(parts) - 1, [t for part in parts for t in self.split(part)]))
        new = list({t for _, tokens in split for t in tokens}.difference(self.known))
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list({t for _, tokens in split for t in tokens})
            self.known.update(zip(new, self.merge_counts([t.encode() for t in new]).tolist(), strict=True))
        for extra, tokens in split:
            out.append(extra + sum(map(self.known.__getitem__, tokens)))
        return out


def merger(path: str) -> RankMerger:
    return _shared.worker_table("token_counts", (path,), lambda: RankMerger(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row a document.

    A NULL text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated; columns of
    the input other than ``doc_id`` and ``text`` are ignored, whatever their names; a NULL
    doc_id stays NULL. An empty table gives an empty result. A text is never cut; a table
    of remembered pre-tokens is bounded by REMEMBERED plus those of one slice of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for a, b in _shared.by_bytes(texts):
                counts += count(texts[a:b])
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    _shared.set_batches(docs.sparkSession)
    narrow = docs.select(_shared.column_or_null(docs, "doc_id", "long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
