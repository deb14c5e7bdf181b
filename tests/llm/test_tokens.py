"""Operators 1, 5 and 9 against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken
from tokenizers import Tokenizer

from quillgraph.llm import bpe_codec, packing, token_counts

COUNTS, RANKS, WORDS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(n, seed, alphabet="ab \n\té1'sßΣ　<|endoftext|>\x1f\x85中🎉İ"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pattern_is_the_published_one():
    assert token_counts.PATTERN == P.PATTERN


def test_counts_of_strange_texts():
    own, library = token_counts.RankMerger(COUNTS), Tokenizer.from_file(COUNTS)
    texts = strange(1500, 1) + ["", "a" * 999, "ab" * 3000, "<|endoftext|>" * 3, " \n\n  x  \n", "ՠ 𐥀 x"]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_leftmost_only_mode_counts_the_same():
    own, library = token_counts.RankMerger(COUNTS), Tokenizer.from_file(COUNTS)
    own.single = True
    texts = strange(300, 9) + ["aaaa bbbb" * 20]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op1(spark, sf_dir, texts):
    library = Tokenizer.from_file(COUNTS)
    got = {r.doc_id: r for r in token_counts.query(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_op1_corner_cases(odd_docs, no_docs):
    library = Tokenizer.from_file(COUNTS)
    want = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(odd_docs, COUNTS).collect()) == want
    assert token_counts.count_tokens(no_docs, COUNTS).collect() == []


def test_tree_equals_library(tik):
    own = bpe_codec.TreeCodec(RANKS, P.PATTERN)
    texts = strange(800, 2) + ["a" * 10001, "=" * 7777, " " * 5000 + "x", "ab" * 4001, "na" * 999 + "n", "thetion" * 300]
    rng = random.Random(3)
    texts += ["".join(rng.choice(rng.choice(["ab", "aaab", "é中a", "=-", "0123456789"])) for _ in range(rng.choice([60, 200, 1000]))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tik.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_pre_tokens_are_joined_up_the_tree(texts, tik, monkeypatch):
    """Of the documents' distinct pre-tokens that are no token, nearly all come from joins."""
    own, joined, join = bpe_codec.TreeCodec(RANKS, P.PATTERN), [0], bpe_codec.TreeCodec.join

    def counting(self, left, right):
        joined[0] += 1
        return join(self, left, right)

    monkeypatch.setattr(bpe_codec.TreeCodec, "join", counting)
    distinct = sorted({t for x in texts.values() for t in own.split(x or "")})
    through = 0
    for t in distinct:
        before = joined[0]
        assert own.piece(t.encode()) == tik.encode_ordinary(t)
        through += joined[0] > before
    longer = sum(t.encode() not in own.ranks for t in distinct)
    assert longer > 1000 and through > 0.9 * longer


def test_join_is_associative():
    own = bpe_codec.TreeCodec(RANKS, P.PATTERN)
    data = ("inthethetionerre" * 20).encode()
    whole = own.leaf(data)
    for a, b in ((3, 100), (50, 51), (1, 319)):
        x, y, z = own.leaf(data[:a]), own.leaf(data[a:b]), own.leaf(data[b:])
        assert own.join(own.join(x, y), z) == own.join(x, own.join(y, z)) == whole


def test_op5(spark, sf_dir, texts, tik):
    for r in bpe_codec.query(spark, sf_dir).collect():
        t = texts[r.doc_id] or ""
        ids = tik.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op5_corner_cases(odd_docs, no_docs, tik):
    got = bpe_codec.encode_documents(odd_docs, RANKS, P.PATTERN, keep_ids=True).collect()
    want = sorted((str(r.doc_id), tik.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert bpe_codec.encode_documents(no_docs, RANKS, P.PATTERN).collect() == []


def test_word_ids_equal_library():
    own, library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for t in strange(1500, 4, "aB'sStTlL 1²éİßß\nͅΣσ<|endoftext|>!,.\x85\x1c "):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def check_packing(rows, docs, capacity):
    library, by_doc, bins = Tokenizer.from_file(WORDS), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in docs:
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, len(part)) == (k, at, r.length) and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_words_of_every_low_character():
    """Alone, between letters and doubled; some leave the fast range when lower-cased."""
    own, library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for c in map(chr, range(0x300)):
        for t in (c, f"a{c}b", f"A{c}{c} {c}1", f"x {c}'s"):
            assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_codec_keeps_to_the_pattern_given(tik):
    own = bpe_codec.TreeCodec(RANKS, r"\S+|\s+")
    enc = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=tik._mergeable_ranks, special_tokens={})
    for t in strange(200, 6):
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == enc.encode_ordinary(t)


def test_op9(spark, sf_dir, texts):
    n, least = check_packing(packing.query(spark, sf_dir).collect(), texts.items(), 4096)
    assert n <= least * 1.02 + 1


def test_op9_corner_cases(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORDS, capacity=300).collect()
    assert sum(r.length == 1 for r in rows) == 4  # two NULL texts, an empty one and white space
    assert len([r for r in rows if r.doc_id == 1]) == 2
    distinct = odd_docs.where("doc_id > 1")
    check_packing(packing.pack(distinct, WORDS, capacity=300).collect(), [(r.doc_id, r.text) for r in distinct.collect()], 300)
    assert packing.pack(no_docs, WORDS).collect() == []


def test_equal_rows_share_no_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 100)
    copies = spark.range(0, 1000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text, many rows").alias("text"))
    sizes = packing.pack(copies, WORDS).groupBy(F.col("sequence_id").bitwiseAND(F.lit(-1 << 40)).alias("g")).count().collect()
    assert len(sizes) == 10 and sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 200, 3000)
    bins, offsets = packing.best_two_fit(lengths, 256)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 256 and len(fill) <= -(-lengths.sum() // 256) * 1.01 + 1
    assert (offsets + lengths <= 256).all()


def test_two_replace_the_smallest():
    # Greedy: 6 + 3 leaves 1. 3 gives way to 2 + 2, which fill the gap of 4.
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]
