"""Operators 11, 12 and 13."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillgraph.llm import lexical_search, prefix_trie, substring_dedup


def same_as_sql(got, sql, sf_dir, *tables):
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def without_repeats(docs, k):
    """Brute force: [(kept text, words, words removed)] of (doc_id, text) rows in stored order."""
    words = [(t or "").encode().split() for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), [None] * len(docs)
    for i in order:
        gone = set()
        for s in range(len(words[i]) - k + 1):
            window = tuple(words[i][s : s + k])
            if window in seen:
                gone.update(range(s, s + k))
            seen.add(window)
        out[i] = (b" ".join(w for j, w in enumerate(words[i]) if j not in gone).decode(), len(words[i]), len(gone))
    return out


def removed(docs, **options):
    return [tuple(r) for r in substring_dedup.deduplicate_substrings(docs, **options).select("text", "n_words", "n_removed").collect()]


def test_op11_matches_sql(spark, sf_dir):
    same_as_sql(substring_dedup.query(spark, sf_dir), substring_dedup.ORACLE, sf_dir, "documents")


@pytest.mark.parametrize("options", [{}, {"block_runs": 16}, {"block_runs": 16, "hot": 0}])
def test_op11_equals_brute_force(spark, options):
    """Few words, so that windows repeat, overlap themselves and share anchors; ``hot=0`` deals every block by window."""
    rng = random.Random(11)
    passage = " ".join(rng.choice("abcdefgh") for _ in range(12))
    docs = []
    for i in range(300):
        words = [rng.choice("abcdefgh" if i % 3 else "ab") for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:  # a passage in a third of all rows
            words.insert(rng.randrange(0, len(words) + 1), passage)
        docs.append((rng.choice([None, *range(150)]), " x\t".join([" ".join(words), "tail"]) if i % 7 else None))
    docs += [(7, "z " * 500), (8, "z " * 300), (9, ""), (None, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    stored = [tuple(r) for r in frame.collect()]
    got = removed(frame, window_words=6, gram_words=2, **options)
    assert sorted(got) == sorted(without_repeats(stored, 6))


def test_op11_over_many_tasks(spark, tmp_path):
    """Tasks see only some documents each; hot windows are the same in all."""
    rng = random.Random(5)
    docs = [(i, " ".join(["the same hot passage of eight words goes"] * (i % 3 == 0) + [rng.choice("uvwxyz") for _ in range(40)])) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(12, "doc_id").write.parquet(path)
    got = removed(spark.read.parquet(path), window_words=8, gram_words=3, block_runs=64, hot=1)
    assert sorted(got) == sorted(without_repeats(docs, 8))


def test_op11_sketch_never_falls_short(spark):
    """A counter is two or more wherever an anchor has two places."""
    rng = np.random.default_rng(3)
    anchors = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    both = np.concatenate((anchors, anchors[:1000]))
    width = 1 << 13
    counters = [np.bincount(c, minlength=width) for c in substring_dedup.cells(both, width)]
    estimate = np.minimum(*[c[x] for c, x in zip(counters, substring_dedup.cells(anchors, width), strict=True)])
    assert (estimate[:1000] >= 2).all() and (estimate[1000:] >= 2).mean() < 0.3


def test_op11_corner_cases(odd_docs, no_docs):
    rows = substring_dedup.deduplicate_substrings(odd_docs).collect()
    assert len(rows) == 11
    long = next(r for r in rows if r.doc.doc_id == 5)
    assert (long.n_words, long.n_removed) == (30_000, 30_000 - 997)
    fox = [r.text for r in rows if r.doc.text and "fox" in r.doc.text]
    assert fox == ["The quick brown fox"] * 3  # shorter than a window
    assert all((r.text, r.n_words) == ("", 0) for r in rows if not (r.doc.text or "").strip())
    assert all(r.doc.shard == 1 for r in rows if r.doc.text is not None)
    assert substring_dedup.deduplicate_substrings(no_docs).collect() == []


def test_op12_matches_sql(spark, sf_dir):
    same_as_sql(lexical_search.query(spark, sf_dir), lexical_search.ORACLE, sf_dir, "documents", "benchmark")


def test_op12_shards_of_any_size_agree(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert set(lexical_search.search(docs, items, postings=1).collect()) == set(lexical_search.query(spark, sf_dir).collect())


def test_op12_threshold_finds_the_best_and_stops_early():
    rng = np.random.default_rng(12)
    docs, terms = 20_000, 40
    held = rng.random((docs, terms)) < 0.2
    impact = rng.integers(0, 50, (docs, terms)) ** 3
    impact[rng.choice(docs, 60, replace=False)] += 400_000  # some documents stand out
    held[:, 5] = False
    doc, term = np.nonzero(held)
    ends = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
    ids = rng.permutation(docs)
    shard = lexical_search.Shard((ids, np.zeros(docs, dtype=bool), np.arange(docs)), ends, term, impact[doc, term], terms)
    read = []
    for _ in range(20):
        asked = np.sort(rng.choice(terms, 6, replace=False))
        mask = np.zeros(terms, dtype=np.int64)
        mask[asked] = 1
        best = lexical_search.Best(10)
        read.append(shard.best(asked, mask, best))
        whole = (impact * held)[:, asked].sum(axis=1)
        want = np.lexsort((ids, -whole))[:10]
        assert best.found[0].tolist() == whole[want].tolist() and best.found[1].tolist() == ids[want].tolist()
    assert np.mean(read) < docs / 2


def test_op12_equal_scores_go_by_id_at_the_last_place():
    """Threshold and k-th score equal: reading goes on, as a smaller id may come."""
    n = 100
    shard = lexical_search.Shard((np.arange(n)[::-1].copy(), np.zeros(n, dtype=bool), np.arange(n)), np.arange(n + 1), np.zeros(n, dtype=np.int64), np.full(n, 7), 1)
    best = lexical_search.Best(10)
    shard.best(np.array([0]), np.ones(1, dtype=np.int64), best)
    assert best.found[1].tolist() == list(range(10))


def test_op12_corner_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "QUICK fox! fox"), (2, None), (3, ""), (4, "nothing matches"), (5, "Café αβσ"), (None, "w1 w2"), (1, "naïve")], "item_id long, text string")
    rows = lexical_search.search(odd_docs, items).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        by[r.item_id].append(r.doc_id)
    assert {k: sorted(v) for k, v in by.items()} == {1: [1, 1, 2, 7], 5: [7], None: [5]}
    assert [d for d in by[1] if d != 7] == [1, 1, 2]  # equal scores by id
    assert all(r.score > 0 for r in rows)
    assert lexical_search.search(no_docs, items).collect() == []
    assert lexical_search.search(odd_docs, items.limit(0)).collect() == []


def test_op12_terms_as_the_pattern_gives_them():
    import pyarrow as pa

    texts = ["Ab9-c_d É東x\x7f.y", "", None, "ŽÄ a", "b"]
    hashes, first = lexical_search.term_hashes(pa.array(texts))
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = [re.findall(pattern, lower(t)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    known = {}
    for h, w in zip(hashes.tolist(), [x for w in want for x in w], strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def trie(rows):
    """Brute force: the nodes of (conv_id, turn, role, text) rows in stored order."""
    turns = defaultdict(list)
    for i, (c, t, role, text) in enumerate(rows):
        if c is not None:
            turns[c].append(((t is not None, t or 0, i), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(held) - 1) * words
    out = []
    for key, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(built[c]) == len(key)))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(held), len(key), parent, len(held), len(children.get(key, ())), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_op13_matches_sql(spark, sf_dir):
    same_as_sql(prefix_trie.query(spark, sf_dir), prefix_trie.ORACLE, sf_dir, "conversations")


def test_op13_equals_brute_force(spark, tmp_path):
    """Shared beginnings, NULLs, ties, a text with a separator, one long conversation and one with a third of all rows."""
    rng = random.Random(13)
    rows = []
    for c in [*range(0, 200, 3), -7, -20, 40, 41, 100_000_000_019]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), rng.choice(["hi there", "hi there", "a  b c", "", None, "1:x"])))
    rows += [(60, t, "user", f"word {t % 5}") for t in range(1300)] + [(61, t, "user", f"word {t % 5}") for t in range(700)]
    rows += [(None, 1, "user", "lost"), (80, None, None, None), (80, None, None, None)]
    path = str(tmp_path / "conversations")
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int").coalesce(1).write.parquet(path)
    assert nodes(prefix_trie.prefix_trie(spark.read.parquet(path))) == sorted(trie(rows), key=repr)


def test_op13_many_ids_end_at_one_node(spark):
    """Ids of one node in several pieces, with nodes of fewer ids beside it; hot parents and pointers."""
    rows = [(c, t, "user", "same" if c % 5 else f"own {c}") for c in range(9000, 15000) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert nodes(prefix_trie.prefix_trie(frame)) == sorted(trie(rows), key=repr)


def test_op13_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(none).collect() == []
    # crc32 of "25" leaves it three turns of conversation 20, which doesn't exist
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    lone = spark.createDataFrame([(c, 1, "user", "gone")], "conv_id long, turn int, role string, text string")
    assert nodes(prefix_trie.prefix_trie(lone)) == trie([(c, 1, "user", "gone")])
