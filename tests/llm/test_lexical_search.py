"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from snipdex.llm import lexical_search
from snipdex.session import stored
from tests.llm.cases import documents, odd_texts

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def plain(docs, items, k):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(w for _, ws in split for w in set(ws))
    out = []
    for item, text in items:
        scored = []
        for d, ws in split:
            tf, score = Counter(ws), 0
            for w in terms(text):
                if tf[w]:
                    m = 75 + 25 * len(ws) * n_docs // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m))
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes,slice_bytes", [(1 << 24, 1 << 20), (20_000, 1 << 20), (9_000, 700)])
def test_ranks_equal_a_plain_loop(spark, shard_bytes, slice_bytes):
    docs = [(i, t) for i, t in enumerate(texts(1, 700))] + [(i + 2000, t) for i, t in enumerate(texts(1, 50))]  # ties
    items = [(i, t + " w1 w1 unseen") for i, t in enumerate(texts(2, 12))]
    index = stored(lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shard_bytes=shard_bytes), "index")
    found = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 7, slice_bytes=slice_bytes)
    assert sorted(((r.query_id, r.rank, r.id, r.score) for r in found.collect()), key=str) == plain(docs, items, 7)


def test_odd_rows(spark):
    docs = odd_texts()
    items = [(1, "ONE two, one"), (2, None), (3, ""), (4, "!?"), (5, "日本語 été"), (6, "naïve x" + "x" * 49_999), (None, "two it"), (1, "ONE two, one")]
    found = lexical_search.rank(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 20)
    want = plain(docs, list(dict.fromkeys(items)), 20)
    assert sorted(((r.query_id, r.rank, r.id, r.score) for r in found.collect()), key=str) == want and want
    items = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.rank(documents(spark, []), items).count() == 0
    assert lexical_search.rank(documents(spark, docs), items.filter("false")).count() == 0
    two = lexical_search.rank(documents(spark, docs), spark.createDataFrame([(1, "one"), (1, "two it")], "item_id long, text string"))
    assert two.select("query").distinct().count() == 2


def test_blocks_are_rejected_before_decompression():
    rng = np.random.default_rng(5)
    corpus = lexical_search.Corpus(20_000, 2_000_000)
    shard = lexical_search.Shard(list(range(20_000)), rng.integers(50, 150, 20_000), corpus)
    lists = {1: np.arange(0, 20_000, 2), 2: np.arange(0, 20_000, 3), 3: np.array([5, 17_000]), 4: np.arange(100, 160)}
    for term, places in lists.items():
        both = np.stack([places, np.ones(len(places), np.int64)], axis=1)
        starts = np.arange(0, len(places), lexical_search.BLOCK)
        both[:, 0] = np.diff(places, prepend=0)
        both[starts, 0] = places[starts]
        packed, begins = lexical_search.pack(both.reshape(-1))
        assert (lexical_search.unpack(packed) == both.reshape(-1)).all()
        block = np.zeros(len(starts), lexical_search.ENTRY)
        block["last"] = [places[min(s + lexical_search.BLOCK, len(places)) - 1] for s in starts]
        block["count"], block["length"], block["byte"] = 1, 50, begins[2 * starts]
        shard.add(term, block.tobytes(), packed.tobytes())
    query = [(t, corpus.weight(len(p))) for t, p in lists.items()]
    blocks = sum(len(entry) for entry, _, _ in shard.lists.values())
    places, scores = shard.search(query, 3_500_000_000)
    assert shard.decompressed < 10 < blocks and set(places) >= {5, 17_000}
    everything = shard.search(query, 0)
    assert shard.decompressed == blocks and len(everything[0]) == np.count_nonzero(everything[1]) > 13_000
    assert dict(zip(*shard.search(query, 3_500_000_000))) == {p: s for p, s in zip(*everything) if s >= 3_500_000_000}


def test_damping_of_huge_numbers_is_exact():
    corpus = lexical_search.Corpus(3 * 10**12, 10**15)
    lengths = np.array([1, 10**9, 7])
    assert corpus.damping(lengths).tolist() == [75 + 25 * n * 3 * 10**12 // 10**15 for n in lengths.tolist()]
