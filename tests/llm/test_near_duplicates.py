"""Near-duplicates, vectors and components against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from snipdex.llm import near_duplicates, vector_links
from snipdex.llm.arrow_text import not_blank, text_chunks
from snipdex.llm.components import components
from snipdex.llm.superminhash import EMPTY, signatures
from tests.llm.cases import documents, odd_texts, words


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def smallest(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute(rows):
    sets = {k: shingles(t) for k, t in rows if k is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = smallest(sets, links)
    return {(k, len(sets[k]), label[k], label[k] == k) for k in sets}


def copies(n):
    """A long chain of edits, and many edited copies of one text, some beyond the threshold."""
    rng, rows = random.Random(5), []
    text = words(7, 120).split()
    for i in range(n):
        rows.append((100 + i, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = f"w{i}"
    text = words(8, 100).split()
    for i in range(n):
        some = list(text)
        for _ in range(rng.randint(0, 6)):
            some[rng.randrange(len(some))] = f"v{rng.randrange(1000)}"
        rows.append((500 + i, " ".join(some)))
    return rows


def test_shingle_sets_have_the_right_sizes():
    texts = [t for _, t in odd_texts()]
    got = [c for first, last, data, offsets in text_chunks(pa.array(texts)) for c in near_duplicates.shingle_sets(data, offsets, not_blank())[1].tolist()]
    assert got == [len(shingles(t)) for t in texts]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(pool[rng.integers(0, 600) : rng.integers(800, 1600)]) for _ in range(30)] + [pool[:0], pool[:1], pool[:3]]
    values = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 128)
    assert (values[30] == EMPTY).all() and (values[31:] != EMPTY).all()
    errors = []
    for i, j in itertools.combinations(range(30), 2):
        true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        errors.append((values[i] == values[j]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_against_brute_force(spark):
    rows = odd_texts() + copies(60)
    got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(rows)
    assert len(got) == len(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 7)
    rows = copies(40)
    assert {tuple(r) for r in near_duplicates.near_duplicates(documents(spark, rows)).collect()} == brute(rows)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, odd_texts())
    left = near_duplicates.keep_one(docs)
    assert left.columns == docs.columns
    keys = [r.doc_id for r in left.collect()]
    kept = sorted(k for k, _, _, keep in brute(odd_texts()) if keep)
    assert sorted(k for k in keys if k is not None) == kept and keys.count(None) == 2


def test_empty_tables(spark):
    assert near_duplicates.near_duplicates(documents(spark, [])).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_links.vector_links(vectors).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(200, i) for i in range(201, 230)]
    df = spark.createDataFrame(links + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest(nodes, links_in := [(a, b) for a, b in links if a != b]) and links_in


def vectors_of(rng, n):
    centres = rng.normal(size=(6, 16))
    rows = [centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3]) for _ in range(n)]
    return [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]


def brute_vectors(rows):
    usable = {}
    for key, vector in rows:
        if vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            v = np.array(vector, np.float64)
            usable[key] = v / np.linalg.norm(v)
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.95]
    label = smallest([k for k, _ in rows], links)
    return {(k, sum(k in pair for pair in links), label[k], label[k] == k) for k, _ in rows}


def test_vectors_against_brute_force(spark, monkeypatch):
    rows = vectors_of(np.random.default_rng(4), 400)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-1.0, -2.0]), (1009, [3e38] * 16), (1010, [1e-38] * 16)]
    rows += [(2000 + i, rows[3][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS cell", "3 AS vector")
    for cell, tile, part in ((8192, 8192, 512), (50, 20, 7)):
        monkeypatch.setattr(vector_links, "CELL_ROWS", cell)
        monkeypatch.setattr(vector_links, "TILE", tile)
        monkeypatch.setattr(vector_links, "PART", part)
        assert {tuple(r) for r in vector_links.vector_links(df).collect()} == brute_vectors(rows)
