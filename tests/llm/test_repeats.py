"""Removal of repeated passages against a plain loop, and the run-length index on its own."""

import random

import numpy as np
import pytest

from snipdex.llm import repeats
from snipdex.llm.run_index import RunLengthIndex
from tests.llm.cases import documents, odd_texts, words


def plain(rows, length):
    """Removed runs and what is left, for rows (id, text); null ids come last."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, (order(d), s)), (order(d), s))
    out = []
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (order(d), s):
                gone[s : s + length] = b"\1" * length
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else 0) != (gone[i - 1] if i else 0)]
        out.append((d, len(data), list(zip(edges[0::2], edges[1::2])), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def corpus(seed, n):
    """Texts with passages of each other, edits, and repeats within one text."""
    rng = random.Random(seed)
    passages = [words(seed * 100 + i, rng.choice([6, 20, 60])) for i in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else words(seed * 10_000 + i, 15) for _ in range(rng.randint(0, 6))]
        text = rng.choice([" ", "", "é"]).join(parts)
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["X", "", "日本"]) + text[at + 1 :]
        rows.append((rng.randrange(10 * n) * 2 + 1 if rng.random() < 0.9 else i * 2, text))
    return rows


@pytest.mark.parametrize("seed,variants,index_bytes", [(1, 4096, 3 << 19), (2, 4096, 3000), (3, 1, 3 << 19), (4, 3, 5000)])
def test_removal_equals_a_plain_loop(spark, seed, variants, index_bytes):
    rows = corpus(seed, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(repeats.remove_repeats(df, variants=variants, index_bytes=index_bytes)) == plain(rows, 100)


@pytest.mark.parametrize("length", [16, 25, 40])
def test_other_lengths(spark, length):
    rows = corpus(7, 60) + [(5000, "abab" * 30), (5001, "ab" * 70), (5002, "z" * length), (5003, "z" * (length + 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(repeats.remove_repeats(df, length=length, gram=12)) == plain(rows, length)


def test_odd_rows(spark):
    long = words(21, 900)
    rows = odd_texts() + [(20, long), (20, "more " + long), (21, long[:99]), (22, long[:100]), (None, long), (3, long)]
    got = repeats.remove_repeats(documents(spark, rows))
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert found(got) == plain(rows, 100)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    names = spark.createDataFrame([("b", long), ("a", "- " + long), (None, long)], "id string, found string")
    kept = {r.id: bytes(r.kept) for r in repeats.remove_repeats(names, "id", "found").collect()}
    assert kept == {"a": b"- " + long.encode(), "b": b"", None: b""}


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rows = [(1, words(31, 1500)), (2, words(32, 300) + words(31, 1500)[1000:4000] + words(33, 300)), (3, "y" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.remove_repeats(df)) == plain(rows, 100)


@pytest.mark.parametrize("seed", range(30))
def test_streams_give_the_first_place_of_every_repeat(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 3, 7, 8, 10, 20, 33])
    base = [bytes(rng.choices(b"ab\x00\xf4"[: rng.choice([1, 2, 4])], k=rng.randint(1, 90))) for _ in range(5)]
    strings = []
    for _ in range(rng.randint(1, 30)):
        b = rng.choice(base)
        s = bytearray(b[rng.randint(0, len(b) - 1) :])
        if rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.choice(b"abc")
        strings.append(bytes(s))
    data = np.frombuffer(b"".join(strings), np.uint8)
    index = RunLengthIndex(data, np.array([len(s) for s in strings]), length)
    string, offset, least = index.stream(data)
    owner = index.owner(least)
    got = {(a, b): (c, d) for a, b, c, d in zip(string.tolist(), offset.tolist(), owner.tolist(), (least - index.starts[owner]).tolist())}
    places = {}
    for j, s in enumerate(strings):
        for i in range(len(s) - length + 1):
            places.setdefault(s[i : i + length], []).append((j, i))
    assert got == {p: some[0] for some in places.values() if len(some) > 1 for p in some}


def test_samples_are_fewer_than_repeats():
    base = words(41, 400).encode()
    strings = [base[:i] + b"#" + base[i:] for i in range(0, len(base), 40)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    index = RunLengthIndex(data, np.array([len(s) for s in strings]), 100)
    assert len(index.symbol) < index.n / 5
    assert len(index.sample) < len(index.group_begin) / 2
