"""Product codes against a plain loop, and odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipdex.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Codebooks and codes of (id, integers) rows by looking at every entry."""
    width = len(rows[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, q in sorted(rows)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, q in rows:
                own.setdefault(near(cut(q, p), books[p])[1], []).append(cut(q, p))
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    found = [[near(cut(q, p), books[p]) for p in range(parts)] for _, q in rows]
    return books, {k: ([i for _, i in f], sum(d for d, _ in f)) for (k, _), f in zip(rows, found)}


@pytest.mark.parametrize("rows,entries", [(150, 16), (90, 70), (9, 16)])
def test_codes_equal_a_plain_loop(spark, rows, entries):
    rng = random.Random(rows)
    values = [(i * 3, [rng.choice([0.0, 0.25, rng.gauss(0, 1), -0.3]) for _ in range(16)]) for i in range(rows)]
    df = spark.createDataFrame(values, "vec_id long, embedding array<double>").repartition(3)
    found, model = vector_codes.compress(df, entries=entries, rounds=3)
    books, codes = plain([(k, [int(np.floor(4096 * x)) for x in v]) for k, v in values], entries=entries, rounds=3)
    assert [b.tolist() for b in model.books] == books
    assert {r.vec_id: (r.code, r.error) for r in found.collect()} == codes
    again = vector_codes.encode(df, vector_codes.train(df, entries=entries, rounds=3))
    assert sorted(again.collect()) == sorted(found.collect())
    one = found.first()
    back = model.decode(one.code)
    assert sum((np.floor(4096 * a) - np.floor(4096 * b)) ** 2 for a, b in zip(back, dict(values)[one.vec_id])) == one.error


def test_candidates_hold_the_nearest_entry():
    rng = np.random.default_rng(3)
    entries = rng.integers(-50, 50, (130, 5))
    entries[7] = entries[2]  # a tie
    rows = np.concatenate([rng.integers(-80, 80, (500, 5)), entries])
    slices = vector_codes.Slices(entries)
    found, far = slices.nearest(rows)
    all_far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (found == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    close = entries + rng.integers(-3, 4, entries.shape)
    masks = slices.candidates(close, slices.radius(close))
    looked_at = np.unpackbits(masks.view(np.uint8).reshape(len(close), -1), axis=1).sum()
    assert looked_at < 0.3 * len(close) * len(entries)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (2, [1.0] * 8, 1), (1, [0.5] * 8, 1), (1, [0.5] * 8, None), (None, [0.25] * 8, None),
        (3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [inf] + [1.0] * 7, 1), (6, [nan] * 8, 1), (7, [1.0] * 9, 2), (8, [], 2), (9, [1e300] + [0.0] * 7, 2), (10, [1e9] * 8, 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit(0) for n in ("c0", "code", "numbers", "size", "vector")})
    found, model = vector_codes.compress(df, carry=("label",))
    got = sorted(found.collect(), key=lambda r: (r.vec_id is None, r.vec_id, str(r.label)))
    assert found.columns == ["vec_id", "label", "code", "error"]
    assert [(r.vec_id, r.label) for r in got] == [(1, 1), (1, None), (2, 1), (7, 2), (8, 2), (9, 2), (10, 2), (None, None)]
    assert [r.code for r in got] == [[0] * 8, [0] * 8, [2] * 8, None, None, None, None, [3] * 8]
    assert all(len(b) == 4 for b in model.books) and model.size == 8
    assert [r.error for r in got] == [0, 0, 0, None, None, None, None, 0]
    clash = vector_codes.compress(df, carry=("label", "c0", "numbers"))[0]
    assert clash.columns == ["vec_id", "label", "c0", "numbers", "code", "error"] and clash.count() == 8
    nothing, model = vector_codes.compress(df.filter("false"))
    assert nothing.count() == 0 and model.books == []
    assert vector_codes.compress(df.filter("vec_id = 8"))[0].collect()[0].code == [0] * 8
    # Nine numbers: parts of one or two.
    assert vector_codes.compress(df.filter("vec_id = 7"))[0].collect()[0].error == 0
