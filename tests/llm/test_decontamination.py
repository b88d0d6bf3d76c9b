"""Windows of benchmark words in documents against brute force."""

import random
import re

from snipdex.llm import decontamination
from tests.llm.cases import documents, odd_texts, words


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items):
    out = []
    for key, text in rows:
        found, hit, names = tokens(text), set(), set()
        for name, item in items:
            parts = tokens(item)
            size = min(10, len(parts))
            windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()
            for i in range(len(found) - size + 1 if windows else 0):
                if tuple(found[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    names.add("" if name is None else str(name))
        out.append((key, len(found), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


def tables():
    rng = random.Random(9)
    items = [(i, words(100 + i, rng.randint(1, 40))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "!!"), (43, "one two"), (44, "Été àéî"), (5, words(999, 12)), (None, words(77, 15)), (45, "it it it it it it it it it it it it")]
    rows = odd_texts()
    for i in range(60):
        text = words(i, 50).split()
        _, item = rng.choice(items)
        parts = (item or "").split()
        cut = parts[rng.randint(0, max(0, len(parts) - 12)) :][: rng.randint(5, 40)]
        at = rng.randrange(50)
        rows.append((1000 + i, " ".join(text[:at] + cut + text[at:] + (cut if i % 3 == 0 else []))))
    rows += [(2000, " ".join(["it"] * 40)), (2001, "it " * 11 + "is " + "it " * 9), (2002, words(77, 15).upper())]
    return rows, items


def test_against_brute_force(spark):
    rows, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(documents(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=str) == brute(rows, items)
    for r in got:
        assert sum(s["last"] - s["first"] for s in r.spans) == r.n_hit
        text = tokens(dict(rows)[r.doc_id]) if r.doc_id not in (None, 13) else None
        for m in r.matches if text else ():
            item = next(t for k, t in items if ("" if k is None else str(k)) == m["item"] and tokens(t)[m["item_word"] : m["item_word"] + m["words"]] == text[m["first"] : m["first"] + m["words"]])
            end, at = m["item_word"] + m["words"], m["first"] + m["words"]
            parts = tokens(item)
            assert end == len(parts) or at == len(text) or parts[end] != text[at]  # no longer match there


def test_several_slices_give_the_same(spark):
    rows, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = decontamination.find_contamination(docs, bench, slice_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=str) == brute(rows, items)
    left = decontamination.remove_contaminated(docs, bench, slice_bytes=1000)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id) for r in left.collect())) == sorted(str(k) for k, _, hit, _ in brute(rows, items) if not hit)


def test_empty_tables(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.find_contamination(docs, none).collect()} == {0}
    assert decontamination.remove_contaminated(docs, none).count() == len(odd_texts())
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.find_contamination(documents(spark, []), bench).count() == 0
