"""Language, scores, shards, and the pipeline."""

import zlib

import pytest

import corpus_pipeline
from snipdex.llm import language_id, lm_score, shards
from tests.llm.cases import documents, odd_texts, words

SF = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    rows = language_id.predict(docs, model).filter(language_id.held_out()).collect()
    right = sum(r.lang == r.language["lang_pred"] for r in rows) / len(rows)
    assert len(rows) > 200 and right > 0.98
    assert all(0 <= r.language["score"] <= 1 for r in rows)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows} == {2}


def test_a_mixture_has_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) > 1500").collect()}
    mixed = documents(spark, [(1, texts["de"][:1000] + " " + texts["es"][:1000]), (2, texts["fr"][:1500])])
    one, two = (r.language for r in language_id.predict(mixed, model).orderBy("doc_id").collect())
    assert {k for k, v in one["shares"].items() if v > 0.3} == {"de", "es"}
    assert two["lang_pred"] == "fr" and set(two["shares"]) == {"fr"}


def test_language_of_odd_rows(spark):
    docs = documents(spark, odd_texts()).selectExpr("*", "IF(doc_id % 2 = 0, 'xx', 'yy') AS lang")
    model = language_id.learn(docs)
    found = language_id.predict(docs, model)
    assert found.columns == [n for n in docs.columns if n != "language"] + ["language"]
    for r in found.collect():
        unknown = r[1] is None or not any(c.isalpha() for c in r[1])
        assert (r[-1]["lang_pred"] == "und") == unknown
    nothing = language_id.learn(docs.filter("false"))
    assert nothing[0] == [] and {r[-1]["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert language_id.predict(docs.select("text").filter("false"), model).count() == 0
    assert language_id.reject_unknown(docs).columns == docs.columns


def test_scores_prefer_the_corpus_order(spark):
    base = words(11, 400).split()
    rows = [(i, " ".join(base[i : i + 200])) for i in range(0, 200, 2)] * 3 + odd_texts()
    docs = documents(spark, rows)
    model = lm_score.train(docs)
    shuffled = " ".join(sorted(base[:200]))
    got = {r.doc_id: r for r in lm_score.score(documents(spark, [(1, " ".join(base[:200])), (2, shuffled), (3, None), (4, "")]), model).collect()}
    assert got[1].mean_log_prob > got[2].mean_log_prob
    assert (got[3].n_tokens, got[3].log_likelihood, got[3].mean_log_prob) == (0, 0.0, None) == (got[4].n_tokens, got[4].log_likelihood, got[4].mean_log_prob)
    assert got[1].n_tokens == 200 and got[1].log_likelihood == pytest.approx(200 * got[1].mean_log_prob)
    assert lm_score.score(documents(spark, []), lm_score.train(documents(spark, []))).count() == 0


def test_training_learns(spark):
    """Two alternating words: the neighbours tell the masked one."""
    docs = documents(spark, [(i, "tick tock " * 300 + str(i)) for i in range(1500)], extra=False)
    model = lm_score.train(docs)
    row = lm_score.score(documents(spark, [(1, "tick tock " * 50)]), model).first()
    assert row.mean_log_prob > -0.35  # a guess by frequency has -0.69


def test_every_position_is_trained_once(spark):
    """Over the rounds each token is a target once, and each of its places in a window is used once per target."""
    docs = documents(spark, [(i, words(i, 30 + i % 7)) for i in range(60)] + [(100, words(5, 5000))] + odd_texts()).filter("text IS NOT NULL")
    total = sum(len(r.text.encode().split()) for r in docs.collect())
    kind, _ = lm_score._classes(lm_score._counts(docs))
    rows = [r for n in range(lm_score.ROUNDS) for r in lm_score._moved(docs, lm_score._first_model(), kind, n).collect()]
    assert sum(r.weights[0] for r in rows if r.name == "inner" and r["first"] == 0) == total
    assert sum(sum(r.weights) for r in rows if r.name == "embedding") == 2 * lm_score.SIDE * total


@pytest.mark.parametrize("many", [False, True])
def test_shards_are_near_equal(spark, many):
    rows = odd_texts() if not many else [(i, words(i, i % 50)) for i in range(2000)] + [(5000 + i, "copy " * 30) for i in range(1500)]
    got = shards.assign_shards(documents(spark, rows), 8).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    filled = {}
    for r in got:
        assert 0 <= r.shard < 8
        filled.setdefault(r.shard, []).append(r)
    for some in filled.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    if many:
        sums = [sum(r["size"] for r in some) for some in filled.values()]
        assert len(sums) == 8 and max(sums) - min(sums) < 0.05 * sum(sums) / 8
        small = {}
        for r in got:
            if r.doc_id < 2000:
                small.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(len(s) == 1 for s in small.values())  # small groups of equal texts are not cut


def test_no_shards_of_nothing(spark):
    assert shards.assign_shards(documents(spark, [])).count() == 0


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        empty = stage(spark, docs.filter("false"), SF)
        assert empty.columns == columns and empty.count() == 0, name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)


def test_pipeline_on_odd_rows(spark):
    docs = documents(spark, odd_texts()).selectExpr("*", "'xx' AS lang", "cast(NULL AS string) AS source")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    keys = [r.doc_id for r in docs.collect()]
    assert {1, 8, 10, 13} <= set(keys) and not {2, 3, 4, 5, 6, 7} & set(keys) and keys.count(13) == 1
