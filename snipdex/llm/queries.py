"""The registered queries of the operators for training data; each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.llm import bpe, decontamination, language_id, lexical_search, lm_score, near_duplicates, pseudonyms, repeats, shards, token_counts, token_files, vector_codes, vector_links
from snipdex.session import scratch_path, stored

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign_shards(table(spark, sf_dir, "documents"), 8)
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op1_decontamination"] = r"""
WITH lowered AS (
    SELECT doc_id AS id, 'd' AS kind, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    UNION ALL
    SELECT item_id, 'i', translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
    SELECT id, kind, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered
), windows AS (
    SELECT id AS item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS phrase
    FROM split, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(i) WHERE kind = 'i' AND len(words) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), places AS (
    SELECT id AS doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
    FROM split, sizes, unnest(range(1, len(words) - size + 2)) AS t(i) WHERE kind = 'd'
), hits AS (
    SELECT DISTINCT doc_id, i, size, item_id FROM places JOIN windows USING (size, phrase)
), words_hit AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS t(k) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names FROM hits GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN words_hit ON words_hit.doc_id = id LEFT JOIN items ON items.doc_id = id
WHERE kind = 'd'
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score", F.round("language.background", 6).alias("background"))


PSEUDONYM_KEY = "example"


@query
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.concat_ws(",", "pii.kind").alias("kinds"))


@query
def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_links(table(spark, sf_dir, "embeddings"))


SQL["op9_vector_links"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
), reach AS (
    SELECT vec_id AS u, vec_id AS w FROM embeddings
    UNION
    SELECT reach.u, links.w FROM reach JOIN links ON links.u = reach.w
), least AS (
    SELECT u, min(w) AS component_id FROM reach GROUP BY u
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.u = vec_id
"""


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    found = token_files.read_tokens(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    codes = stored(codes, "codes")
    labels = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    found = codes.join(labels, codes.label.eqNullSafe(labels.same), "left")
    code = F.concat_ws("", F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")))
    return found.select("vec_id", F.when(F.col("code").isNotNull(), code).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS x FROM v, unnest(range({parts})) AS t(part)
), b0 AS MATERIALIZED (
    SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
    SELECT vec_id, label, part, least.entry AS entry, least.d AS d, x
    FROM (SELECT vec_id, p.label, p.part, any_value(p.x) AS x, min({{'d': CAST({far} AS BIGINT), 'entry': b.entry}}) AS least FROM p JOIN b{k} b ON b.part = p.part GROUP BY ALL)
)"""
        )
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (
    SELECT old.part, old.entry, coalesce(new.x, old.x) AS x
    FROM b{k} old LEFT JOIN (
        SELECT part, entry, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY place) AS x
        FROM (SELECT part, entry, place, sum(x[place]) AS total, count(*) AS n FROM a{k}, unnest(range(1, len(x) + 1)) AS t(place) GROUP BY ALL) GROUP BY ALL
    ) new ON new.part = old.part AND new.entry = old.entry
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f""", coded AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL
), books AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""
    )


SQL["op11_vector_codes"] = _vector_codes_sql()


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL["op13_lexical_search"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), stats AS (
    SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM d
), tf AS (
    SELECT doc_id, len(words) AS n, w, count(*) AS tf FROM d, unnest(words) AS t(w) GROUP BY ALL
), df AS (
    SELECT w, count(*) AS df FROM tf GROUP BY w
), q AS (
    SELECT item_id, w, count(*) AS times
    FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark), unnest(words) AS t(w)
    GROUP BY ALL
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM q JOIN df USING (w) JOIN tf USING (w), stats GROUP BY ALL
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 20
"""


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_repeats"] = """
WITH d AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), w AS (
    SELECT doc_id, s, substring(h, 2 * s + 1, 200) AS piece FROM d, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS t(s)
), again AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY piece ORDER BY doc_id, s) AS n FROM w) WHERE n > 1
), run AS (
    SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
    FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM again)
), spans AS (
    SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY ALL
), gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL
    SELECT doc_id, coalesce(max(b), 0), max(length(h)) // 2 FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
    SELECT doc_id, sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
