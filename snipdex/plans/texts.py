"""Token estimates, truncation, chunks and embedded blocks over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.functions import text as X
from snipdex.operators import batches, embed, filters, knn, markup
from snipdex.plans.catalog import query
from snipdex.plans.domain import load
from snipdex.session import spread_scan

MAX_TOKENS = 60

TRIM_SQL = "' ' || chr(9) || chr(10) || chr(13)"
WORD_SQL = "[^ \\t\\n\\r]+"


def tokens_sql(text: str) -> str:
    """The token estimate as SQL."""
    words = f"len(regexp_extract_all({text}, '{WORD_SQL}'))"
    cjk = f"(length({text}) - length(regexp_replace({text}, '[一-鿿]', '', 'g')))"
    mixed = f"({words} + {cjk} + CAST(trunc((length({text}) - {words} - {cjk}) / 4.0) AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE greatest({mixed}, length({text}) // 4) END"


def truncated_sql(table: str, key: str, text: str, limit: int) -> str:
    """A CTE `cut` (key, tokens, out) with the truncated text of a table."""
    return f"""base AS (SELECT {key} AS k, {text} AS t, {tokens_sql(text)} AS tokens FROM {table}),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line,
                 generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM base WHERE tokens > {limit}),
kept AS (SELECT k, pos, line, sum(n) OVER (PARTITION BY k ORDER BY pos) AS total
         FROM (SELECT k, pos, line, {tokens_sql("(line || chr(10))")} AS n FROM lines)),
cuts AS (SELECT k, rtrim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(9) || chr(10) || chr(13)) AS t
         FROM kept WHERE total <= {limit} GROUP BY k),
cut AS (SELECT b.k, b.t AS full_text, b.tokens, CASE WHEN b.tokens <= {limit} THEN b.t ELSE coalesce(c.t, '') END AS out
        FROM base b LEFT JOIN cuts c ON b.k = c.k)"""


def _documents(spark, sf_dir):
    """Documents on all cores; a large table comes in enough splits and is not moved."""
    return spread_scan(load(spark, sf_dir, "documents"), "doc_id")


@query("token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("token_estimate_simple", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM documents")
def token_estimate_simple(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.estimate_tokens_simple(F.col("text")).alias("tokens"))


@query(
    "token_totals",
    f"""SELECT source, lang, count(*) AS docs, sum(t) AS tokens, max(t) AS longest
FROM (SELECT source, lang, {tokens_sql('text')} AS t FROM documents) GROUP BY source, lang""",
)
def token_totals(spark, sf_dir):
    tokens = X.estimate_tokens(F.col("text"))
    docs = _documents(spark, sf_dir).select("source", "lang", tokens.alias("t"))
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("longest")
    )


@query(
    "truncate_lines",
    f"WITH {truncated_sql('documents', 'doc_id', 'text', MAX_TOKENS)} "
    "SELECT k AS doc_id, tokens, length(out) AS kept_chars, md5(out) AS kept_md5 FROM cut",
)
def truncate_lines(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        "doc_id",
        X.estimate_tokens(F.col("text")).alias("tokens"),
        X.truncate_lines(F.col("text"), MAX_TOKENS).alias("out"),
    )
    return docs.select("doc_id", "tokens", F.length("out").alias("kept_chars"), F.md5("out").alias("kept_md5"))


@query(
    "truncate_chars",
    f"SELECT doc_id, length(substr(text, 1, {MAX_TOKENS * 4})) AS kept_chars, md5(substr(text, 1, {MAX_TOKENS * 4})) AS kept_md5 FROM documents",
)
def truncate_chars(spark, sf_dir):
    cut = X.truncate_chars(F.col("text"), MAX_TOKENS)
    return _documents(spark, sf_dir).select(
        "doc_id", F.length(cut).alias("kept_chars"), F.md5(cut).alias("kept_md5")
    )


@query(
    "cap_snippet",
    """SELECT doc_id, length(c) AS kept_chars, md5(c) AS kept_md5 FROM (
  SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1950) || chr(10) || '// ... 代码过长已截取 ...'
                      ELSE text END AS c FROM documents)""",
)
def cap_snippet(spark, sf_dir):
    cut = X.cap_snippet(F.col("text"))
    return _documents(spark, sf_dir).select(
        "doc_id", F.length(cut).alias("kept_chars"), F.md5(cut).alias("kept_md5")
    )


@query(
    "chunk_overlap",
    """SELECT doc_id, i AS chunk, length(c) AS chars, md5(c) AS chunk_md5 FROM (
  SELECT doc_id, i, substr(text, i * 150 + 1, 200) AS c FROM (
    SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 50) / 150.0) AS BIGINT), 1) - 1)) AS i
    FROM documents WHERE length(text) > 0))""",
)
def chunk_overlap(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    parts = docs.select("doc_id", F.posexplode(X.chunks(F.col("text"), 200, 50)).alias("chunk", "c"))
    return parts.select("doc_id", "chunk", F.length("c").alias("chars"), F.md5("c").alias("chunk_md5"))


BLOCK_SQL = "(?is)<(script|style)[^>]*>(.*?)</(?:script|style)>"


@query(
    "embedded_blocks",
    f"""WITH found AS (
  SELECT page_id, unnest(regexp_extract_all(html, '{BLOCK_SQL}', 1)) AS kind,
         unnest(regexp_extract_all(html, '{BLOCK_SQL}', 2)) AS body,
         generate_subscripts(regexp_extract_all(html, '{BLOCK_SQL}', 1), 1) AS pos FROM pages),
kept AS (SELECT page_id, lower(kind) AS kind, trim(body, {TRIM_SQL}) AS body, pos FROM found
         WHERE trim(body, {TRIM_SQL}) <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block, kind, md5(body) AS body_md5 FROM kept""",
)
def embedded_blocks(spark, sf_dir):
    blocks = markup.embedded_blocks(load(spark, sf_dir, "pages"), "html", ["script", "style"])
    return blocks.select("page_id", F.col("block").cast("long").alias("block"), "kind", F.md5("code").alias("body_md5"))


@query(
    "line_metrics",
    """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS line_total, max(length(regexp_extract(line, '^([ \\t]*)', 1))) AS deepest_indent,
       any_value(length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1) AS middle_line
FROM l GROUP BY doc_id""",
)
def line_metrics(spark, sf_dir):
    text = F.col("text")
    indents = F.transform(F.split(text, "\n"), lambda line: F.length(X.leading_indent(line)))
    middle = F.call_function("div", F.length(text), F.lit(2)).cast("int")
    return _documents(spark, sf_dir).select(
        "doc_id",
        X.line_count(text).cast("long").alias("line_total"),
        F.array_max(indents).alias("deepest_indent"),
        X.line_number(text, middle).alias("middle_line"),
    )


CLEAN_LIMIT = 20


@query(
    "snippet_clean",
    f"""WITH {truncated_sql('conversations', "conv_id || ':' || turn", 'text', CLEAN_LIMIT)}
SELECT k AS snippet_id, tokens, length(out) AS kept_chars FROM cut
WHERE trim(full_text, {TRIM_SQL}) <> '' AND trim(out, {TRIM_SQL}) <> ''""",
)
def snippet_clean(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("snippet_id"),
        F.col("text").alias("code"),
    )
    return filters.clean_snippets(turns, CLEAN_LIMIT).select(
        "snippet_id", "tokens", F.length("model_text").alias("kept_chars")
    )


@query(
    "batch_assign",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n,
                  count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT doc_id, source, (n - 1) // 10 + 1 AS batch, (total + 9) // 10 AS batches FROM r""",
)
def batch_assign(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return batches.assign_batches(docs, "source", "doc_id", 10).select("doc_id", "source", "batch", "batches")


TEXT_DIM = 64
# No truncation: whole documents are compared.
WHOLE = 1 << 30

def embed_sql(texts: str) -> str:
    """CTE `unit` (kind, id, slot, w) and `len2` (kind, id, n): hashed-token vectors as stored in 32 bits."""
    return f"""tok AS (
  SELECT kind, id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM ({texts})),
slot AS (SELECT kind, id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {TEXT_DIM} AS slot,
                CASE WHEN substr(md5(t), 9, 1) IN ('0','1','2','3','4','5','6','7') THEN 1.0 ELSE -1.0 END AS s
         FROM tok WHERE t <> ''),
part AS (SELECT kind, id, slot, CAST(sum(s) AS DOUBLE) AS w FROM slot GROUP BY kind, id, slot),
size AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM part GROUP BY kind, id),
unit AS (SELECT p.kind, p.id, p.slot, CAST(CAST(p.w / s.n AS FLOAT) AS DOUBLE) AS w
         FROM part p JOIN size s ON p.kind = s.kind AND p.id = s.id WHERE s.n > 0),
len2 AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM unit GROUP BY kind, id),
pairs AS (SELECT q.id AS query_id, d.id AS found, round(sum(q.w * d.w) / max(a.n * b.n), 9) AS score
  FROM unit q JOIN unit d ON q.slot = d.slot AND q.kind = 'q' AND d.kind = 'd'
  JOIN len2 a ON a.kind = 'q' AND a.id = q.id JOIN len2 b ON b.kind = 'd' AND b.id = d.id GROUP BY q.id, d.id)"""


DOCS_AND_ASKED = """SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL
    SELECT 'q' AS kind, item_id AS id, text FROM benchmark"""


def asked_vectors(spark, sf_dir, model):
    asked = load(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = embed.embed(asked, "text", model, TEXT_DIM, batch=100, max_tokens=WHOLE)
    return asked.select(F.col("item_id").alias("query_id"), F.col("vector").alias("q_vector"))


@query(
    "text_search",
    f"""WITH {embed_sql(DOCS_AND_ASKED)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found) AS rank FROM pairs)
SELECT query_id, rank, found AS doc_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def text_search(spark, sf_dir):
    """Embed whole documents and the benchmark texts, then find the best five documents per text."""
    model = embed.embedder("hashed_tokens", dim=TEXT_DIM)
    docs = spread_scan(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    points = embed.embed(docs, "text", model, TEXT_DIM, batch=100, max_tokens=WHOLE)
    hits = knn.knn_join(
        asked_vectors(spark, sf_dir, model), points.select(F.col("doc_id").alias("vec_id"), "vector"), 5
    )
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score")
    )


@query(
    "query_validation",
    f"""SELECT item_id, k, CASE WHEN trim(q, {TRIM_SQL}) = '' THEN 'blank query' WHEN k < 1 THEN 'k below 1'
   WHEN k > 100 THEN 'k above 100' ELSE 'ok' END AS verdict
FROM (SELECT item_id, item_id * 5 AS k, CASE WHEN item_id % 7 = 0 THEN '  ' ELSE text END AS q FROM benchmark)""",
)
def query_validation(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(
        "item_id",
        (F.col("item_id") * 5).alias("k"),
        F.when(F.col("item_id") % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("q"),
    )
    verdict = F.coalesce(filters.query_problem(F.col("q"), F.col("k")), F.lit("ok"))
    return asked.select("item_id", "k", verdict.alias("verdict"))
