"""Index building, snapshots, replacement and presentation over files derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators import embed as M
from snipdex.operators import folders
from snipdex.operators import index as I
from snipdex.operators import knn
from snipdex.operators import runs as N
from snipdex.operators import search as S
from snipdex.plans.catalog import query
from snipdex.plans.domain import FILES_SQL, files, load
from snipdex.plans.snippets import SNIPPETS_SQL, code_files
from snipdex.plans.texts import TEXT_DIM, WHOLE, asked_vectors, embed_sql
from snipdex.session import scratch_path, stored
from snipdex.sources.index_store import IndexStore

COLLECTION_SQL = "'code_index_' || substr(sha256('/repo/' || library), 1, 8)"


def _stamped(listing):
    """Files with a modification time, one minute per document number."""
    base = F.lit("2024-01-01").cast("timestamp")
    return listing.withColumn("modified", base + F.make_dt_interval(mins=(F.col("doc_id") % 1000).cast("int")))


def _old_snapshot(spark, sf_dir):
    """An earlier state: every fifth file is not there yet, others have another or no hash, some are gone since."""
    n = F.col("doc_id") % 5
    rows = _stamped(files(spark, sf_dir)).filter(n != 4)
    digest = F.sha2("text", 256)
    old = F.when(n == 1, F.sha2(F.concat("text", F.lit("!")), 256)).when(n == 3, F.lit(None)).otherwise(digest)
    seen = F.when(F.col("doc_id") % 2 == 0, F.col("modified")).otherwise(F.col("modified") - F.expr("INTERVAL 1 DAY"))
    return rows.select("library", "root", "path", old.alias("content_hash"), seen.alias("last_indexed"))


@query(
    "snapshot_diff",
    f"""WITH {FILES_SQL} SELECT library, path, CASE doc_id % 5 WHEN 4 THEN 'added' WHEN 2 THEN 'deleted' WHEN 1 THEN 'modified'
  WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'modified' END ELSE 'unchanged' END AS change FROM files""",
)
def snapshot_diff(spark, sf_dir):
    new = I.file_snapshot(_stamped(files(spark, sf_dir)).filter("doc_id % 5 <> 2"))
    return I.snapshot_diff(_old_snapshot(spark, sf_dir), new).drop("root")


@query(
    "folder_diff",
    f"""WITH {FILES_SQL}, c AS (SELECT library, path, CASE doc_id % 5 WHEN 4 THEN 'added' WHEN 2 THEN 'deleted' WHEN 1 THEN 'modified'
  WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'modified' END ELSE 'unchanged' END AS change FROM files)
SELECT library, lower(path) AS path, change FROM c WHERE change <> 'unchanged'""",
)
def folder_diff(spark, sf_dir):
    """The changes of two snapshots from the digests of their folders."""
    new = I.file_snapshot(_stamped(files(spark, sf_dir)).filter("doc_id % 5 <> 2"))
    old = folders.folder_tree(_old_snapshot(spark, sf_dir), "last_indexed")
    found = folders.tree_diff(old, folders.folder_tree(new, "modified")).changes
    return found.select("library", F.concat(F.lit("/repo/"), "library", F.lit("/"), "path").alias("path"), "change")


@query("folder_diff_work", f"WITH {FILES_SQL} SELECT count(*) FILTER (doc_id % 200 = 0) AS changes, true AS few_compared FROM files")
def folder_diff_work(spark, sf_dir):
    """Every 200th file has changed: fewer than half of all entries are compared, as equal folders are left out."""
    rows = _stamped(files(spark, sf_dir))
    before = rows.select("library", "root", "path", F.sha2("text", 256).alias("content_hash"), F.col("modified").alias("last_indexed"))
    after = rows.withColumn("text", F.when(F.col("doc_id") % 200 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    old, new = folders.folder_tree(before, "last_indexed"), folders.folder_tree(I.file_snapshot(after), "modified")
    found = folders.tree_diff(old, new)
    few = sum(found.compared) < 0.5 * old.entries().count()
    return found.changes.agg(F.count(F.lit(1)).alias("changes"), F.lit(few).alias("few_compared"))


@query(
    "replace_by_file",
    f"""WITH {FILES_SQL} SELECT library, path, doc_id % 3 = 0 AS fresh FROM files WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 1)""",
)
def replace_by_file(spark, sf_dir):
    """Every third file changes; of those the odd ones give no points any more."""
    base = files(spark, sf_dir).select("doc_id", F.col("library").alias("collection"), F.col("path").alias("file_path"))
    points = base.withColumn("fresh", F.lit(False))
    changed = base.filter("doc_id % 3 = 0")
    fresh = changed.filter("doc_id % 2 = 0").withColumn("fresh", F.lit(True))
    rows = I.replace_by_file(points, changed, fresh)
    return rows.select(F.col("collection").alias("library"), F.col("file_path").alias("path"), "fresh")


@query("delete_by_file", f"WITH {FILES_SQL} SELECT library, path FROM files WHERE doc_id % 4 <> 1")
def delete_by_file(spark, sf_dir):
    base = files(spark, sf_dir).select("doc_id", F.col("library").alias("collection"), F.col("path").alias("file_path"))
    rows = I.delete_by_file(base, base.filter("doc_id % 4 = 1"))
    return rows.select(F.col("collection").alias("library"), F.col("file_path").alias("path"))


@query(
    "upsert_latest",
    """WITH v AS (SELECT md5(text) AS content_id, doc_id, source, lang FROM documents)
SELECT content_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, arg_max(lang, doc_id) AS lang FROM v GROUP BY content_id""",
)
def upsert_latest(spark, sf_dir):
    """Documents as points with their content as id: of exact copies the last one stays."""
    rows = files(spark, sf_dir).select(F.md5("text").alias("content_id"), "doc_id", F.col("library").alias("source"), "lang")
    return I.upsert_latest(rows, ["content_id"], ["doc_id"])


@query(
    "delete_points",
    """SELECT doc_id, sha256(source || chr(1) || doc_id) AS point_id FROM documents WHERE n_chars >= 500""",
)
def delete_points(spark, sf_dir):
    rows = files(spark, sf_dir).select("doc_id", "size", F.sha2(F.concat_ws("\u0001", "library", F.col("doc_id").cast("string")), 256).alias("point_id"))
    return I.delete_points(rows, rows.filter("size < 500")).select("doc_id", "point_id")


def _build(listing):
    model = M.embedder("hashed_tokens", dim=TEXT_DIM)
    return I.build_index(listing, model, TEXT_DIM, max_tokens=WHOLE, batch=200)


POINT_ID_SQL = "sha256(collection || chr(1) || path || chr(1) || start_line || chr(1) || end_line || chr(1) || namespace || chr(1) || class_name || chr(1) || member_name)"


@query(
    "index_build",
    f"""WITH {SNIPPETS_SQL}, p AS (SELECT *, {COLLECTION_SQL} AS collection FROM snippets)
SELECT collection, path AS file_path, member_name, {POINT_ID_SQL} AS point_id, length(code) AS chars, true AS embed_ok, {TEXT_DIM} AS dim FROM p""",
)
def index_build(spark, sf_dir):
    points = _build(code_files(spark, sf_dir))
    return points.select(
        "collection", "file_path", "member_name", "point_id", F.length("code").alias("chars"), "embed_ok", F.size("vector").alias("dim")
    )


@query(
    "index_run_observed",
    f"""WITH {SNIPPETS_SQL}, n AS (SELECT count(*) AS files, sum(size) AS bytes FROM files WHERE lang IN ('en', 'fr', 'de', 'es')),
p AS (SELECT count(*) AS total FROM snippets), r AS (SELECT count(*) AS rest FROM files WHERE lang = 'es')
SELECT files, CAST(bytes AS BIGINT) AS bytes, total + rest AS total, total + rest AS ok, 0 AS failed, true AS success, 100.0 AS completion FROM n, p, r""",
)
def index_run_observed(spark, sf_dir):
    """What a build with the lines outside of declarations reports, counted while its points are written."""
    run = N.ObservedRun()
    listing = run.files(code_files(spark, sf_dir).filter("lang IN ('en', 'fr', 'de', 'es')"))
    points = I.build_index(listing, M.embedder("hashed_tokens", dim=8), 8, max_tokens=WHOLE, batch=200, rest=True)
    run.points(points).write.parquet(scratch_path(spark, "observed"))
    return run.result(spark).select("files", "bytes", "total", "ok", "failed", "success", "completion")


@query("embed_once", "SELECT count(*) AS rows, count(DISTINCT text) AS vectors, true AS same FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def embed_once(spark, sf_dir):
    """Two builds with one table of vectors: as many vectors as different texts, equal to those of the plain form."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model, cache = M.embedder("hashed_tokens", dim=8), scratch_path(spark, "vectors-by-text")
    M.embed_once(docs.filter("doc_id % 2 = 0"), "text", model, 8, cache, "hashed_tokens", batch=200, max_tokens=WHOLE)
    once = M.embed_once(docs, "text", model, 8, cache, "hashed_tokens", batch=200, max_tokens=WHOLE)
    plain = M.embed(docs, "text", model, 8, batch=200, max_tokens=WHOLE).select("doc_id", F.col("vector").alias("wanted"))
    stored_vectors = spark.read.parquet(cache).count()
    rows = once.join(plain, "doc_id")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(stored_vectors).cast("long").alias("vectors"), F.every(F.col("vector") == F.col("wanted")).alias("same"))


@query(
    "index_store",
    f"""WITH {SNIPPETS_SQL}, p AS (SELECT *, {COLLECTION_SQL} AS collection FROM snippets)
SELECT collection, count(*) AS points, {TEXT_DIM} AS dimension, 'green' AS status FROM p WHERE doc_id % 3 <> 1 GROUP BY collection""",
)
def index_store(spark, sf_dir):
    """Build a stored index, then delete every third file and replace another third by itself."""
    listing = code_files(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "index"), buckets=4)
    points = _build(listing)
    store.build(points, scratch_path(spark, "b").rsplit("/", 1)[-1])
    touched = listing.filter("doc_id % 3 <> 0")
    keys = touched.select(P.collection_name(F.col("root")).alias("collection"), F.col("path").alias("file_path"))
    fresh = _build(touched.filter("doc_id % 3 = 2"))
    store.replace_files(keys, fresh, scratch_path(spark, "r").rsplit("/", 1)[-1])
    return store.info()


def _two_states(spark, sf_dir):
    """Files before, in which some are missing, outdated or gone since; their snapshot; and the current files."""
    current = _stamped(code_files(spark, sf_dir))
    n = F.col("doc_id") % 5
    outdated = F.when(n == 1, F.regexp_replace("text", "(?i)part_", "old_")).otherwise(F.col("text"))
    before = current.filter(n != 4).withColumn("text", outdated)
    old = I.file_snapshot(before).withColumnRenamed("modified", "last_indexed")
    return before, old, current.filter(n != 2)


CURRENT_SQL = f"""WITH {SNIPPETS_SQL} SELECT library, path AS file_path, member_name, start_line, end_line, md5(code) AS code_md5 FROM snippets WHERE doc_id % 5 <> 2"""


def _with_library(rows, current):
    names = current.select("library", P.collection_name(F.col("root")).alias("collection")).distinct()
    return rows.join(names, "collection").select(
        "library", "file_path", "member_name", "start_line", "end_line", F.md5("code").alias("code_md5")
    )


@query("incremental_rebuild", CURRENT_SQL)
def incremental_rebuild(spark, sf_dir):
    """From an index in which some files are missing, outdated or gone to the current one."""
    before, old, current = _two_states(spark, sf_dir)
    # The first build is stored: the index it stands for is a table, not a plan to run again.
    points = stored(_build(before), "points")
    return _with_library(I.incremental_rebuild(points, old, current, _build), current)


@query("incremental_store", CURRENT_SQL)
def incremental_store(spark, sf_dir):
    """The same with a stored index: only the buckets of changed files are opened and written."""
    before, old, current = _two_states(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "kept"), buckets=4)
    store.build(_build(before), "first")
    store.update(old, current, _build, "second")
    return _with_library(store.read(), current)


PRESENT_TEXTS = """SELECT 'd' AS kind, pid AS id, code AS text FROM p UNION ALL
    SELECT 'q' AS kind, CAST(item_id AS VARCHAR) AS id, text FROM benchmark"""


@query(
    "search_present",
    f"""WITH {SNIPPETS_SQL}, p AS (SELECT *, {POINT_ID_SQL} AS pid FROM (SELECT *, {COLLECTION_SQL} AS collection FROM snippets)),
{embed_sql(PRESENT_TEXTS)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found) AS rank FROM pairs)
SELECT CAST(r.query_id AS BIGINT) AS query_id, r.rank, printf('%.4f', r.score) AS score, substr(p.path, length('/repo/' || p.library) + 2) AS file,
  p.start_line, p.end_line, concat_ws(' | ', nullif(p.namespace, ''), p.class_name, p.member_name) AS details
FROM r JOIN p ON r.found = p.pid WHERE r.rank <= 3""",
)
def search_present(spark, sf_dir):
    """Search the benchmark texts in the built index and show file, lines and names."""
    model = M.embedder("hashed_tokens", dim=TEXT_DIM)
    listing = code_files(spark, sf_dir)
    points = stored(_build(listing), "points").withColumn("vec_id", F.col("point_id"))
    roots = listing.select(P.collection_name(F.col("root")).alias("collection"), "root").distinct()
    hits = knn.knn_join(asked_vectors(spark, sf_dir, model), points.select("vec_id", "vector"), 3)
    shown = I.present_hits(hits, points.join(roots, "collection"))
    return shown.select("query_id", F.col("rank").cast("long").alias("rank"), "score", "file", "start_line", "end_line", "details")


REQUESTS_SQL = """req AS (SELECT item_id, CASE WHEN item_id % 9 = 8 THEN ' ' ELSE text END AS text, item_id % 25 AS n,
  '/repo/src' || (item_id % 25) || CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/src' ELSE '/docs' END AS path, item_id % 7 AS k FROM benchmark)"""


def _requests(spark, sf_dir):
    """Benchmark texts as requests on libraries and folders; some are blank, ask for nothing or have no library."""
    item = F.col("item_id")
    folder = F.when(item % 3 == 0, "").when(item % 3 == 1, "/src").otherwise("/docs")
    return load(spark, sf_dir, "benchmark").select(
        item.alias("query_id"),
        F.when(item % 9 == 8, F.lit(" ")).otherwise(F.col("text")).alias("query"),
        F.concat(F.lit("/Repo/SRC"), (item % 25).cast("string"), folder).alias("path"),
        (item % 7).cast("int").alias("k"),
    )


def _ready_libraries(spark, sf_dir):
    number = F.substring("source", 4, 10).cast("int")
    return load(spark, sf_dir, "documents").select("source").distinct().select(
        F.concat(F.lit("/repo/"), "source").alias("root"), F.col("source").alias("name"),
        F.when(number % 8 == 7, "Indexing").otherwise("Completed").alias("status"),
    )


@query(
    "search_judged",
    f"""WITH {REQUESTS_SQL} SELECT item_id AS query_id, CASE WHEN trim(text) = '' THEN 'blank query' WHEN k < 1 THEN 'k below 1'
  WHEN n >= 20 THEN 'no library' WHEN n % 8 = 7 THEN 'status indexing' END AS reason FROM req""",
)
def search_judged(spark, sf_dir):
    return S.judge_requests(_requests(spark, sf_dir), _ready_libraries(spark, sf_dir)).select("query_id", "reason")


def _requests_sql(inside: bool) -> str:
    texts = """SELECT 'd' AS kind, pid AS id, code AS text FROM p UNION ALL
    SELECT 'q' AS kind, CAST(item_id AS VARCHAR) AS id, text FROM req"""
    place = "(p.path = q.path OR starts_with(p.path, q.path || '/'))" if inside else "p.library = 'src' || q.n"
    return f"""WITH {SNIPPETS_SQL}, {REQUESTS_SQL},
p AS (SELECT *, {POINT_ID_SQL} AS pid FROM (SELECT *, {COLLECTION_SQL} AS collection FROM snippets)),
{embed_sql(texts)},
h AS (SELECT q.item_id AS query_id, p.pid, pairs.score, q.k, q.path <> '/repo/src' || q.n AS from_parent,
  row_number() OVER (PARTITION BY q.item_id ORDER BY pairs.score DESC, p.pid) AS rank
  FROM pairs JOIN p ON p.pid = pairs.found JOIN req q ON CAST(q.item_id AS VARCHAR) = pairs.query_id
  WHERE q.n < 20 AND q.n % 8 <> 7 AND {place})
SELECT query_id, rank, pid AS point_id, round(score, 6) AS score, from_parent FROM h WHERE rank <= k"""


def _search(spark, sf_dir, inside):
    points = stored(_build(code_files(spark, sf_dir)), "points")
    model = M.embedder("hashed_tokens", dim=TEXT_DIM)
    hits = S.search_requests(
        _requests(spark, sf_dir), _ready_libraries(spark, sf_dir), points, model, TEXT_DIM, WHOLE, inside_path=inside, batch=100
    )
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("point_id"), F.round("score", 6).alias("score"), "from_parent"
    )


@query("search_requests", _requests_sql(False))
def search_requests(spark, sf_dir):
    """Requests answered from the collection of their nearest library."""
    return _search(spark, sf_dir, False)


@query("search_inside_path", _requests_sql(True))
def search_inside_path(spark, sf_dir):
    """The same requests, answered only from files below the asked folder."""
    return _search(spark, sf_dir, True)
