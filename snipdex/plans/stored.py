"""Sources and sinks over files that Spark writes from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.operators import embed as M
from snipdex.operators import extract as E
from snipdex.operators import index as I
from snipdex.operators import knn
from snipdex.plans.catalog import query
from snipdex.plans.domain import CHANGES_SQL, REGISTRY_SQL, changes, files, load, registry
from snipdex.plans.maintenance import COLLECTION_SQL
from snipdex.plans.snippets import SNIPPETS_SQL, code_files
from snipdex.plans.vectors import DIM, VECTORS_SQL
from snipdex.session import scratch_path
from snipdex.sources import change_records, registry_tables
from snipdex.sources.files import scan_files, scan_patterns
from snipdex.sources.index_store import IndexStore
from snipdex.streaming import changes as C


def _tree(spark, sf_dir):
    """All texts as files, in one folder per language."""
    path = scratch_path(spark, "tree")
    load(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    return path


def _by_folder(scanned):
    folder = F.regexp_extract("rel_path", "^([^/]+)/", 1)
    return scanned.groupBy(folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("text")).alias("text_bytes"))


TREE_SQL = "SELECT 'lang=' || lang AS folder, sum(strlen(text) + 1) AS bytes, sum(strlen(text) + 1) AS text_bytes FROM documents"


@query("scan_tree", f"{TREE_SQL} WHERE lang <> 'de' GROUP BY lang")
def scan_tree(spark, sf_dir):
    return _by_folder(scan_files(spark, _tree(spark, sf_dir), ["*.txt"], ["lang=de"]))


@query("scan_tree_patterns", f"{TREE_SQL} GROUP BY lang")
def scan_tree_patterns(spark, sf_dir):
    """Every file matches several patterns and comes once."""
    return _by_folder(scan_patterns(spark, _tree(spark, sf_dir), ["*.txt", "part-*", "*.md"]))


def _records(spark, sf_dir, folder):
    """Change records of all events, then a second state of every third."""
    rows = changes(spark, sf_dir).withColumns(
        {"event_id": F.col("event_id").cast("string"), "status": F.lit("Pending"), "retry_count": F.lit(0), "last_retry_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")}
    )
    change_records.append_changes(rows, folder, "2024-03-01")
    again = rows.filter(F.col("event_id").cast("long") % 3 == 0).withColumns({"status": F.lit("Failed"), "retry_count": F.lit(1)})
    change_records.append_changes(again, folder, "2024-03-02")


@query(
    "change_records",
    f"""WITH {CHANGES_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, library, path, change_type,
  CASE WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS retry_count FROM changes""",
)
def change_records_stored(spark, sf_dir):
    folder = scratch_path(spark, "records")
    _records(spark, sf_dir, folder)
    return change_records.read_changes(spark, folder).select("event_id", "library", "path", "change_type", "status", "retry_count")


@query("change_records_stream", f"WITH {CHANGES_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, path FROM changes")
def change_records_stream(spark, sf_dir):
    """Records as a stream; an event whose record comes twice is kept once."""
    folder = scratch_path(spark, "landing")
    _records(spark, sf_dir, folder)
    once = C.drop_repeats(change_records.stream_changes(spark, folder), "365 days")
    out = scratch_path(spark, "landed")
    run = once.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(once.schema).parquet(out).select("event_id", "path")


@query("change_records_rejected", f"WITH {CHANGES_SQL} SELECT '{{damaged ' || event_id AS document FROM changes WHERE event_id % 7 = 0")
def change_records_rejected(spark, sf_dir):
    """A landing folder in which every seventh event has left a damaged line too: the stream gives them out by themselves."""
    folder = scratch_path(spark, "landing")
    _records(spark, sf_dir, folder)
    lines = changes(spark, sf_dir).filter("event_id % 7 = 0").select(F.concat(F.lit("{damaged "), F.col("event_id").cast("string")).alias("value"))
    lines.write.mode("append").text(folder)
    rejected = change_records.stream_rejected(spark, folder)
    out = scratch_path(spark, "rejected")
    rejected.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rejected.schema).parquet(out)


@query("registry_stored", f"WITH {REGISTRY_SQL} SELECT id, name, collection_name, total_files FROM registry")
def registry_stored(spark, sf_dir):
    """Even libraries are written first, odd ones appended; appending any of them again is refused."""
    base, rows = scratch_path(spark, "registry"), registry(spark, sf_dir)
    registry_tables.write_table(rows.filter("id % 2 = 0"), base, "libraries")
    registry_tables.write_table(rows.filter("id % 2 = 1"), base, "libraries", mode="append")
    try:
        registry_tables.write_table(rows.filter("id % 5 = 0"), base, "libraries", mode="append")
    except ValueError:
        pass  # as wanted: otherwise the rows below come twice
    return registry_tables.read_table(spark, base, "libraries").select("id", "name", "collection_name", "total_files")


@query("legacy_stored", f"WITH {REGISTRY_SQL} SELECT CAST(id AS VARCHAR) AS id, name, CAST(total_files AS INTEGER) AS files FROM registry")
def legacy_stored(spark, sf_dir):
    """One configuration document per library; keys are Pascal-cased in even rows."""
    rows, path = registry(spark, sf_dir), scratch_path(spark, "legacy")

    def document(names):
        mapping, key, name, stats, files_ = names
        inner = F.struct(F.col("id").cast("string").alias(key), F.col("name").alias(name), F.struct(F.col("total_files").alias(files_)).alias(stats))
        return F.to_json(F.struct(F.array(inner).alias(mapping)))

    camel = ("codebaseMappings", "id", "friendlyName", "statistics", "totalFiles")
    pascal = tuple(n[0].upper() + n[1:] for n in camel)
    text = F.when(F.col("id") % 2 == 0, document(pascal)).otherwise(document(camel))
    rows.select(F.col("id").alias("folder"), text.alias("text")).write.partitionBy("folder").text(path)
    found = registry_tables.read_legacy_config(spark, path).select(F.explode("codebaseMappings").alias("m"))
    return found.select("m.id", F.col("m.friendlyName").alias("name"), F.col("m.statistics.totalFiles").alias("files"))


@query(
    "single_search",
    f"""WITH {VECTORS_SQL}, s AS (SELECT b.vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score FROM e a, e b WHERE a.vec_id = 0)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 7""",
)
def single_search(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    wanted = list(vectors.filter("vec_id = 0").first()["vector"])
    assert len(wanted) == DIM
    return knn.search(vectors, wanted, 7).select("vec_id", F.round("score", 6).alias("score"))


@query("embed_fallback", "SELECT doc_id, length(text) % 3 <> 0 AS embed_ok, CASE WHEN length(text) % 3 <> 0 THEN 1.0 ELSE 0.0 END AS first FROM documents")
def embed_fallback(spark, sf_dir):
    """A model that refuses every third length: those rows stay, with a zero vector and the mark."""

    def model(texts):
        if any(len(t) % 3 == 0 for t in texts):
            raise ValueError("refused")
        return [[1.0, 0.0]] * len(texts)

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = M.embed(docs, "text", model, 2, batch=1, attempts=2, base_ms=0, max_tokens=1 << 30)
    return rows.select("doc_id", "embed_ok", F.get("vector", F.lit(0)).cast("double").alias("first"))


@query(
    "index_rebuild_drop",
    f"""WITH {SNIPPETS_SQL}, p AS (SELECT *, {COLLECTION_SQL} AS collection FROM snippets)
SELECT collection, count(*) AS points FROM p WHERE doc_id % 2 = 0 AND library <> 'src0' GROUP BY collection""",
)
def index_rebuild_drop(spark, sf_dir):
    """Build from all files, rebuild from the even ones, drop one collection."""
    listing = code_files(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "rebuilt"), buckets=2)
    build = lambda rows: I.build_index(rows, M.embedder("hashed_tokens", dim=8), 8, batch=200)
    store.build(build(listing), "all")
    # Libraries without an even file would keep their first build: they are dropped like the one by name.
    even = listing.filter("doc_id % 2 = 0")
    stale = listing.select("library", "root").distinct().join(even.select("library").distinct(), "library", "left_anti")
    store.build(build(even), "even")
    named = listing.filter("library = 'src0'").select("library", "root").distinct()
    from snipdex.functions import paths as P

    for row in stale.union(named).select(P.collection_name(F.col("root")).alias("c")).distinct().collect():  # libraries, not files
        store.drop_collection(row["c"])
    return store.info().select("collection", "points")


@query("snippets_in_sql", f"WITH {SNIPPETS_SQL} SELECT path, member_name, start_line FROM snippets")
def snippets_in_sql(spark, sf_dir):
    """The snippets as a view for SQL."""
    code_files(spark, sf_dir).select("path", "text").createOrReplaceTempView("snippet_sources")
    E.register_sql(spark, "snippet_sources")
    return spark.sql("SELECT path, member_name, start_line FROM snippets")
