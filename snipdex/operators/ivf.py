"""A stored inverted file for nearest neighbours: approximate search by lists, exact search with bounds.

Unit vectors are dealt to the nearest of trained centroids (their list) and, within a list, to rings of equal distance
to the centroid. A list and a ring make up a block. The table lies in folders by list, so that a search opens only the
lists that it asks. Per block a row of numbers is kept: how many vectors it has, and the least and largest distance of
these to each of some pivots and to their own centroid. That row count depends on lists and rings alone.

* `search` asks the `probes` nearest lists of every query. How many that are comes from `choose_probes`, which measures
  the recall on a stated set of queries against exact search.
* `search_exact` gives the rows of `knn.knn_join`, but scores only blocks that can hold a result. A first pass over the
  nearest lists gives a score that the k-th best has to reach. By the triangle inequality no vector of a block is closer
  to the query than the largest gap between the query's distance to a pivot and the block's range of distances to it;
  where even that does not reach the score (or the threshold), the block is skipped.

Few queries are broadcast and meet the table where it lies, without a shuffle of vectors. Beyond a bound queries and
blocks meet by key, in pieces of bounded rows. Centroids are trained on a bounded sample (`SAMPLE`, by a hash of the
ids); every vector is indexed. Vectors of another length, and those without a direction, are not.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.operators import knn
from snipdex.session import stored

SAMPLE = 1 << 16
SAMPLE_BYTES = 64 << 20
MAX_LISTS = 4096
ROUNDS = 6
RINGS = 32
PIVOTS = 16
#: Distances and scores are rounded; a bound must not miss by that.
SLACK = 1e-6


@dataclass
class InvertedFile:
    """An opened index: the table of vectors by list and ring, and what is known of the blocks."""

    vectors: DataFrame
    centroids: np.ndarray
    blocks: np.ndarray  # list, ring
    counts: np.ndarray
    low: np.ndarray  # least distance of each block to every pivot, then to its centroid
    high: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @property
    def pivots(self) -> np.ndarray:
        return self.centroids[:PIVOTS]

    def rows(self) -> int:
        return int(self.counts.sum())

    def list_sizes(self) -> np.ndarray:
        return np.bincount(self.blocks[:, 0], weights=self.counts, minlength=len(self.centroids)).astype(np.int64)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * rows @ centres.T))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(size > 0, size, 1)[:, None]


def train_centroids(vectors: DataFrame, dim: int, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Directions of up to `lists` clusters of (vec_id, vector), trained on a sample of at most about `SAMPLE` rows.

    Every round sums the sample by its nearest centroid, a row per centroid and task.
    """
    ready = knn.valid_vectors(vectors, "vector", dim).select("vec_id", "vector")
    rows = ready.count()
    wanted = max(lists, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    part = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, rows // wanted)))
    sample = stored(ready.filter(part == 0), "ivf-sample")
    first = sample.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(lists).collect()
    if not first:
        return np.zeros((0, dim))
    centroids = _unit(np.array([r["vector"] for r in first], dtype=np.float64))
    centroids = centroids[np.abs(centroids).sum(axis=1) > 0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, usable = knn._matrix(batch.column("vector"), dim)
            matrix = matrix[usable]
            nearest = (matrix @ centroids.T).argmax(axis=1)
            np.add.at(total, nearest, matrix)
            count += np.bincount(nearest, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["list", "total"])

    for _ in range(rounds):
        if not len(centroids):
            break
        placed = sample.mapInArrow(sums, "list long, total array<double>").select("list", F.posexplode("total"))
        moved = centroids.copy()
        for r in placed.groupBy("list", "pos").agg(F.sum("col").alias("x")).collect():
            moved[r["list"], r["pos"]] = r["x"]
        moved = _unit(moved)
        centroids = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centroids)
    return centroids


def build(vectors: DataFrame, path: str, dim: int, lists: int | None = None, rounds: int = ROUNDS, rings: int = RINGS, seed: int = 7) -> None:
    """Write the index of (vec_id, vector) below `path`: the vectors by list, and the row of every block.

    Without `lists` there are about as many as the root of the number of vectors.
    """
    spark = vectors.sparkSession
    if lists is None:
        lists = max(1, min(MAX_LISTS, round(math.sqrt(vectors.count()))))
    centroids = train_centroids(vectors, dim, min(lists, MAX_LISTS), rounds, seed)
    pivots = centroids[:PIVOTS]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    item = vectors.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centroids):
                continue
            matrix, usable = knn._matrix(batch.column("vector"), dim)
            rows = np.flatnonzero(usable)
            matrix = matrix[rows]
            nearest = (matrix @ centroids.T).argmax(axis=1)
            own = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", matrix, centroids[nearest])))
            ring = np.minimum((own * (rings / 2)).astype(np.int64), rings - 1)
            far = np.concatenate([_distances(matrix, pivots), own[:, None]], axis=1)
            kept = batch.take(pa.array(rows))
            columns = [kept.column("vec_id"), kept.column("vector"), pa.array(far.tolist(), pa.list_(pa.float64())), pa.array(ring.astype(np.int32)), pa.array(nearest.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "far", "ring", "list"])

    ready = knn.valid_vectors(vectors, "vector", dim).select("vec_id", "vector")
    placed = ready.mapInArrow(place, f"vec_id {kind}, vector {item}, far array<double>, ring int, list int")
    # Rebalancing by list keeps the files of a list few and splits the lists that hold much.
    dealt = placed.hint("rebalance", F.col("list")).sortWithinPartitions("list", "ring")
    if not len(centroids):
        placed.write.parquet(f"{path}/vectors")  # no folders, but a schema
        spark.createDataFrame([], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        spark.createDataFrame([], "list int, ring int, rows long, low array<double>, high array<double>").write.parquet(f"{path}/blocks")
        return
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    table.coalesce(1).write.parquet(f"{path}/centroids")
    far = [F.get("far", F.lit(i)) for i in range(len(pivots) + 1)]
    numbers = spark.read.parquet(f"{path}/vectors").groupBy("list", "ring").agg(
        F.count(F.lit(1)).alias("rows"), F.array(*(F.min(x) for x in far)).alias("low"), F.array(*(F.max(x) for x in far)).alias("high")
    )
    numbers.write.parquet(f"{path}/blocks")


def open_index(spark: SparkSession, path: str) -> InvertedFile:
    """The index below `path`. Centroids and rows of blocks (bounded by lists and rings) are read by the driver."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("list", "ring").collect()
    width = len(centroids[0]["centroid"]) if centroids else 0
    matrix = np.array([r["centroid"] for r in centroids], dtype=np.float64).reshape(len(centroids), width)
    edges = min(PIVOTS, len(matrix)) + 1
    return InvertedFile(
        spark.read.parquet(f"{path}/vectors"),
        matrix,
        np.array([(r["list"], r["ring"]) for r in blocks], dtype=np.int64).reshape(len(blocks), 2),
        np.array([r["rows"] for r in blocks], dtype=np.int64),
        np.array([r["low"] for r in blocks], dtype=np.float64).reshape(len(blocks), edges),
        np.array([r["high"] for r in blocks], dtype=np.float64).reshape(len(blocks), edges),
    )


def _asked(queries: DataFrame, dim: int) -> DataFrame:
    return knn.valid_vectors(queries, "q_vector", dim).select("query_id", "q_vector")


class Chooser:
    """Which blocks a query has to meet: the nearest lists, or those that can reach a score."""

    def __init__(self, index: InvertedFile):
        self.centroids, self.pivots = index.centroids, index.pivots
        self.blocks, self.counts, self.low, self.high = index.blocks, index.counts, index.low, index.high

    def nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Rows of queries by blocks: whether a block lies in one of the nearest lists."""
        score = q @ self.centroids.T
        chosen = np.zeros(score.shape, bool)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(chosen, best, True, axis=1)
        return chosen[:, self.blocks[:, 0]]

    def reach(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Rows of queries by blocks: whether a vector of the block can score at least the query's floor."""
        far = _distances(q, self.pivots)
        gap = np.zeros((len(q), len(self.blocks)))
        for p in range(far.shape[1]):
            gap = np.maximum(gap, np.maximum(self.low[None, :, p] - far[:, p, None], far[:, p, None] - self.high[None, :, p]))
        own = _distances(q, self.centroids)[:, self.blocks[:, 0]]
        gap = np.maximum(gap, np.maximum(self.low[None, :, -1] - own, own - self.high[None, :, -1]))
        gap = np.maximum(0.0, gap - SLACK)
        return 1 - gap * gap / 2 + SLACK >= floor[:, None]

    def chosen(self, q: np.ndarray, floor: np.ndarray | None, probes: int | None) -> np.ndarray:
        return self.nearest(q, probes) if probes is not None else self.reach(q, floor)


def _few(index: InvertedFile, rows: list, k: int, threshold: float | None, floors: np.ndarray | None, probes: int | None, kind) -> DataFrame:
    """Best k of every partition for queries that are known to be few."""
    from pyspark.sql import types as T

    spark = index.vectors.sparkSession
    schema = T.StructType(
        [T.StructField("query_id", kind), T.StructField("vec_id", index.vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    matrix, usable = knn._matrix(pa.array([r["q_vector"] for r in rows], pa.list_(pa.float64())), index.dim)
    names = [r["query_id"] for r, ok in zip(rows, usable) if ok]
    matrix = matrix[usable]
    floors = None if floors is None else floors[usable]
    chooser = Chooser(index)
    step = max(8, (1 << 22) // max(1, len(index.blocks)) // 8 * 8)
    parts = [chooser.chosen(matrix[i : i + step], None if floors is None else floors[i : i + step], probes) for i in range(0, len(matrix), step)]
    # A bit per query and block: at most 2,048 bits for each of a bounded number of blocks.
    bits = np.concatenate([np.packbits(p, axis=0) for p in parts]) if parts else np.zeros((0, len(index.blocks)), np.uint8)
    lists = sorted(set(index.blocks[bits.any(axis=0), 0].tolist()))
    by_block = {tuple(b): i for i, b in enumerate(index.blocks.tolist())}
    shared = spark.sparkContext.broadcast((matrix, names, by_block, bits))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, places, bits = shared.value
        out = knn._arrow(schema)
        best = (np.zeros(0, np.int64), None, np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column("list").to_numpy(), batch.column("ring").to_numpy()], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1), [True]]))
            vids = knn._ids(batch.column("vec_id"))
            v, ok = knn._matrix(batch.column("vector"), dim)
            for a, b in zip(edges[:-1], edges[1:]):
                own = np.flatnonzero(np.unpackbits(bits[:, places[int(where[a, 0]), int(where[a, 1])]])[: len(q)])
                if not len(own):
                    continue
                at, found, scores = knn._best(q[own], v[a:b][ok[a:b]], vids[a:b][ok[a:b]], k, threshold)
                at = own[at]
                if best[1] is not None:
                    at, found, scores = (np.concatenate(x) for x in zip(best, (at, found, scores)))
                best = knn._first_k(at, found, scores, k)
        if best[1] is not None:
            yield pa.RecordBatch.from_arrays(knn._hits([ids[i] for i in best[0]], None, best[1], best[2], out), schema=out)

    return index.vectors.filter(F.col("list").isin(lists)).select("vec_id", "vector", "list", "ring").mapInArrow(run, schema)


def _many(index: InvertedFile, queries: DataFrame, k: int, threshold: float | None, probes: int | None, cell_rows: int | None) -> DataFrame:
    """Queries and blocks meet by key; `floor` is a column of the queries where there are no probes."""
    chooser = Chooser(index)
    shared = index.vectors.sparkSession.sparkContext.broadcast(chooser)
    dim, has_floor = index.dim, probes is None
    names = ["query_id", "q_vector", "floor"] if has_floor else ["query_id", "q_vector"]
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value.blocks
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                q, usable = knn._matrix(part.column(1), dim)
                floor = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64) if has_floor else None
                chosen = shared.value.chosen(q, floor, probes) & usable[:, None]
                scopes = [(blocks[c, 0] * 64 + blocks[c, 1]).tolist() for c in chosen]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scopes, pa.list_(pa.int64()))], names=["query_id", "q_vector", "scopes"])

    asked = queries.select(*names).mapInArrow(run, f"query_id {kinds['query_id']}, q_vector {kinds['q_vector']}, scopes array<long>")
    asked = asked.select(F.explode("scopes").alias("scope"), "query_id", "q_vector")
    vectors = index.vectors.select((F.col("list") * 64 + F.col("ring")).cast("long").alias("scope"), "vec_id", "vector")
    size = cell_rows or max(1024, knn.CELL_BYTES // (8 * dim))
    return knn._by_blocks(asked, vectors, dim, k, threshold, True, size, few_scopes=True).drop("scope")


def _hits(index, queries, k, threshold, probes, exclude_self, max_broadcast, cell_rows) -> DataFrame:
    """Rows (query_id, vec_id, score) that hold the best k; probes None: of all blocks that reach the queries' `floor`."""
    wanted = k + 1 if exclude_self else k
    sample = queries.limit(max_broadcast + 1).collect()
    if len(sample) <= max_broadcast:
        floors = None if probes is not None else np.array([r["floor"] for r in sample], dtype=np.float64)
        hits = _few(index, sample, wanted, threshold, floors, probes, queries.schema["query_id"].dataType)
    else:
        hits = _many(index, queries, wanted, threshold, probes, cell_rows)
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("vec_id"))
    return hits


def search(
    index: InvertedFile,
    queries: DataFrame,
    k: int,
    probes: int,
    threshold: float | None = None,
    exclude_self: bool = False,
    max_broadcast: int = knn.MAX_BROADCAST_QUERIES,
    cell_rows: int | None = None,
) -> DataFrame:
    """Rows (query_id, vec_id, score, rank): the best k among the `probes` nearest lists of every (query_id, q_vector)."""
    hits = _hits(index, _asked(queries, index.dim), k, threshold, min(probes, len(index.centroids)), exclude_self, max_broadcast, cell_rows)
    return knn.rank_hits(hits, k)


def search_exact(
    index: InvertedFile,
    queries: DataFrame,
    k: int,
    threshold: float | None = None,
    exclude_self: bool = False,
    max_broadcast: int = knn.MAX_BROADCAST_QUERIES,
    cell_rows: int | None = None,
) -> DataFrame:
    """The rows of `knn.knn_join`, without the blocks that can hold none of them."""
    return knn.rank_hits(_hits(index, with_floors(index, queries, k, threshold, exclude_self, max_broadcast), k, threshold, None, exclude_self, max_broadcast, cell_rows), k)


def with_floors(
    index: InvertedFile, queries: DataFrame, k: int, threshold: float | None = None, exclude_self: bool = False, max_broadcast: int = knn.MAX_BROADCAST_QUERIES
) -> DataFrame:
    """Queries with a score that the k-th best neighbour has at least: the k-th of the nearest lists, or the threshold."""
    sizes = index.list_sizes()
    # Lists enough to hold k rows in the mean, so that most queries have a floor.
    probes = max(1, min(len(sizes), math.ceil(2 * (k + 1) * max(1, len(sizes)) / max(1, index.rows()))))
    asked = _asked(queries, index.dim)
    near = stored(search(index, asked, k, probes, threshold, exclude_self, max_broadcast), "ivf-near")
    kth = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    least = F.lit(threshold if threshold is not None else -1.0)
    return stored(asked.join(kth, "query_id", "left").select("query_id", "q_vector", F.greatest(F.coalesce("kth", least), least).alias("floor")), "ivf-floors")


def skipped_blocks(index: InvertedFile, queries: DataFrame) -> DataFrame:
    """Of queries with a floor: rows (query_id, blocks, skipped, vectors, scored): how much exact search leaves out."""
    shared = index.vectors.sparkSession.sparkContext.broadcast(Chooser(index))
    dim, kinds = index.dim, dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                q, usable = knn._matrix(part.column(1), dim)
                met = chooser.reach(q, part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)) & usable[:, None]
                n = len(part)
                numbers = [np.full(n, len(chooser.blocks)), (~met).sum(axis=1), np.full(n, chooser.counts.sum()), met @ chooser.counts]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in numbers)], names=["query_id", "blocks", "skipped", "vectors", "scored"])

    return queries.select("query_id", "q_vector", "floor").mapInArrow(run, f"query_id {kinds['query_id']}, blocks long, skipped long, vectors long, scored long")


def choose_probes(index: InvertedFile, queries: DataFrame, k: int, recall: float = 0.93, exclude_self: bool = False, max_queries: int = 512) -> tuple[int, float]:
    """The least number of lists with at least this recall (two standard errors above), and the recall measured with it.

    The default leaves room for query sets that are harder than the measured one.

    Measured on at most about `max_queries` of the queries (by a hash of their ids) against their exact neighbours in the
    whole index: a neighbour is found if its list is among the nearest ones of the query.
    """
    asked = _asked(queries, index.dim)
    rows = asked.count()
    part = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(max(1, rows // max_queries)))
    sample = stored(asked.filter(part == 0).limit(2 * max_queries), "ivf-measured")
    exact = knn.knn_join(sample, index.vectors.select("vec_id", "vector"), k, exclude_self=exclude_self)
    pairs = stored(exact.select("query_id", "vec_id"), "ivf-exact")  # k rows of each measured query
    found = index.vectors.select("vec_id", "list").join(F.broadcast(pairs), "vec_id").dropDuplicates(["query_id", "vec_id"]).select("query_id", "list").collect()
    if not found:
        return 1, 1.0
    names = {r["query_id"]: r["q_vector"] for r in sample.collect()}
    ids = {name: i for i, name in enumerate(names)}
    matrix = _unit(np.array(list(names.values()), dtype=np.float64))
    place = np.empty((len(matrix), len(index.centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(matrix @ index.centroids.T), axis=1, kind="stable"), np.arange(len(index.centroids))[None, :], axis=1)
    query = np.array([ids[r["query_id"]] for r in found])
    needed = place[query, [r["list"] for r in found]] + 1
    size = np.bincount(query, minlength=len(matrix))
    for probes in range(1, len(index.centroids) + 1):
        each = np.bincount(query, needed <= probes, minlength=len(matrix))[size > 0] / size[size > 0]
        if each.mean() - 2 * each.std() / math.sqrt(len(each)) >= recall:
            break
    return probes, float(each.mean())


def scored_share(index: InvertedFile, queries: DataFrame, probes: int) -> float:
    """Share of all pairs of queries and vectors that a search with so many probes scores."""
    shared = index.vectors.sparkSession.sparkContext.broadcast(Chooser(index))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, scored = 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                q, _ = knn._matrix(batch.column(0).slice(first, 256), dim)
                queries, scored = queries + len(q), scored + int((shared.value.nearest(q, probes) @ shared.value.counts).sum())
        yield pa.RecordBatch.from_arrays([pa.array([queries], pa.int64()), pa.array([scored], pa.int64())], names=["queries", "scored"])

    sums = _asked(queries, dim).select("q_vector").mapInArrow(run, "queries long, scored long").agg(F.sum("queries"), F.sum("scored")).first()
    return sums[1] / max(1, sums[0] * index.rows())


def save_settings(spark: SparkSession, path: str, probes: int, recall: float, k: int) -> None:
    """Keep the measured number of probes with the index."""
    spark.createDataFrame([(json.dumps({"probes": probes, "recall": recall, "k": k}),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
