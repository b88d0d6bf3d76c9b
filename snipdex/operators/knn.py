"""Cosine nearest-neighbour joins: exact and approximate.

Two exact forms give the same rows:

* few queries: the query matrix is broadcast (only after a bounded `limit(n + 1)` read has
  shown that it is small) and every partition keeps its own best k, so the vector table is
  read once and never shuffled;
* many queries: vectors and queries are both hashed into blocks of bounded size and meet in
  block pairs.  A pair of blocks gives k rows per query, never all pairs.

Scores are rounded to nine places before ranking.  The floating-point sum of a matrix product
depends on the shape of the block, and without rounding two equal vectors could change places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_PLACES = 9
MAX_BROADCAST_QUERIES = 2048
CELL_BYTES = 32 << 20
# Of exact search: unit vectors of a block, pairs of blocks for each core, rows that a block has at least.
BLOCK_BYTES, CELLS_PER_CORE, LEAST_ROWS = 96 << 20, 4, 1024
# Columns scored at once, candidates that are scored again at once, and the part of all pairs that may be candidates.
COLUMNS, WAITING, SPARSE = 4096, 1 << 20, 64
MAX_FEW_SCOPES = 1 << 18
# Of `knn_lsh`: sampled queries and vectors, settings tried, and what moving a row costs in scores.
SAMPLE_QUERIES, SAMPLE_VECTORS, SAMPLE_BYTES = 512, 2048, 64 << 20
TABLES, BITS, PROBES = (8, 16), range(4, 25, 2), (4, 16, 64)
SHUFFLED_ROW = 500
# Copies of a query and of its share of the vectors that `knn_lsh` may shuffle: what it moves grows with the rows only.
MAX_COPIES = 64
NEAREST_BITS = 8


def valid_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has the declared length."""
    return df.filter(F.size(column) == dim)


def rejected_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows that `valid_vectors` drops."""
    return df.filter(F.col(column).isNull() | (F.size(column) != dim))


def _matrix(array: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and a mask of the rows that have a usable length."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat.reshape(-1, dim)
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    usable = np.isfinite(lengths) & (lengths > 0)
    return rows / np.where(usable, lengths, 1.0)[:, None], usable


def _ids(array: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = array.to_numpy() if isinstance(array, pa.ChunkedArray) else array.to_numpy(False)
    return values.astype(str) if values.dtype == object else values


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, threshold: float | None):
    """Row numbers of q, ids and scores of the best k per row; equal scores go by id."""
    scores = np.round(q @ v.T, SCORE_PLACES)
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    if threshold is not None:
        floor = np.maximum(floor, threshold)
    rows, cols = np.nonzero(scores >= floor[:, None])
    return _first_k(rows, ids[cols], scores[rows, cols], k)


class _Side:
    """The usable rows of a block: as they are, their lengths, and unit rows in single precision."""

    def __init__(self, array: pa.ChunkedArray, ids: np.ndarray, dim: int):
        flat = np.asarray(array.combine_chunks().flatten().to_numpy(zero_copy_only=False))
        rows = (flat if flat.dtype.kind == "f" else flat.astype(np.float64)).reshape(-1, dim)
        lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
        usable = np.isfinite(lengths) & (lengths > 0)
        whole = usable.all()
        self.rows, self.lengths, self.ids = (rows, lengths, ids) if whole else (rows[usable], lengths[usable], ids[usable])
        self.single = np.empty(self.rows.shape, dtype=np.float32)
        for start in range(0, len(self), COLUMNS):
            self.single[start : start + COLUMNS] = self.unit(slice(start, start + COLUMNS))

    def __len__(self) -> int:
        return len(self.lengths)

    def unit(self, at) -> np.ndarray:
        return self.rows[at].astype(np.float64) / self.lengths[at][:, None]


def _best_of_block(q: _Side, v: _Side, k: int, threshold: float | None):
    """`_best` for two blocks, by slices of q: row numbers of q, ids and scores.

    Scores in single precision only choose the pairs that are scored in double precision: `margin` is more than they can be
    off, so none of the best k is lost. The floor of a row is the k-th score so far. Where many pairs are that close, as
    among copies, all are scored in double precision.
    """
    margin = (q.rows.shape[1] + 8) * 2.0**-22
    step = max(1, CELL_BYTES // (4 * COLUMNS))
    for start in range(0, len(q), step):
        some = slice(start, min(start + step, len(q)))
        size = some.stop - start
        floor = np.full(size, -np.inf if threshold is None else threshold - margin, dtype=np.float32)
        best, waiting, merge_at = (np.zeros(0, np.int64), v.ids[:0], np.zeros(0)), [], 1
        blocks = range(0, len(v), COLUMNS)
        for number, first in enumerate(blocks, 1):
            columns = slice(first, min(first + COLUMNS, len(v)))
            scores = q.single[some] @ v.single[columns].T
            if number == 1 and scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - np.float32(2 * margin))
            close = scores >= floor[:, None]
            if np.count_nonzero(close) > scores.size // SPARSE:
                for half in range(0, size, step // 2 or 1):
                    part = slice(start + half, min(start + half + (step // 2 or 1), some.stop))
                    rows, ids, exact = _best(q.unit(part), v.unit(columns), v.ids[columns], k, threshold)
                    waiting.append((rows + half, ids, exact))
            else:
                rows, cols = np.nonzero(close)
                exact = np.round(np.einsum("ij,ij->i", q.unit(start + rows), v.unit(first + cols)), SCORE_PLACES)
                good = slice(None) if threshold is None else exact >= threshold
                waiting.append((rows[good], v.ids[first + cols[good]] if threshold is not None else v.ids[first + cols], exact[good]))
            if number >= merge_at or number == len(blocks) or sum(len(w[0]) for w in waiting) > WAITING:
                best = _first_k(*(np.concatenate(p) for p in zip(best, *waiting)), k)
                waiting, merge_at = [], 2 * number
                full = np.searchsorted(best[0], np.arange(size), side="right")
                held = full - np.searchsorted(best[0], np.arange(size), side="left") == k
                floor[held] = np.maximum(floor[held], best[2][full[held] - 1] - 2 * margin)
        if len(blocks):
            yield start + best[0], best[1], best[2]


def _block_rows(n_queries: int, n_vectors: int, dim: int, cores: int) -> int:
    """Rows of a block, so that all cores have several pairs of blocks.

    Each row goes to as many places as the other side has blocks. Large blocks keep that small on large tables, since the
    shuffle grows with rows times blocks; small ones deal a small table to all cores.
    """
    even = math.ceil(math.sqrt(n_queries * n_vectors / (CELLS_PER_CORE * cores)))
    return min(max(LEAST_ROWS, BLOCK_BYTES // (8 * dim)), max(LEAST_ROWS, even))


def _first_k(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _hits(qids, scope, vids, scores, schema: pa.Schema):
    columns = [qids, vids, scores] if scope is None else [scope, qids, vids, scores]
    return [pa.array(c, type=f.type) for c, f in zip(columns, schema)]


def _hit_schema(queries: DataFrame, vectors: DataFrame, scoped: bool) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("vec_id", vectors.schema["vec_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    if scoped:
        fields.insert(0, T.StructField("scope", vectors.schema["scope"].dataType))
    return T.StructType(fields)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _by_broadcast(queries, rows, vectors, dim, k, threshold, scoped) -> DataFrame:
    """Best k of every partition for a query set that is known to be small."""
    schema = _hit_schema(queries, vectors, scoped)
    groups: dict = {}
    for row in rows:
        groups.setdefault(row["scope"] if scoped else None, []).append(row)
    packed = {}
    for scope, members in groups.items():
        matrix, usable = _matrix(pa.array([m["q_vector"] for m in members], pa.list_(pa.float64())), dim)
        ids = [m["query_id"] for m, ok in zip(members, usable) if ok]
        packed[scope] = (ids, matrix[usable])
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        best: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = _ids(batch.column("vec_id"))
            matrix, usable = _matrix(batch.column("vector"), dim)
            scopes = np.asarray(batch.column("scope").to_pylist(), dtype=object) if scoped else None
            for scope, (qids, q) in shared.value.items():
                mask = usable & (scopes == scope) if scoped else usable
                if not len(qids) or not mask.any():
                    continue
                rows, names = matrix[mask], ids[mask]
                step = max(1, CELL_BYTES // (8 * len(q)))
                for start in range(0, len(rows), step):
                    found = _best(q, rows[start : start + step], names[start : start + step], k, threshold)
                    if scope in best:
                        found = tuple(np.concatenate(p) for p in zip(best[scope], found))
                        found = _first_k(*found, k)
                    best[scope] = found
        for scope, (at, vids, scores) in best.items():
            qids = [shared.value[scope][0][i] for i in at]
            label = [scope] * len(qids) if scoped else None
            yield pa.RecordBatch.from_arrays(_hits(qids, label, vids, scores, out), schema=out)

    columns = ["scope", "vec_id", "vector"] if scoped else ["vec_id", "vector"]
    return vectors.select(*columns).mapInArrow(run, schema)


def _blocks_per_scope(df: DataFrame, name: str, cell_rows: int) -> DataFrame:
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int")
    return df.groupBy("scope").agg(blocks.alias(name))


def _by_blocks(queries, vectors, dim, k, threshold, scoped, cell_rows, few_scopes=False) -> DataFrame:
    """Best k of every pair of blocks; both sides are cut by a hash of their id.

    `few_scopes` says that the number of scopes is bounded, so that their block counts may be
    broadcast.
    """
    if scoped:
        grid = _blocks_per_scope(vectors, "v_blocks", cell_rows).join(
            _blocks_per_scope(queries, "q_blocks", cell_rows), "scope"
        )
        grid = F.broadcast(grid) if few_scopes else grid
        vectors, queries = vectors.join(grid, "scope"), queries.join(grid, "scope")
    else:
        counts = {"v_blocks": vectors.count(), "q_blocks": queries.count()}
        cell_rows = cell_rows or _block_rows(*counts.values(), dim, vectors.sparkSession.sparkContext.defaultParallelism)
        fixed = {n: F.lit(max(1, -(-c // cell_rows))) for n, c in counts.items()}
        vectors, queries = (df.withColumns({"scope": F.lit(0), **fixed}) for df in (vectors, queries))
    schema = _hit_schema(queries, vectors, True)
    # Fresh names: both sides may come from one table.
    placed_vectors = vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("v_blocks")).cast("int")).select(
        F.col("scope").alias("scope"), "vb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "vec_id", "vector"
    )
    placed_queries = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).select(
        F.col("scope").alias("scope"), F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("vb"), "qb", "query_id", "q_vector"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _arrow(schema)
        if left.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        q = _Side(left.column("q_vector"), np.asarray(left.column("query_id").to_pylist(), dtype=object), dim)
        v = _Side(right.column("vector"), _ids(right.column("vec_id")), dim)
        if not len(q) or not len(v):
            return out.empty_table()
        # The score matrix is built for a slice of both sides at a time.
        parts = []
        scope = left.column("scope")[0].as_py()
        for at, ids, scores in _best_of_block(q, v, k, threshold):
            names = q.ids[at].tolist()
            parts.append(_hits(names, [scope] * len(names), ids, scores, out))
        return pa.concat_tables([pa.Table.from_arrays(p, schema=out) for p in parts])

    key = ["scope", "vb", "qb"]
    hits = placed_queries.groupBy(*key).cogroup(placed_vectors.groupBy(*key)).applyInArrow(run, schema)
    return hits if scoped else hits.drop("scope")


def rank_hits(hits: DataFrame, k: int, scoped: bool = False) -> DataFrame:
    """The best k rows per query; equal scores go by id."""
    key = ["scope", "query_id"] if scoped else ["query_id"]
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    threshold: float | None = None,
    exclude_self: bool = False,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    cell_rows: int | None = None,
) -> DataFrame:
    """Top k vectors by cosine for each query.

    `queries` holds (query_id, q_vector), `vectors` holds (vec_id, vector); a `scope` column on
    both sides keeps the search within equal scopes; a NULL scope matches nothing.  Queries meet
    the vectors of their own length, one pass for each length among the queries; zero vectors
    match nothing.  Gives ([scope,] query_id, vec_id, score, rank).
    """
    scoped = "scope" in vectors.columns and "scope" in queries.columns
    if scoped:
        queries, vectors = queries.filter("scope IS NOT NULL"), vectors.filter("scope IS NOT NULL")
    asked = queries.filter(F.size("q_vector") > 0)
    sample = asked.limit(max_broadcast + 1).collect()
    few = len(sample) <= max_broadcast
    lengths = {len(r["q_vector"]) for r in sample} if few else {r[0] for r in asked.select(F.size("q_vector")).distinct().collect()}
    wanted = k + 1 if exclude_self else k
    hits = None
    for dim in sorted(lengths) or [1]:
        some_queries, some_vectors = valid_vectors(queries, "q_vector", dim), valid_vectors(vectors, "vector", dim)
        if few:
            rows = [r for r in sample if len(r["q_vector"]) == dim]
            part = _by_broadcast(some_queries, rows, some_vectors, dim, wanted, threshold, scoped)
        else:
            size = cell_rows or (max(1024, CELL_BYTES // (8 * dim)) if scoped else None)
            part = _by_blocks(some_queries, some_vectors, dim, wanted, threshold, scoped, size)
        hits = part if hits is None else hits.unionByName(part)
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("vec_id"))
    return rank_hits(hits, k, scoped)


def search(
    vectors: DataFrame, query: list[float], k: int = 5, threshold: float | None = None
) -> DataFrame:
    """One query against one collection: (vec_id, score), best first."""
    spark = vectors.sparkSession
    one = spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, q_vector array<double>")
    hits = knn_join(one, vectors.select("vec_id", "vector"), k, threshold)
    return hits.select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def _codes(rows: np.ndarray, tables: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes of each row, (rows, tables, 1 + probes): its own bucket, then its nearest neighbours.

    A neighbour flips a set of bits; sets go by the sum of the squared distances to their
    hyperplanes.  Sets are drawn from the NEAREST_BITS nearest bits, so there may be fewer than
    `probes`.
    """
    side = (rows @ _planes(rows.shape[1], tables, bits, seed)).reshape(len(rows), tables, bits)
    weights = 1 << np.arange(bits, dtype=np.int64)
    own = ((side > 0) * weights).sum(axis=2)[:, :, None]
    if not probes:
        return own
    margin = side * side
    near = np.argsort(margin, axis=2)[:, :, :NEAREST_BITS]
    sets = (np.arange(1 << near.shape[2])[:, None] >> np.arange(near.shape[2])) & 1
    cost = np.take_along_axis(margin, near, 2) @ sets.T
    best = np.argsort(cost, axis=2, kind="stable")[:, :, : 1 + probes]
    # The empty set costs nothing and is the first, so a row's own bucket is among them.
    return own ^ np.einsum("rtpb,rtb->rtp", sets[best], weights[near])


def _bucket_column(column: str, dim: int, tables: int, bits: int, probes: int, seed: int):
    """`_codes` as one array per vector; the number of the table stands above the bits."""

    @F.pandas_udf("array<bigint>")
    def buckets(series):
        import pandas as pd

        rows = np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, dim))
        base = np.arange(tables, dtype=np.int64)[:, None] << bits
        parts = (_codes(rows[i : i + 1024], tables, bits, probes, seed) + base for i in range(0, len(rows), 1024))
        return pd.Series([c for part in parts for c in part.reshape(len(part), -1)], dtype=object)

    return buckets(F.col(column))


def _sample(df: DataFrame, key: str, rows: int, wanted: int) -> list:
    """About `wanted` of the rows, by a hash of their key."""
    some = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(max(1, rows // wanted))) == 0
    return df.filter(some).limit(2 * wanted).collect()


def lsh_settings(
    queries: DataFrame, vectors: DataFrame, dim: int, k: int = 5, recall: float = 0.9, seed: int = 7, exclude_self: bool = False
) -> tuple[int, int, int] | None:
    """The cheapest (tables, bits, probes) with at least this recall; None if exact search is cheaper.

    The recall is measured on a sample of the queries (by a hash of their ids) against their exact
    neighbours in the whole table: a neighbour is found if one of its buckets is asked.  Two
    standard errors are kept above `recall`.  The cost of a setting is the share of a sample of
    vectors that meets the queries, and the rows that it moves, of which MAX_COPIES bounds the number:
    without a bound, a larger table pays for more copies of every row.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    wanted = min(SAMPLE_QUERIES, max(32, SAMPLE_BYTES // (8 * dim * k)))
    names = queries.select("query_id", "q_vector")
    asked = queries.sparkSession.createDataFrame(_sample(names, "query_id", n_queries, wanted), names.schema)
    exact = knn_join(asked, vectors.select("vec_id", "vector"), k, exclude_self=exclude_self)
    pairs = vectors.join(F.broadcast(exact.select("query_id", "vec_id")), "vec_id").join(F.broadcast(asked), "query_id")
    found = pairs.select("query_id", "vec_id", "q_vector", "vector").dropDuplicates(["query_id", "vec_id"]).collect()
    if not found:
        return None
    matrix = lambda rows, name: np.array([r[name] for r in rows], dtype=np.float64)
    q, v = matrix(found, "q_vector"), matrix(found, "vector")
    _, first, group = np.unique([str(r["query_id"]) for r in found], return_index=True, return_inverse=True)
    others = matrix(_sample(vectors.select("vec_id", "vector"), "vec_id", n_vectors, SAMPLE_VECTORS), "vector").reshape(-1, dim)
    least, best = float(n_vectors), None
    for tables in TABLES:
        for bits in BITS:
            copies = {p: tables * (1 + p) + tables * n_vectors / max(1, n_queries) for p in PROBES}
            moved = {p: SHUFFLED_ROW * c for p, c in copies.items()}
            # Few queries may have more copies, as long as they are no more rows than the copies of the vectors.
            bound = {p: max(MAX_COPIES, 2 * tables * n_vectors / max(1, n_queries)) for p in PROBES}
            tried = [p for p in PROBES if moved[p] < least and copies[p] <= bound[p]]
            if not tried:
                break
            near, far = _codes(v, tables, bits, 0, seed), _codes(others, tables, bits, 0, seed)
            asked_codes = _codes(q[first], tables, bits, max(tried), seed)
            reached = False
            for probes in tried:
                codes = asked_codes[:, :, : 1 + probes]
                met = (codes[group] == near).any(axis=(1, 2))
                each = np.bincount(group, met) / np.bincount(group)
                if each.mean() - 2 * each.std() / math.sqrt(len(each)) < recall:
                    continue
                reached, scored = True, 0
                for t in range(tables):
                    held, count = np.unique(far[:, t, 0], return_counts=True)
                    at = np.minimum(np.searchsorted(held, codes[:, t]), len(held) - 1)
                    scored += (count[at] * (held[at] == codes[:, t])).sum()
                cost = scored / (len(first) * len(others)) * n_vectors + moved[probes]
                if cost < least:
                    least, best = cost, (tables, bits, probes)
            if not reached:  # more bits find fewer
                break
    return best


def knn_lsh(
    queries: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int = 5,
    tables: int = 8,
    bits: int | None = None,
    probes: int = 4,
    seed: int = 7,
    exclude_self: bool = False,
    cell_rows: int | None = None,
    recall: float = 0.9,
) -> DataFrame:
    """Approximate `knn_join`: only vectors that share a sign bucket with the query are scored.

    Buckets come from random hyperplanes, so no training pass is needed and new vectors can be
    added at any time.  A crowded bucket is cut into blocks like any other scope.  More
    `tables` and `probes` raise the recall, more `bits` make the buckets smaller.  Without `bits`
    all three come from `lsh_settings`, which measures the recall on these tables; where no setting
    reaches `recall` at less than the cost of exact search, the rows are those of `knn_join`.
    """
    ready_q = valid_vectors(queries, "q_vector", dim)
    ready_v = valid_vectors(vectors, "vector", dim)
    if bits is None:
        found = lsh_settings(ready_q, ready_v, dim, k, recall, seed, exclude_self)
        if found is None:
            names = (ready_q.select("query_id", "q_vector"), ready_v.select("vec_id", "vector"))
            return knn_join(*names, k, exclude_self=exclude_self, cell_rows=cell_rows)
        tables, bits, probes = found
    spread_v = ready_v.select(
        F.explode(_bucket_column("vector", dim, tables, bits, 0, seed)).alias("scope"), "vec_id", "vector"
    )
    spread_q = ready_q.select(
        F.explode(_bucket_column("q_vector", dim, tables, bits, probes, seed)).alias("scope"),
        "query_id",
        "q_vector",
    )
    size = cell_rows or max(1024, CELL_BYTES // (8 * dim))
    wanted = k + 1 if exclude_self else k
    # At most tables * 2^bits buckets exist.
    hits = _by_blocks(spread_q, spread_v, dim, wanted, None, True, size, few_scopes=tables << bits <= MAX_FEW_SCOPES)
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("vec_id"))
    # A pair that meets in several tables is scored each time; keep it once.
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rank_hits(once, k)


def collection_info(points: DataFrame) -> DataFrame:
    """Points, vector length and status of each collection."""
    lengths = F.size("vector")
    counts = points.groupBy("collection").agg(
        F.count(F.lit(1)).alias("points"), F.min(lengths).alias("low"), F.max(lengths).alias("high")
    )
    status = F.when(F.col("low") == F.col("high"), "green").otherwise("mixed")
    return counts.select(
        "collection", "points", F.col("high").alias("dimension"), status.alias("status")
    )
