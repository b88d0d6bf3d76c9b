"""Near-duplicate vectors by an exact metric range join.

Cosine >= t of two vectors means that their unit vectors lie within r = sqrt(2 - 2 t). Pivots partition the unit
vectors: each belongs to the cell of its nearest pivot (its home). By the triangle inequality a vector within r of
one at home in another cell is no further than r from the border between the two cells, so it is copied to exactly
those cells; there each home vector meets all it can be linked with, and cells join independently. In a cell only
vectors whose distances to the pivot differ by at most r are compared.

Equal vectors are one class and take part once, with their number. A large cell is joined in tiles of `TILE` rows. A
tile gives out, per linked vector, its number of links and the smallest vector it is connected with in the tile, never
the pairs; sums and connected components of these are the result. Products are screened in single precision; what lies
within the error of the threshold is computed again in double precision.

The number of cells grows with the rows (`CELL_ROWS`, at most `MAX_CELLS`). How much is copied depends on the data:
vectors in clusters stay in few cells, but evenly spread vectors of many dimensions lie near all borders, so that every
cell gets most vectors and the work grows with the square of the rows - as for any exact method by distances.

Results: null, empty and zero vectors, and those with null or non-finite parts, are linked with nothing and are their
own component. Vectors of different lengths are not linked. Rows that repeat an id count as copies if their vectors are
equal. An empty table gives no rows; columns besides id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.llm.components import components
from snipdex.session import stored

CELL_ROWS = 8192
MAX_CELLS = 1024
TILE = 8192
PART = 512


def _packed(vectors: DataFrame, id_col: str, vector_col: str, item: str) -> DataFrame:
    """Rows (id, vector): the numbers as bytes, null if the vector cannot be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            numbers = lists.values.to_numpy(zero_copy_only=False).astype(item)  # nulls become NaN
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(lists)):
                part = numbers[offsets[i] : offsets[i + 1]]
                with np.errstate(over="ignore"):
                    usable = valid[i] and len(part) and np.isfinite(part).all() and part.any()
                out.append((part + 0).tobytes() if usable else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, f"id {kind}, vector binary")


def _units(packed: list[bytes], item: str) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = np.frombuffer(b"".join(packed), item).reshape(len(packed), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * rows @ pivots.T))


def _cells(classes: DataFrame, pivots: dict[int, np.ndarray], item: str, radius: float) -> DataFrame:
    """Each class with the cells it goes to: cell, whether it is at home there, and the distance to the pivot."""
    width = np.dtype(item).itemsize
    slack = 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            cells: list[list[dict]] = [[] for _ in packed]
            sizes = np.array([len(p) // width for p in packed])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for first in range(0, len(at), 4096):
                    some = at[first : first + 4096]
                    rows = _units([packed[i] for i in some], item)
                    if int(size) not in pivots:
                        for i in some:
                            cells[i].append({"cell": 0, "home": True, "distance": 0.0})
                        continue
                    centres = pivots[int(size)]
                    far = _distances(rows, centres)
                    between = _distances(centres, centres)
                    home = far.argmin(axis=1)
                    nearest = far[np.arange(len(some)), home]
                    # Distance from the plane between the home pivot and another one.
                    border = (far**2 - nearest[:, None] ** 2) / (2 * np.maximum(between[home], 1e-12))
                    goes = border <= radius + slack
                    goes[np.arange(len(some)), home] = True
                    for row, cell in zip(*np.nonzero(goes)):
                        cells[some[row]].append({"cell": int(cell), "home": bool(cell == home[row]), "distance": float(far[row, cell])})
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("home", pa.bool_()), ("distance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(p) // width for p in packed], pa.int32()), pa.array(cells, kind)], names=["id", "copies", "vector", "size", "cells"])

    kind = dict(classes.dtypes)["id"]
    return classes.select("id", "copies", "vector").mapInArrow(run, f"id {kind}, copies long, vector binary, size int, cells array<struct<cell:int,home:boolean,distance:double>>")


def _joined(pdf: pd.DataFrame, item: str, threshold: float, radius: float) -> pd.DataFrame:
    """Links of the tile's home rows: numbers, and for each linked row the smallest one it is connected with."""
    home, rest = pdf[pdf["role"] == "home"], pdf[pdf["role"] == "all"].sort_values("distance")
    if not len(home) or not len(rest):
        return pd.DataFrame({"id": pdf["id"][:0], "links": np.zeros(0, np.int64), "least": pdf["id"][:0]})
    home = home.sort_values("distance")
    x, y = _units(home["vector"].tolist(), item), _units(rest["vector"].tolist(), item)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    margin = 1e-5 + 1e-6 * x.shape[1]
    ids, others, copies = home["id"].to_numpy(), rest["id"].to_numpy(), rest["copies"].to_numpy()
    far_x, far_y = home["distance"].to_numpy(), rest["distance"].to_numpy()
    out_id, out_links, out_least = [], [], []
    for first in range(0, len(x), PART):
        part = slice(first, first + PART)
        lo = np.searchsorted(far_y, far_x[part].min() - radius - 1e-6)
        hi = np.searchsorted(far_y, far_x[part].max() + radius + 1e-6, side="right")
        product = x32[part] @ y32[lo:hi].T
        i, j = np.nonzero(product >= threshold - margin)
        near = np.flatnonzero(product[i, j] <= threshold + margin)
        keep = np.ones(len(i), bool)
        for k in range(0, len(near), 65536):
            some = near[k : k + 65536]
            keep[some] = np.einsum("ij,ij->i", x[part][i[some]], y[lo:hi][j[some]]) >= threshold
        keep &= ids[part][i] != others[lo:hi][j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        here, there, many = ids[part], others[lo:hi], copies[lo:hi]
        links = np.bincount(i, weights=many[j], minlength=len(here)).astype(np.int64)
        # The smallest connected id, passed along links until nothing changes; ids are compared by their order.
        names, code = np.unique(np.concatenate([here, there]), return_inverse=True)
        least = np.arange(len(names))
        left, right = code[: len(here)][i], code[len(here) :][j]
        while True:
            before = least.copy()
            low = np.minimum(least[left], least[right])
            np.minimum.at(least, left, low)
            np.minimum.at(least, right, low)
            least = least[least]
            if (least == before).all():
                break
        linked = np.flatnonzero(links)
        out_id.append(here[linked])
        out_links.append(links[linked])
        out_least.append(names[least[code[: len(here)][linked]]])
        touched = np.unique(right)
        out_id.append(names[touched])
        out_links.append(np.zeros(len(touched), np.int64))
        out_least.append(names[least[touched]])
    if not out_id:
        return pd.DataFrame({"id": pdf["id"][:0], "links": np.zeros(0, np.int64), "least": pdf["id"][:0]})
    return pd.DataFrame({"id": np.concatenate(out_id), "links": np.concatenate(out_links), "least": np.concatenate(out_least)})


def vector_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every vector."""
    item = "f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"
    radius = math.sqrt(2 - 2 * threshold)
    packed = stored(_packed(vectors, id_col, vector_col, item), "vectors")
    classes = packed.filter("vector is not null and id is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")
    rows = classes.count()
    n = max(1, min(MAX_CELLS, math.ceil(rows / CELL_ROWS)))
    chosen: dict[int, list[bytes]] = {}
    for r in classes.select("vector").orderBy(F.xxhash64("vector")).limit(n).collect():
        chosen.setdefault(len(r["vector"]) // np.dtype(item).itemsize, []).append(bytes(r["vector"]))
    pivots = {size: _units(some, item) for size, some in chosen.items()}
    dealt = stored(_cells(classes, pivots, item, radius), "cells")

    one = dealt.select("id", "copies", "vector", "size", F.explode("cells").alias("c")).select("id", "copies", "vector", "size", "c.*")
    # A row per cell and length; lengths are few, but not bounded, so this is joined, not collected.
    fill = one.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("all_tiles"), F.ceil(F.count_if("home") / TILE).cast("int").alias("home_tiles"))
    one = one.join(fill.filter("home_tiles > 0"), ["size", "cell"])
    tile = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    as_home = F.transform(F.sequence(F.lit(0), F.col("all_tiles") - 1), lambda t: F.struct(tile("home_tiles").alias("x"), t.alias("y"), F.lit("home").alias("role")))
    as_any = F.transform(F.sequence(F.lit(0), F.col("home_tiles") - 1), lambda t: F.struct(t.alias("x"), tile("all_tiles").alias("y"), F.lit("all").alias("role")))
    tiles = one.withColumn("t", F.explode(F.when(F.col("home"), F.concat(as_home, as_any)).otherwise(as_any)))
    kind = dict(packed.dtypes)["id"]
    tiles = tiles.select("id", "copies", "vector", "distance", "size", "cell", "t.x", "t.y", "t.role")
    found = tiles.groupBy("size", "cell", "x", "y").applyInPandas(lambda pdf: _joined(pdf, item, threshold, radius), f"id {kind}, links long, least {kind}")
    found = stored(found, "vector-links")

    labels = stored(components(found, "id", "least"), "vector-labels")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "id", "left").join(labels, classes.id == labels.node, "left")
    classes = classes.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = packed.join(classes, "vector", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
