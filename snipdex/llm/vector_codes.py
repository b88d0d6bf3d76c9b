"""Vector code compression: product codes by slices of sorted coordinates and intersected bitmasks.

A vector's numbers become integers (floor of 4096 times the number) and are cut into consecutive parts; each part is
replaced by the index of its nearest codebook entry. The nearest entry is found without a look at most entries: every
dimension of a codebook has its entries' coordinates sorted, with a mask (uint64 words, a bit per entry) of the entries
in every prefix. An initial radius is the distance to the best of the entries that are close in one dimension; no nearer entry can lie
outside the box of that radius. Per dimension two bisections give the slice of coordinates inside the box, the difference of
two prefix masks gives its entries, and the AND over all dimensions gives the exact candidates, whose distances are
then computed in integers.

Codebooks are trained in rounds over all vectors. A task gives out one row of sums per part and entry, whatever its
number of vectors; these are summed by Spark, and only the codebooks (entries times length numbers) reach the driver.

Results: rows with a null vector, or with null or non-finite numbers, are left out. Codebooks have the length of the
vector with the smallest usable id (nulls last, repeated ids in the order of their numbers); vectors of another length,
and those with numbers so large that a squared distance could leave 64 bits, are returned with code and error null and
take no part in training. A length that the number of parts does not divide gives parts that differ by one; empty
vectors have empty parts, entry 0 and error 0. With fewer vectors than entries the codebooks are smaller. Repeated rows
count each time. Ties go to the lower entry. An empty table gives no rows. Columns besides id, vector and `carry` are
not read; those three are renamed on the way, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.session import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


class Slices:
    """One part's codebook with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        words = (k + 63) // 64
        order = np.argsort(entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(entries, order, axis=0)
        bit = np.zeros((k, words), "<u8")
        bit[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype("<u8")
        self.prefix = np.zeros((width, k + 1, words), "<u8")
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        self.all = np.bitwise_or.reduce(bit, axis=0)
        self.order = order

    def radius(self, rows: np.ndarray) -> np.ndarray:
        """A distance, rounded up, at which every row has an entry: the best of those close in some dimension."""
        least = np.full(len(rows), np.inf if rows.shape[1] else 0.0)
        for d in range(rows.shape[1]):
            column, x = self.coordinates[:, d], rows[:, d]
            above = np.clip(np.searchsorted(column, x), 0, len(column) - 1)
            below = np.maximum(above - 1, 0)
            place = np.where(np.abs(x - column[below]) < np.abs(column[above] - x), below, above)
            gap = rows - self.entries[self.order[place, d]]
            least = np.minimum(least, np.einsum("ij,ij->i", gap, gap))
        return (np.sqrt(least) * (1 + 1e-12)).astype(np.int64) + 1

    def candidates(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that lie in the box of each row."""
        masks = np.broadcast_to(self.all, (len(rows), len(self.all))).copy()
        for d in range(rows.shape[1]):
            low = np.searchsorted(self.coordinates[:, d], rows[:, d] - radius, side="left")
            high = np.searchsorted(self.coordinates[:, d], rows[:, d] + radius, side="right")
            masks &= self.prefix[d, high] & ~self.prefix[d, low]
        return masks

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry, the lower one of equals, and its squared distance."""
        masks = self.candidates(rows, self.radius(rows))
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        gap = rows[row] - self.entries[entry]
        far = np.einsum("ij,ij->i", gap, gap)
        first = np.searchsorted(row, np.arange(len(rows)))
        least = np.minimum.reduceat(far, first)
        best = np.flatnonzero(far == least[row])
        return entry[best[np.searchsorted(row[best], np.arange(len(rows)))]], least


def cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def _integers(vectors: DataFrame, id_col: str, vector_col: str, carry: tuple[str, ...], scale: int) -> DataFrame:
    """Rows (c0 = id, c1.. = carried columns, size, numbers): integers as bytes, null where a distance could overflow."""
    kinds = dict(vectors.dtypes)
    names = [id_col, *carry]
    plain = vectors.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), F.col(vector_col).alias("vector")).filter("vector is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            numbers = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[: offsets[-1]]  # nulls become NaN
            limit = np.zeros(len(numbers))
            limit[offsets[0] :] = np.repeat(np.sqrt(2.0**60 / np.maximum(sizes, 1)), sizes)
            with np.errstate(all="ignore"):
                scaled = np.floor(scale * numbers)
                bad, over = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(numbers), ~(np.abs(scaled) < limit)))
            kept = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
            usable = over[offsets[1:]] == over[offsets[:-1]]
            whole = np.where(np.abs(scaled) < limit, scaled, 0).astype("<i4")
            packed = [whole[offsets[i] : offsets[i + 1]].tobytes() if usable[i] else None for i in kept]
            rows = batch.take(pa.array(kept))
            columns = [*rows.columns[: len(names)], pa.array(sizes[kept].astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names[: len(names)], "size", "numbers"])

    schema = ", ".join(f"c{i} {kinds[n]}" for i, n in enumerate(names)) + ", size int, numbers binary"
    return plain.mapInArrow(run, schema)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), size).astype(np.int64)


def _sums(usable: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """Rows (part, entry, rows, sums), one per entry that a task has used."""
    edges = cuts(size, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            rows = _rows(batch.column(0), size)
            for p, book in enumerate(slices):
                part = rows[:, edges[p] : edges[p + 1]]
                entry, _ = book.nearest(part)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                np.add.at(sums[p], entry, part)
        out = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        part, entry, n, total = ([r[i] for r in out] for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([int(e) for e in entry], pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))], names=["part", "entry", "rows", "sums"]
        )

    return usable.select("numbers").mapInArrow(run, "part int, entry int, rows long, sums array<long>")


class Codebooks:
    """Entries per part, for vectors of one length."""

    def __init__(self, size: int, books: list[np.ndarray]):
        self.size = size
        self.books = books

    def digest(self) -> str:
        """SHA-256 of all numbers by part, entry and position, as text with commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.reshape(-1)).encode()).hexdigest()

    def decode(self, code: list[int], scale: int = SCALE) -> list[float]:
        """The numbers that a code stands for: the middle of each entry's interval."""
        return [(int(x) + 0.5) / scale for book, e in zip(self.books, code) for x in book[e]]


def _train(numbers: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks from rows of `_integers`."""
    order = [F.col("c0").asc_nulls_last(), "numbers"]
    ready = numbers.filter("numbers is not null")
    head = ready.orderBy(*order).limit(1).collect()
    if not head:
        return Codebooks(0, [])
    size = head[0]["size"]
    usable = ready.filter(F.col("size") == size)
    chosen = [np.frombuffer(r["numbers"], "<i4").astype(np.int64) for r in usable.orderBy(*order).limit(entries).collect()]
    edges = cuts(size, parts)
    books = [np.stack([row[edges[p] : edges[p + 1]] for row in chosen]) for p in range(parts)]
    for _ in range(rounds):
        places = _sums(usable, books, size).select("part", "entry", "rows", F.posexplode("sums").alias("place", "value"))
        summed = places.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"), F.sum("rows").alias("rows")).collect()
        books = [b.copy() for b in books]
        for r in summed:
            books[r["part"]][r["entry"], r["place"]] = r["value"] // r["rows"]
    return Codebooks(size, books)


def _encode(numbers: DataFrame, model: Codebooks, names: list[str]) -> DataFrame:
    size, books = model.size, model.books
    edges = cuts(size, max(1, len(books)))
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            sizes, packed = batch.column(last).to_numpy(), batch.column(last + 1)
            fits = np.flatnonzero((sizes == size) & packed.is_valid().to_numpy(zero_copy_only=False)) if books else np.zeros(0, np.int64)
            codes: list[list[int] | None] = [None] * len(batch)
            errors: list[int | None] = [None] * len(batch)
            if len(fits):
                rows = _rows(packed.take(pa.array(fits)), size)
                found = [book.nearest(rows[:, edges[p] : edges[p + 1]]) for p, book in enumerate(slices)]
                code = np.stack([f[0] for f in found], axis=1).tolist()
                error = np.sum([f[1] for f in found], axis=0).tolist()
                for i, c, e in zip(fits.tolist(), code, error):
                    codes[i], errors[i] = c, e
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())], names=[*batch.schema.names[:last], "code", "error"])

    kinds = dict(numbers.dtypes)
    schema = ", ".join(f"c{i} {kinds[f'c{i}']}" for i in range(last)) + ", code array<int>, error long"
    return numbers.mapInArrow(run, schema).toDF(*names, "code", "error")


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all usable vectors."""
    return _train(stored(_integers(vectors, id_col, vector_col, (), scale), "numbers"), parts, entries, rounds)


def encode(vectors: DataFrame, model: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """Rows (id, carried columns, code, error) under given codebooks."""
    return _encode(_integers(vectors, id_col, vector_col, carry, scale), model, [id_col, *carry])


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """Codebooks trained on the vectors, and rows (id, carried columns, code, error) of them; the integers are stored once."""
    numbers = stored(_integers(vectors, id_col, vector_col, carry, scale), "numbers")
    model = _train(numbers, parts, entries, rounds)
    return _encode(numbers, model, [id_col, *carry]), model
