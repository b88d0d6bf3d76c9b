"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, and grouping.

1. Texts become sets of hashed five-word shingles and these SuperMinHash signatures, a block of rows at a time.
2. Documents with equal sets form a class; one representative of each goes on, so copies are never paired.
3. Signatures are cut into bands. In every bucket each member is paired with the smallest one; distinct pairs are
   verified on full sets and the verified ones joined into components.
4. Buckets whose members are then still in several components are compared across components: members outside the
   bucket's largest component meet all others in tiles of bounded size. Candidates differ in component, meet in no
   earlier band and have signatures that agree enough (`ESTIMATE`, five standard deviations below the threshold). A
   first pass over the tiles keeps the members with a candidate, a second one has their full sets and gives out
   verified links only. Pairs within a component cannot change the result and are never formed.

With 32 bands of 4 rows a pair at the threshold of 0.75 shares no bucket with a chance of 5 in a million; its signature
agrees in fewer than 71 of 128 bins with a chance of 5 in ten million.

Results: null, empty and blank texts have an empty set and are linked with nothing; each is its own component. Ties
do not occur, as the smallest id leads. Rows that repeat an id are treated as copies if their sets are equal; a null
id gets a component only from others. An empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import U64, Alphabet, list_array, mix, not_blank, text_chunks, word_hashes
from snipdex.llm.components import components
from snipdex.llm.superminhash import signatures
from snipdex.session import stored

SHINGLE = 5
PERCENT = 75
BINS = 128
ROWS = 4
ESTIMATE = 0.55
TILE = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within the text, and their numbers."""
    words, before = word_hashes(data, offsets, alphabet)
    n_words = np.diff(before)
    rows = len(n_words)
    factors = mix(np.arange(SHINGLE, dtype=np.uint64), 5) | U64(1)
    made = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE if len(made) else 0):
        made += words[i : len(words) - SHINGLE + 1 + i] * factors[i]
    counts = np.maximum(n_words - SHINGLE + 1, 0)
    place = np.repeat(before[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    made = mix(made[place])
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # the whole sequence is one shingle
        first = np.cumsum(counts)[short] - counts[short]
        whole = [mix((words[before[r] : before[r + 1]] * factors[: n_words[r]]).sum(keepdims=True), 9 + int(n_words[r]))[0] for r in short]
        made = np.insert(made, first, np.array(whole, np.uint64))
        counts[short] = 1
    ends = np.cumsum(counts)
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count > 1:
            made[end - count : end].sort()
    new = np.ones(len(made), bool)
    new[1:] = made[1:] != made[:-1]
    new[(ends - counts)[counts > 0]] = True
    owner = np.repeat(np.arange(rows), counts)
    return made[new], np.bincount(owner[new], minlength=rows)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n_shingles, key1, key2, bands, bins, marks): keys tell sets apart, bins have 16 bits of each bin, marks 32 of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = not_blank()
        for batch in batches:
            for first, last, data, offsets in text_chunks(_column(batch, "text")):
                sets, counts = shingle_sets(data, offsets, alphabet)
                signed = signatures(sets, counts, BINS)
                bands = np.zeros((len(counts), BINS // ROWS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + signed[:, r::ROWS], r)
                bands = mix(bands + np.arange(BINS // ROWS, dtype=np.uint64)[None, :] * U64(0x9E3779B97F4A7C15), 11)
                short = (mix(signed, 3) >> U64(48)).astype(np.uint16)
                keys = [_sums(mix(sets, salt), counts).view(np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(batch, "id").slice(first, last - first),
                        pa.array(counts.astype(np.int64)),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        list_array(bands.view(np.int64).ravel(), np.full(len(counts), BINS // ROWS)),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                        pa.array([row.tobytes() for row in (bands >> U64(32)).astype(np.uint32)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "key1", "key2", "bands", "bins", "marks"],
                )

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, n_shingles long, key1 long, key2 long, bands array<long>, bins binary, marks binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, elements): the whole sets of the wanted documents, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = not_blank()
        for batch in batches:
            for first, last, data, offsets in text_chunks(_column(batch, "text")):
                sets, counts = shingle_sets(data, offsets, alphabet)
                ends = np.cumsum(counts)
                packed = [sets[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([_column(batch, "id").slice(first, last - first), pa.array(packed, pa.binary())], names=["id", "elements"])

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return plain.mapInArrow(run, f"id {kind}, elements binary").dropDuplicates(["id"])


def _similar(left: pa.Buffer, right: pa.Buffer) -> bool:
    """Whether two full sets reach the threshold."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_column(batch, c) for c in ("left_set", "right_set"))
            keep = np.zeros(len(left), bool)
            for i in range(len(left)):
                keep[i] = _similar(left[i].as_buffer(), right[i].as_buffer())
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("left_set")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("right_set")), "b")
    return joined.select("a", "b", "left_set", "right_set").mapInArrow(run, f"a {kind}, b {kind}")


def _like_sizes(one: str, other: str):
    return F.least(one, other) * 100 >= F.greatest(one, other) * PERCENT


def _tiles(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, once for each tile of two sides x and y that they take part in."""
    members = members.join(labels, members.id == labels.node, "left").select("bucket", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("part"))
    main = parts.groupBy("bucket").agg(F.max_by("component", "part").alias("main"), F.max("part").alias("main_rows"), F.sum("part").alias("all_rows"), F.count(F.lit(1)).alias("n_parts"))
    main = main.filter("n_parts > 1").select(
        "bucket", "main", F.ceil(F.col("main_rows") / TILE).cast("int").alias("main_tiles"), F.ceil((F.col("all_rows") - F.col("main_rows")) / TILE).cast("int").alias("other_tiles")
    )
    rows = members.join(main, "bucket").join(reps.select("id", "bins", "marks"), "id")
    rows = rows.withColumn("inside", F.col("component") == F.col("main"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("main_tiles")).otherwise(F.col("other_tiles"))).cast("int"))
    # Tiles x: rows outside the main component; tiles y: those again, or rows of the main component.
    others = F.sequence(F.lit(0), F.col("other_tiles") - 1)
    mains = F.sequence(F.lit(0), F.col("main_tiles") - 1)
    cell = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    main_tile = lambda t: F.col("other_tiles") + t
    cells = F.when(F.col("inside"), F.transform(others, lambda x: cell(x, main_tile(F.col("tile")), "y"))).otherwise(
        F.concat(
            F.transform(mains, lambda y: cell(F.col("tile"), main_tile(y), "x")),
            F.transform(F.filter(others, lambda y: y >= F.col("tile")), lambda y: cell(F.col("tile"), y, "x")),
            F.transform(F.filter(others, lambda x: x <= F.col("tile")), lambda x: cell(x, F.col("tile"), "y")),
        )
    )
    return rows.withColumn("cell", F.explode(cells)).select("bucket", "cell.x", "cell.y", "cell.role", "band", "id", "n_shingles", "component", "bins", "marks")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, and where the groups begin; a group is never cut."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        begins = np.concatenate([[0], np.flatnonzero(new)])
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), begins
        held = table.slice(begins[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _candidates(table: pa.Table, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per group the row numbers of pairs worth verifying; only pairs whose first common band is the group's."""
    ids, component, n = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
    band, is_x = table.column("band").to_numpy(), table.column("role").to_numpy() == "x"
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint16).reshape(-1, BINS)
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint32).reshape(-1, BINS // ROWS)
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        rows = np.arange(begin, end)
        xs, ys = rows[is_x[begin:end]], rows[~is_x[begin:end]]
        earlier = int(band[begin])
        for first in range(0, len(xs), 64):
            some = xs[first : first + 64]
            near = component[some][:, None] != component[ys]
            near &= 100 * np.minimum(n[some][:, None], n[ys]) >= PERCENT * np.maximum(n[some][:, None], n[ys])
            i, j = np.nonzero(near)
            i, j = some[i], ys[j]
            fresh = ~(marks[i, :earlier] == marks[j, :earlier]).any(axis=1) if earlier else np.ones(len(i), bool)
            i, j = i[fresh], j[fresh]
            like = (bins[i] == bins[j]).sum(axis=1) >= ESTIMATE * BINS
            if like.any():
                yield i[like], j[like]


def _across(members: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between components within buckets that hold several.

    A first pass over the tiles keeps the rows that have a candidate at all; these get their sets, and a second pass
    verifies the candidates where they lie, so that pairs are never rows.
    """
    keys = ["bucket", "x", "y"]
    tiles = _tiles(members, labels, reps)
    kind = dict(reps.dtypes)["id"]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _groups(batches, keys):
            wanted = np.zeros(table.num_rows, bool)
            for i, j in _candidates(table, begins):
                wanted[i] = wanted[j] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _groups(batches, keys):
            ids, elements = table.column("id"), table.column("elements").combine_chunks()
            links: list[tuple[int, int]] = []
            for i, j in _candidates(table, begins):
                links += [(a, b) for a, b in zip(i.tolist(), j.tolist()) if _similar(elements[a].as_buffer(), elements[b].as_buffer())]
            sides = [ids.take(pa.array([p[k] for p in links], pa.int64())).combine_chunks() for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    schema = ", ".join(f"{n} {t}" for n, t in tiles.dtypes)
    kept = stored(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(involved, schema), "involved")
    full = kept.join(sets, "id").select(*kept.columns, "elements")
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for every document."""
    signed = stored(sign(docs, id_col, text_col), "signed")
    keys = ["key1", "key2", "n_shingles"]
    full = signed.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    reps = full.groupBy(*keys).agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bins").alias("bins"), F.first("marks").alias("marks"))
    reps = stored(reps, "representatives")

    banded = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    hubs = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "n_shingles")).alias("hub")).filter("rows > 1")
    members = stored(banded.join(hubs, "bucket").select("bucket", "band", "id", "n_shingles", "hub"), "members")
    sets = stored(_full_sets(docs, members.select("id").distinct(), id_col, text_col), "sets")

    stars = members.filter((F.col("id") != F.col("hub.id")) & _like_sizes("n_shingles", "hub.n_shingles"))
    links = stored(_verified(stars.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), sets), "star-links")
    labels = stored(components(links, "a", "b"), "star-labels")
    more = stored(_across(members, labels, reps, sets), "cross-links")
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    labels = stored(components(edges, "a", "b"), "labels")

    classes = reps.join(labels, reps.id == labels.node, "left").select(*keys, F.coalesce("component", "id").alias("component_id"))
    out = signed.join(classes, keys, "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, without those that another one of their group stands for.

    Of rows that repeat an id one stays; rows with a null id stay, since an id names what stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.filter(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    # The join leaves the rows dealt by id, so that no second shuffle of texts is needed to find repeated ids.
    left = named.join(gone, named[id_col] == gone["gone_id"], "left_anti").dropDuplicates([id_col])
    return left.unionByName(docs.filter(F.col(id_col).isNull()))
