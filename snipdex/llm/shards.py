"""Sharding by sampled splitters: near-equal bytes, contiguous ranges of keys, gapless slots.

A record's key has 40 bits of the hash of its text and 24 bits of the hash of its id, so equal texts lie side by side
and a large group of copies can still be cut. A sample of keys, drawn in proportion to size, gives splitters at its
quantiles; the records fall into the ranges between them, and ranges that turn out overfull are subdivided by
splitters drawn within them. Ranges are counted exactly, and a running sum within each gives every record's place in
the whole order of bytes. Shard borders are the equal parts of that order, moved to the nearest border of a group of
equal texts unless the group holds more than `GROUP_SHARE` of a shard; such a group is cut between records.

Only keys and sizes are shuffled, never texts. The driver sees the sample, the splitters (`MAX_RANGES`) and a row per
shard. Results: the size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of the empty text.
Rows that repeat an id are records of their own with their own slots; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snipdex.session import stored

SAMPLE_ROWS = 20_000
RANGE_ROWS = 10_000
MAX_RANGES = 4096
OVERFULL = 2.0
ROUNDS = 3
ID_BITS = 24
GROUP_SHARE = 0.02


def _quantiles(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Up to n - 1 different keys that cut the weighted sample into equal parts."""
    if len(keys) == 0 or n < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    filled = np.cumsum(weights[order])
    return np.unique(keys[order][np.searchsorted(filled, filled[-1] * np.arange(1, n) / n)])


def _draw(rows: DataFrame, total: int, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with a chance in proportion to size; records above the step are sure and weigh their size."""
    chance = F.least(F.lit(1.0), F.col("size") * (SAMPLE_ROWS / total))
    drawn = rows.select("key", "size", chance.alias("chance")).filter(F.rand(7 + round_) < F.col("chance"))
    found = drawn.select("key", (F.col("size") / F.col("chance")).alias("weight")).limit(4 * SAMPLE_ROWS).toPandas()
    return found["key"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def _with_range(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """The number of the range each record falls into: splitters at or below its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.names.index("key")).to_numpy(zero_copy_only=False)
            found = np.searchsorted(splitters, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", range int")


def _ranges(rows: DataFrame, total: int, n: int) -> tuple[DataFrame, list]:
    """Records with their range, and per range its bytes and rows; overfull ranges are subdivided."""
    splitters = _quantiles(*_draw(rows, total, 0), n)
    for round_ in range(1, ROUNDS + 1):
        ranged = _with_range(rows, splitters)
        fill = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        over = [r for r in fill if r["bytes"] > OVERFULL * total / n and r["rows"] > 1]
        if not over or round_ == ROUNDS or len(splitters) >= MAX_RANGES:
            break
        inside = ranged.filter(F.col("range").isin([r["range"] for r in over]))
        keys, weights = _draw(inside, sum(r["bytes"] for r in over), round_)
        number = np.searchsorted(splitters, keys, side="right")
        more = [_quantiles(keys[number == r["range"]], weights[number == r["range"]], int(np.ceil(r["bytes"] * n / total))) for r in over]
        splitters = np.unique(np.concatenate([splitters, *more]))
    return ranged, sorted(fill, key=lambda r: r["range"])


def _cuts(placed: DataFrame, total: int, shards: int) -> list[int]:
    """Places, in bytes, at which the second and later shards begin: a few rows per shard."""
    ideal = [total * k / shards for k in range(1, shards)]
    end = F.col("place") + F.col("size")
    group = F.shiftright("key", ID_BITS)
    crossed = F.lit(False)
    for place in ideal:
        crossed = crossed | ((F.col("place") < place) & (end >= place))
    at = placed.filter(crossed).select("place", "size", group.alias("group")).collect()
    around = placed.filter(group.isin([r["group"] for r in at])).groupBy(group.alias("group")).agg(F.min("place").alias("begin"), F.max(end).alias("end"))
    groups = {r["group"]: (r["begin"], r["end"]) for r in around.collect()}
    cuts = []
    for place in ideal:
        row = next(r for r in at if r["place"] < place <= r["place"] + r["size"])
        begin, stop = groups[row["group"]]
        if stop - begin > GROUP_SHARE * total / shards:
            begin, stop = row["place"], row["place"] + row["size"]
        cuts.append(begin if place - begin < stop - place else stop)
    return cuts


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot) for every record."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    mask = (1 << ID_BITS) - 1
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(~mask)).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(mask))).alias("key"),
    )
    rows = stored(rows, "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n = int(max(shards, min(MAX_RANGES, count // RANGE_ROWS)))
    ranged, fill = _ranges(rows, max(total, 1), n)

    before, borders = (0, 0), []
    for r in fill:
        borders.append((r["range"], *before))
        before = before[0] + r["bytes"], before[1] + r["rows"]
    borders = F.broadcast(spark.createDataFrame(borders, "range int, bytes_before long, rows_before long"))
    inside = Window.partitionBy("range").orderBy("key", "id", "text_crc32")
    placed = (
        ranged.withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.row_number().over(inside))
        .join(borders, "range")
        .select("id", "size", "text_crc32", "key", (F.col("bytes_before") + F.col("sum") - F.col("size")).alias("place"), (F.col("rows_before") + F.col("number") - 1).alias("number"))
    )
    placed = stored(placed, "shard-places")
    shard = F.lit(0)
    for cut in _cuts(placed, total, shards) if count else []:
        shard = shard + (F.col("place") >= cut).cast("int")
    placed = placed.withColumn("shard", shard)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("number").alias("first")))  # a row per shard
    return placed.join(firsts, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"))
