"""Removal of repeated passages with run-length indexes of repetitive text.

A byte is removed if it lies in a string of `length` bytes that also starts earlier: in a document with a smaller id,
or in the same document at a smaller place. All strings are judged on the input.

Texts are parsed as for a run-compressed index of a repetitive corpus. Every window of `length` bytes chooses its gram
with the smallest hash (the leftmost of equals) as its anchor; consecutive windows with one anchor form a phrase. Equal
windows choose equal grams at the same place, so repeats only occur between phrases whose anchors are equal. Hence:

1. phrases are described by two hashes, of the anchor and of all their bytes; nothing but these is shuffled;
2. phrases whose anchor occurs once in the corpus are dropped, their windows cannot repeat;
3. equal phrases are one entry of a dictionary with its first place; all later places are repeated as a whole;
4. different phrases with one anchor can share a part. Their bytes are fetched, phrases of many anchors make up an index
   (`run_index.RunLengthIndex`: runs of the Burrows-Wheeler transform, sampled positions), matching statistics are
   streamed against it, and matches of `length` bytes with an earlier start are marked;
5. an anchor with more than `VARIANTS` different phrases would outgrow an index; its windows are compared one by one, by
   two hashes each, with sums before the shuffle. The result is the same.

Nothing grows with a group: counts and first places are aggregated before they are shuffled, joins on hot anchors are
split by adaptive execution, and an index has a bounded number of bytes. Texts are shuffled only for documents with
something to fetch or to remove (told by a bitmap of fixed size; beyond it more documents than needed are moved).

Results: null and empty texts, and those below `length` bytes, lose nothing. Matches never cross documents. Rows that
repeat an id are one document in the order: the same place in two of them is not earlier, so equal rows do not remove
each other, but a smaller place in one removes a later one in another. Null ids come last. Long texts are parsed in
pieces that overlap. An empty table gives no rows. Only id and text are read, under names of their own. Removal may cut
characters of several bytes, so what is kept is binary. Phrases are compared by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import U64, list_array, mix, text_chunks
from snipdex.llm.run_index import RunLengthIndex
from snipdex.session import delete_path, scratch_path

LENGTH = 100
GRAM = 24
PIECE = 1 << 20
INDEX_BYTES = 3 << 19
VARIANTS = 4096
#: Bits that tell which documents are moved: 4 MB.
BITMAP = 1 << 25
BASE = 0xD6E8FEB86659FD93
VALUES = mix(np.arange(256, dtype=np.uint64), 29)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of byte hashes, and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _hash_parts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of the given parts of the data, as those of phrases."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    return mix(np.add.reduceat(VALUES[data[np.repeat(starts, sizes) + within]] * powers[within], firsts) + sizes.astype(np.uint64))


class Parser:
    """Phrases of texts."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, min(gram, length)
        if self.gram < 8:
            raise ValueError("a gram has at least 8 bytes")
        self.powers, self.inverse = _powers(PIECE + 2 * length)

    def _grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the gram at every place but the last few."""
        n = len(data) - self.gram + 1
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        x = eight[:n] * U64(0x9E3779B97F4A7C15)
        for at in [*range(8, self.gram - 7, 8), self.gram - 8]:
            x ^= x >> U64(32)
            x = (x ^ eight[at : at + n]) * U64(0xC2B2AE3D27D4EB4F)
        x ^= x >> U64(32)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(29)
        return x

    def _least(self, x: np.ndarray, width: int) -> np.ndarray:
        """The least of every `width` consecutive values, by least values from both ends of blocks."""
        n = len(x) - width + 1
        blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max)
        blocks[: len(x)] = x
        blocks = blocks.reshape(-1, width)
        down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        up = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        return np.minimum(down[:n], up[width - 1 : width - 1 + n])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts in one array: text, first window, last window, anchor's place (all in the array), anchor, hash."""
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= self.length)
        if not len(long):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        data = np.ascontiguousarray(data)
        x = self._grams(data)
        bits = U64(max(1, len(x).bit_length()))
        place = ((x >> bits) << bits) | np.arange(len(x), dtype=np.uint64)
        least = self._least(place, self.length - self.gram + 1) & ((U64(1) << bits) - U64(1))
        # Windows that lie within one text.
        step = np.zeros(len(least) + 1, np.int8)
        step[offsets[:-1][long]] += 1
        step[offsets[1:][long] - self.length + 1] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        change = np.ones(len(least) + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:] - 1
        kept = whole[first]
        first, last = first[kept], last[kept]
        at = least[first].astype(np.int64)
        anchor = mix(x[at])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * self.powers[: len(data)])])
        end = last + self.length
        phrase = mix((sums[end] - sums[first]) * self.inverse[first] + (end - first).astype(np.uint64))
        text = np.searchsorted(offsets, first, side="right") - 1
        return text, first, last, at, anchor, phrase

    def pieces(self, array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
        """Chunks of texts, and long texts in pieces: first and last row, bytes, offsets, bytes left out before."""
        for first, last, data, offsets in text_chunks(array, PIECE):
            if len(data) <= PIECE + self.length:
                yield first, last, data, offsets, 0
                continue
            for a in range(0, len(data) - self.length + 1, PIECE):
                some = data[a : a + PIECE + self.length - 1]
                yield first, last, some, np.array([0, len(some)]), a


def _order(ids: pa.Array) -> np.ndarray:
    """The place of every id among all different ids, null last."""
    names = sorted({x for x in ids.to_pylist() if x is not None})
    place = {x: i for i, x in enumerate(names)}
    return np.array([place.get(x, len(names)) for x in ids.to_pylist()], np.int64)


def _phrases(plain: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (id, at, anchor, phrase, later): `later` if the same phrase occurs earlier in the same piece of the table.

    `at` holds three numbers: place of the anchor, bytes before it in the phrase, windows of the phrase less one.
    """
    kind = dict(plain.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for batch in batches:
            for first, last, data, offsets, base in parser.pieces(batch.column(1)):
                text, begin, end, at, anchor, phrase = parser.phrases(data, offsets)
                if not len(text):
                    continue
                ids = batch.column(0).slice(first, last - first)
                place = at - offsets[text] + base
                packed = (place * length + (at - begin)) * length + (end - begin)
                by_id = _order(ids)[text]
                order = np.lexsort((place, by_id, phrase, anchor))
                same = np.concatenate([[False], (phrase[order][1:] == phrase[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = np.empty(len(order), bool)
                later[order] = same & ((by_id[order] != by_id[order][head]) | (place[order] != place[order][head]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text)), pa.array(packed), pa.array(anchor.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(later)],
                    names=["id", "at", "anchor", "phrase", "later"],
                )

    return plain.mapInArrow(run, f"id {kind}, at long, anchor long, phrase long, later boolean")


def _flat(batch: pa.RecordBatch, text: int, lists: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Chunks of texts with the entries of a list column: rows, bytes, offsets, row of each entry, entries."""
    for first, last, data, offsets in text_chunks(batch.column(text)):
        part = batch.column(lists).slice(first, last - first)
        counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        yield first, last, data, offsets, np.repeat(np.arange(last - first), counts), part.flatten()


def _place(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed places: the anchor's place, the first byte of the phrase, its size."""
    place = at // (length * length)
    return place, place - at // length % length, at % length + length


def _same_phrase(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, phrase: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Entries whose phrase really lies at its place of the text; others belong to another row with the same id."""
    fits = np.flatnonzero(start + size <= np.diff(offsets)[row])
    return fits[_hash_parts(data, offsets[row[fits]] + start[fits], size[fits], powers).view(np.int64) == phrase[fits]]


def _strings(plain: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of phrases: rows (anchor, id, at, phrase, variants, bytes) of wanted rows without bytes."""
    kind = dict(plain.dtypes)["id"]
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "phrase", "variants")).alias("wanted"))
    rows = _joined(plain, lists, "inner").select("id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, _ = _powers(2 * length)
        for batch in batches:
            for first, last, data, offsets, row, entries in _flat(batch, 1, 2):
                at, phrase = entries.field("at").to_numpy(), entries.field("phrase").to_numpy()
                _, start, size = _place(at, length)
                some = _same_phrase(data, offsets, row, start, size, phrase, powers)
                if not len(some):
                    continue
                begin = offsets[row[some]] + start[some]
                found = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + size[some]).tolist())]
                taken = entries.take(pa.array(some))
                ids = batch.column(0).slice(first, last - first).take(pa.array(row[some]))
                columns = [taken.field("anchor"), ids, taken.field("at"), taken.field("phrase"), taken.field("variants"), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "at", "phrase", "variants", "bytes"])

    return rows.mapInArrow(run, f"anchor long, id {kind}, at long, phrase long, variants long, bytes binary").distinct()


def _marked(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated parts of the phrases of one index: rows (id, at, phrase, first, last)."""
    ids = _order(pa.array(pdf["id"], from_pandas=True))
    at = pdf["at"].to_numpy()
    place, start, size = _place(at, length)
    order = np.lexsort((pdf["phrase"].to_numpy(), place, ids))
    ids, place, start, size = ids[order], place[order], start[order], size[order]
    data = np.frombuffer(b"".join(pdf["bytes"].iloc[order]), np.uint8)
    index = RunLengthIndex(data, size, length)
    string, offset, least = index.stream(data)
    other = index.owner(least)
    earlier = (ids[other] < ids[string]) | ((ids[other] == ids[string]) & (place[other] < place[string]))
    string, offset = string[earlier], offset[earlier]
    by_place = np.lexsort((offset, string))
    string, offset = string[by_place], offset[by_place]
    new = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])[: len(string)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(string))[: len(heads)] - 1
    rows = order[string[heads]]
    return pd.DataFrame(
        {
            "id": pdf["id"].to_numpy()[rows],
            "at": at[rows],
            "phrase": pdf["phrase"].to_numpy()[rows],
            "first": start[string[heads]] + offset[heads],
            "last": start[string[tails]] + offset[tails] + length,
        }
    )


def _indexed(strings: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """Repeats between the phrases of each anchor, with an index for the anchors of a bounded number of bytes."""
    kind = dict(strings.dtypes)["id"]
    total = strings.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    n = max(1, math.ceil(total / index_bytes))
    return strings.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n))).applyInPandas(lambda pdf: _marked(pdf, length), f"id {kind}, at long, phrase long, first long, last long")


def _first(id_col: str, place: Column) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), place.alias("place"))


def _by_window(strings: DataFrame, length: int) -> DataFrame:
    """The same by the windows themselves, for anchors of any number of phrases."""
    kind = dict(strings.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, _ = _powers(2 * length)
        for batch in batches:
            if not len(batch):
                continue
            place, start, size = _place(batch.column(1).to_numpy(), length)
            data = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            n = size - length + 1
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = (np.cumsum(size) - size)[row] + offset
            one, two = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
            for a in range(0, len(row), 8192):
                block = data[begin[a : a + 8192, None] + np.arange(length)]
                one[a : a + 8192] = mix((VALUES[block] * powers[:length]).sum(axis=1, dtype=np.uint64))
                two[a : a + 8192] = mix((mix(VALUES, 3)[block] * (powers[:length] * U64(BASE ^ 0x5A5A))).sum(axis=1, dtype=np.uint64))
            taken = batch.take(pa.array(row))
            columns = [*taken.columns[:3], pa.array(start[row] + offset), pa.array(place[row]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "phrase", "start", "place", "one", "two"])

    windows = strings.select("id", "at", "phrase", "bytes").mapInArrow(run, f"id {kind}, at long, phrase long, start long, place long, one long, two long")
    firsts = windows.groupBy("one", "two").agg(F.min(_first("id", F.col("start"))).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = windows.join(firsts, ["one", "two"]).filter(_first("id", F.col("start")) > F.col("earliest"))
    return again.select("id", "at", "phrase", F.col("start").alias("first"), (F.col("start") + length).alias("last"))


def _joined(plain: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with the lists of their ids; null ids meet too."""
    lists = lists.withColumnRenamed("id", "list_id")
    return plain.join(lists, plain.id.eqNullSafe(lists.list_id), how)


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def _moved(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with a column `moved`: true for all whose id is in ids, and for few others."""
    bits = ids.select(_bit("id").alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    # At most BITMAP / 32768 rows of 4 kB.
    with_bit = plain.withColumn("bit", _bit("id")).withColumn("bucket", F.bitmap_bucket_number("bit"))
    found = with_bit.join(F.broadcast(maps), "bucket", "left")
    byte = "cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(bit) / 8 AS int) + 1, 1)), 16, 10) AS int)"
    set_bit = F.expr(f"shiftright({byte}, cast(bitmap_bit_position(bit) % 8 AS int)) & 1 = 1")
    return found.select("id", "text", F.coalesce(set_bit, F.lit(False)).alias("moved"))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """Rows (id, n_bytes, spans, kept) of documents (id, text, found) with lists of repeated parts or null."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, _ = _powers(2 * length)
        for batch in batches:
            for first, last, data, offsets, row, entries in _flat(batch, 1, 2):
                n = last - first
                sizes = np.diff(offsets)
                step = np.zeros(len(data) + 1, np.int32)
                if len(row):
                    at, phrase, begin, end = (entries.field(f).to_numpy() for f in ("at", "phrase", "first", "last"))
                    _, start, size = _place(at, length)
                    some = _same_phrase(data, offsets, row, start, size, phrase, powers)
                    np.add.at(step, offsets[row[some]] + begin[some], 1)
                    np.add.at(step, offsets[row[some]] + end[some], -1)
                gone = np.cumsum(step[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                heads = offsets[:-1][sizes > 0]
                opens[heads] = gone[heads]
                closes = gone.copy()
                closes[:-1] &= ~gone[1:]
                tails = offsets[1:][sizes > 0] - 1
                closes[tails] = gone[tails]
                a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                of = np.searchsorted(offsets, a, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(a - offsets[of]), pa.array(b - offsets[of])], ["first", "last"])
                kept_before = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = data[~gone].tobytes()
                parts = pa.array([kept[x:y] for x, y in zip(kept_before[:-1].tolist(), kept_before[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes.astype(np.int64)), list_array(spans, np.bincount(of, minlength=n)), parts], names=["id", "n_bytes", "spans", "kept"]
                )

    return rows.select("id", "text", "found").mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")


def _store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, variants: int = VARIANTS) -> DataFrame:
    """Rows (id, n_bytes, spans, kept): the bytes of the text, the removed runs [first, last), and what is left."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, rows_path = _store(_phrases(plain, length, gram), "phrases")
    mine = rows.filter("NOT later")
    shared = mine.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    places, _ = _store(mine.join(shared, "anchor").select("id", "at", "anchor", "phrase"), "places")
    whole = F.col("at") % length + length
    start = F.expr(f"at div {length * length} - (at div {length}) % {length}")
    part = ["id", "at", "phrase", start.alias("first"), (start + whole).alias("last")]
    spans = rows.filter("later").select(*part)
    place = F.expr(f"at div {length * length}")
    spans, _ = _store(spans, "later")
    delete_path(plain.sparkSession, rows_path)

    entries, _ = _store(places.groupBy("anchor", "phrase").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("earliest"), F.count(F.lit(1)).alias("n")), "dictionary")
    again = places.join(entries.filter("n > 1").select("anchor", "phrase", "earliest"), ["anchor", "phrase"])
    first = F.struct(F.col("earliest.no_id").alias("no_id"), F.col("earliest.id").alias("id"), F.expr(f"earliest.at div {length * length}").alias("place"))
    spans = spans.unionByName(again.filter(_first("id", place) > first).select(*part))

    several = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    wanted = entries.join(several, "anchor").select("anchor", "phrase", "variants", "earliest.id", "earliest.at")
    wanted, _ = _store(wanted, "variants")
    sources = _moved(plain, wanted).filter("moved").select("id", "text")
    strings, _ = _store(_strings(sources, wanted, length), "strings")
    spans = spans.unionByName(_indexed(strings.filter(F.col("variants") <= variants), length, index_bytes))
    spans = spans.unionByName(_by_window(strings.filter(F.col("variants") > variants), length))
    spans, _ = _store(spans, "repeats")

    lists = spans.groupBy("id").agg(F.collect_list(F.struct("at", "phrase", "first", "last")).alias("found"))
    split = _moved(plain, spans)
    touched = _joined(split.filter("moved").select("id", "text"), lists, "left")
    nothing = lists.schema["found"].dataType.simpleString()
    untouched = split.filter("NOT moved").withColumn("found", F.lit(None).cast(nothing))
    out = _cut(touched, length).unionByName(_cut(untouched, length))
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")
