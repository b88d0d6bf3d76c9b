"""Ranked lexical search: block-compressed posting lists, searched by Block-Max MaxScore.

The index is a table. Documents are cut into shards of bounded bytes; a shard has one row per term with its postings
(place of the document in the shard, and how often the term occurs), cut into blocks of `BLOCK` postings. A block is
compressed on its own (differences and counts as bytes of seven bits) and described by its last place, its largest
count, its least document length and where its bytes begin. One more row per shard, with a null term, holds the
documents' ids and lengths.

A search reads the rows of the queries' terms only. In each shard the highest score that a term can give anywhere (its
global bound) orders a query's lists. Lists whose bounds together stay below the score of the k-th best document so far
are non-essential: a document only in those cannot enter. Documents of the essential lists are candidates; for each
non-essential list, the highest first, the bound of the block that would hold a candidate plus the bounds of the lists
behind must reach the k-th score, else the candidate is rejected, and blocks without candidates are never
decompressed. A task keeps one heap per query over all of its shards, so the k-th score rises, and gives out k rows per
query; heaps are merged by Spark.

Terms are words of letters, digits and everything beyond ASCII, A-Z lower-cased, compared by 64-bit hashes. Scores are
integers: the weight of a term (from counts over all documents) times a saturated count, summed with repeats of the
query. All documents take part, and ties go to the smaller id (null last).

Results: null, empty and wordless texts are in no list and match nothing. A query without known terms has no rows.
Rows that repeat a document are documents of their own, and may take several ranks. Rows that repeat a query's id and
text count once; different texts under one id are ranked each by itself, told apart by `query`. A very long text is one
shard. Empty tables give no rows. Only id and text columns are read, under names of their own.

Queries are sent to the workers in slices of `SLICE_BYTES`; each slice is one pass over the lists of its terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import letters_and_digits, text_chunks, word_hashes
from snipdex.session import stored

SHARD_BYTES = 6 << 20
BLOCK = 128
SLICE_BYTES = 1 << 20
#: Four numbers per block: last place, largest count, least length, first byte.
ENTRY = np.dtype([("last", "<u4"), ("count", "<u4"), ("length", "<u4"), ("byte", "<u4")])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the high bit on all but the last byte; and where each number begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for shift in (7, 14, 21, 28):
        size += values >= np.uint64(1 << shift)
    begins = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begins[-1], np.uint8)
    for k in range(5):
        rows = np.flatnonzero(size > k)
        more = (size[rows] > k + 1).astype(np.uint8) << 7
        out[begins[rows] + k] = ((values[rows] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, begins


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of `pack`."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (shard, term, df, blocks, postings, ids, lengths); ids and lengths only in the row of a shard with a null term.

    It has to be stored before it is searched: a search reads it several times, and shards are numbered by task.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["shard", "term", "df", "blocks", "postings", "ids", "lengths"]

    def rows(shard: str, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, alphabet) -> Iterator[pa.RecordBatch]:
        words, before = word_hashes(data, offsets, alphabet)
        lengths = np.diff(before)
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(ids.type), pa.list_(pa.int64())]
        head = [[shard], [None], [int((lengths > 0).sum())], [None], [None], [ids.to_pylist()], [lengths.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(head, types)], names=names)
        if not len(words):
            return
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(words, kind="stable")
        words, doc = words[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(new, len(words)))
        term, place = words[new], doc[new]
        lists = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.diff(np.append(lists, len(term)))
        within = np.arange(len(term)) - np.repeat(lists, sizes)
        starts = np.flatnonzero(within % BLOCK == 0)
        gap = np.diff(place, prepend=0)
        gap[starts] = place[starts]
        both = np.empty(2 * len(term), np.int64)
        both[0::2], both[1::2] = gap, count
        packed, begins = pack(both)
        ends = np.append(starts[1:], len(term))
        block = np.zeros(len(starts), ENTRY)
        block["last"] = place[ends - 1]
        block["count"] = np.maximum.reduceat(count, starts)
        block["length"] = np.minimum.reduceat(lengths[place], starts)
        first_block = np.searchsorted(starts, lists)
        last_block = np.append(first_block[1:], len(starts))
        list_byte = begins[2 * lists]
        list_end = np.append(list_byte[1:], len(packed))
        block["byte"] = begins[2 * starts] - np.repeat(list_byte, last_block - first_block)
        for a in range(0, len(lists), 4096):
            some = slice(a, min(a + 4096, len(lists)))
            n = some.stop - a
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.string()),
                    pa.array(term[lists[some]].view(np.int64)),
                    pa.array(sizes[some].astype(np.int64)),
                    pa.array([block[i:j].tobytes() for i, j in zip(first_block[some], last_block[some])], pa.binary()),
                    pa.array([packed[i:j].tobytes() for i, j in zip(list_byte[some], list_end[some])], pa.binary()),
                    pa.array([None] * n, types[5]),
                    pa.array([None] * n, types[6]),
                ],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alphabet = letters_and_digits()
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([h[0] for h in held])
            data = np.concatenate([h[1] for h in held])
            shift = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            offsets = np.concatenate([[0], *(h[2][1:] + s for h, s in zip(held, shift))])
            return rows(f"{part}-{made}", ids, data, offsets, alphabet)

        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                weight = len(data) + 16 * (last - first)  # empty texts take room as well
                if held and size + weight > shard_bytes:
                    yield from close()
                    made, held, size = made + 1, [], 0
                held.append((batch.column(0).slice(first, last - first), data, offsets))
                size += weight
        if held:
            yield from close()

    return plain.mapInArrow(run, f"shard string, term long, df long, blocks binary, postings binary, ids array<{kind}>, lengths array<long>")


class Corpus:
    """Counts over all documents, and what scores need of them."""

    def __init__(self, documents: int, words: int):
        self.documents = documents
        self.words = words

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """100 - 25 + 25 * length over the mean length, rounded down; in exact integers where 64 bits would not do."""
        if len(lengths) and 25 * int(lengths.max()) * self.documents >= 2**62:
            return np.array([75 + 25 * int(n) * self.documents // self.words for n in lengths], np.int64)
        return 75 + 25 * lengths.astype(np.int64) * self.documents // max(1, self.words)


def saturated(count: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """The part of a score that depends on the document; grows with the count, falls with the damping."""
    count = count.astype(np.int64)
    return 1_000_000_000 * count // (1000 * count + 12 * damping)


class Shard:
    """Posting lists of one shard, decompressed block by block when asked for."""

    def __init__(self, ids: list, lengths: np.ndarray, corpus: Corpus):
        self.ids = ids
        self.damping = corpus.damping(lengths)
        self.corpus = corpus
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.full: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0

    def add(self, term: int, blocks: bytes, postings: bytes) -> None:
        entry = np.frombuffer(blocks, ENTRY)
        # A bound on the saturated count of each block: its largest count in its shortest document.
        bound = saturated(entry["count"], self.corpus.damping(entry["length"].astype(np.int64)))
        self.lists[term] = entry, np.frombuffer(postings, np.uint8), bound

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and saturated counts of one block."""
        if (term, b) not in self.open:
            entry, data, _ = self.lists[term]
            end = entry["byte"][b + 1] if b + 1 < len(entry) else len(data)
            numbers = unpack(data[entry["byte"][b] : end])
            places = np.cumsum(numbers[0::2])
            self.open[term, b] = places, saturated(numbers[1::2], self.damping[places])
            self.decompressed += 1
        return self.open[term, b]

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.full:
            parts = [self.block(term, b) for b in range(len(self.lists[term][0]))]
            self.full[term] = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))
        return self.full[term]

    def search(self, terms: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that score at least `floor` and above 0, for (term, weight with repeats)."""
        lists = sorted(((w * int(self.lists[t][2].max()), t, w) for t, w in terms if t in self.lists and w > 0), reverse=True)
        behind = np.cumsum([0, *(x[0] for x in lists[::-1])])[::-1]  # behind[i]: bounds of lists i and later together
        essential = int(np.count_nonzero(behind[:-1] >= max(1, floor)))
        total = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for _, term, weight in lists[:essential]:
            places, part = self.whole(term)
            total[places] += weight * part
            seen[places] = True
        alive = np.flatnonzero(seen)
        score = total[alive]
        for i in range(essential, len(lists)):
            _, term, weight = lists[i]
            entry, _, bound = self.lists[term]
            b = np.searchsorted(entry["last"], alive)
            inside = b < len(entry)
            most = np.where(inside, weight * bound[np.minimum(b, len(entry) - 1)], 0)
            live = score + most + behind[i + 1] >= floor
            alive, score, b, inside = alive[live], score[live], b[live], inside[live]
            rows = np.flatnonzero(inside)
            for one in np.unique(b[rows]):
                here = rows[b[rows] == one]
                places, part = self.block(term, int(one))
                at = np.minimum(np.searchsorted(places, alive[here]), len(places) - 1)
                score[here] += np.where(places[at] == alive[here], weight * part[at], 0)
        good = (score >= floor) & (score > 0)
        return alive[good], score[good]


class Heap:
    """The k best (score, id) of one query so far; ties go to the smaller id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple] = []
        self.floor = 0

    def offer(self, ids: list, places: np.ndarray, scores: np.ndarray) -> None:
        if len(places) > self.k:  # keep what ties with the k-th as well: ids decide
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            best = scores >= least
            places, scores = places[best], scores[best]
        some = [(-int(s), ids[p] is None, ids[p]) for p, s in zip(places, scores)]
        self.rows = sorted(self.rows + some, key=lambda r: (r[0], r[1], r[2] if not r[1] else 0))[: self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _slices(queries: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """Different queries (id, text) in slices of about `limit` bytes; each is read by the driver on its own."""
    some = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    total = some.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    for k in range(n):
        part = some if n == 1 else some.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: (r["id"] is None, str(r["id"]), r["text"]))
        if rows:
            yield rows


def _scan(index: DataFrame, found: DataFrame, rows: list, corpus: Corpus, k: int, id_kind: str, query_kind: str) -> DataFrame:
    """The heaps of all tasks for one slice of queries: rows (query_id, query, id, score)."""
    alphabet = letters_and_digits()
    hashes, before = [], [0]
    for _, _, data, offsets in text_chunks(pa.array([r["text"] for r in rows], pa.large_string())):
        words, bounds = word_hashes(data, offsets, alphabet)
        hashes.append(words)
        before.extend((bounds[1:] + before[-1]).tolist())
    words = np.concatenate(hashes).view(np.int64)
    spark = index.sparkSession
    known = spark.createDataFrame([(int(t),) for t in np.unique(words)], "term long")  # at most the words of a slice
    index = index.join(F.broadcast(known), "term", "left_semi").unionByName(found)
    df = {r["term"]: r["df"] for r in index.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = {t: corpus.weight(n) for t, n in df.items()}
    plans = []
    for q, r in enumerate(rows):
        terms, times = np.unique(words[before[q] : before[q + 1]], return_counts=True)
        plans.append([(int(t), int(n) * weights[int(t)]) for t, n in zip(terms, times) if int(t) in weights])
    keys = [r["id"] for r in rows]
    shared = spark.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        heaps = [Heap(k) for _ in plans]

        def search(shard: Shard | None) -> None:
            if shard is None or not shard.lists:
                return
            for heap, terms in zip(heaps, plans):
                heap.offer(shard.ids, *shard.search(terms, heap.floor))

        shard, name = None, None
        for batch in batches:
            for at, term, blocks, postings, ids, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name:
                    search(shard)
                    shard, name = None, at
                if term is None:  # the head sorts before the lists
                    shard = Shard(ids, np.array(lengths, np.int64), corpus)
                else:
                    shard.add(term, blocks, postings)
        search(shard)
        out = [(q, r[2], -r[0]) for q, heap in enumerate(heaps) for r in heap.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], id_type), pa.array([x[2] for x in out], pa.int64())], names=["query", "id", "score"]
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(found.schema["ids"].dataType.elementType)
    dealt = index.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).select("shard", "term", "blocks", "postings", "ids", "lengths")
    heaps = dealt.mapInArrow(run, f"query int, id {id_kind}, score long")
    ids = spark.createDataFrame([(q, key) for q, key in enumerate(keys)], f"query int, query_id {query_kind}")
    return heaps.join(F.broadcast(ids), "query")


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (query_id, query, rank, id, score): the k best documents of every query, from 1, highest first.

    `query` numbers the queries of one slice; it only tells different texts of one id apart.
    """
    heads = index.filter("term is null")
    counts = heads.agg(F.sum("df").alias("documents"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("words")).first()
    corpus = Corpus(counts["documents"] or 0, counts["words"] or 0)
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    query_kind = dict(queries.dtypes)[id_col]
    lists = index.filter("term is not null")
    passes = [_scan(lists, heads, rows, corpus, k, id_kind, query_kind).withColumn("slice", F.lit(n)) for n, rows in enumerate(_slices(queries, id_col, text_col, slice_bytes))]
    if not passes:
        return index.sparkSession.createDataFrame([], f"query_id {query_kind}, query long, rank int, id {id_kind}, score long")
    merged = passes[0]
    for one in passes[1:]:
        merged = merged.unionByName(one)
    best = Window.partitionBy("slice", "query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", (F.col("slice").cast("long") * (1 << 31) + F.col("query")).alias("query"), "rank", "id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Index the documents in the shared folder and search it."""
    return search(stored(build_index(docs, doc_id, doc_text), "postings"), queries, k, query_id, query_text)
