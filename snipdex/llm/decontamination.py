"""Benchmark decontamination with suffix arrays over the training texts.

Texts become sequences of word ranks: the rank of a word among the words of the benchmark, 0 for any other word and
between documents. Every block of documents is one shard. Its suffix array holds the word positions whose next words
could begin a match, sorted by their words up to the length of the longest test item; it is sorted `per` words at a
time, each step only within groups that are still equal. Every test suffix is then searched by bisection, all of them
at once: the suffixes that share its first `window` words form one range of the array, and these are its locations.
Locations on one diagonal (same distance between document and item) that follow each other are one longer match, so
the longest verbatim matches come from the same ranges.

The benchmark goes to the workers in slices of at most `SLICE_BYTES`, one pass over the documents for each slice; a
benchmark within that size needs one. Words are compared by 64-bit hashes.

Results: null, empty and wordless texts have 0 words and no hit. An item with fewer words than a window is one window;
items without words, and null items, match nothing. Rows that repeat an item id count once, a null item id is ''.
Repeated documents are judged one by one. Without documents there are no rows, without items no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import U64, letters_and_digits, list_array, mix, text_chunks, word_hashes

WINDOW = 10
SLICE_BYTES = 8 << 20
PRUNE = 3
TABLE_BITS = 22
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>, matches array<struct<item:string,item_word:int,first:int,words:int>>"


class TestSuffixes:
    """The benchmark's words, and its windows as packed ranks."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.alphabet = letters_and_digits()
        hashes, before = [], [np.zeros(1, np.int64)]
        for _, _, data, offsets in text_chunks(pa.array(texts, pa.large_string())):
            words, bounds = word_hashes(data, offsets, self.alphabet)
            hashes.append(words)
            before.append(bounds[1:] + before[-1][-1])
        words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        before = np.concatenate(before)
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        self.ids = np.array(ids, dtype=object)
        bits = max(1, len(self.vocabulary).bit_length())
        self.bits, self.per = bits, 64 // bits
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[(self.vocabulary >> U64(64 - TABLE_BITS)).astype(np.int64)] = True

        lengths = np.diff(before)
        self.longest = int(lengths.max(initial=0))
        n_windows = np.where(lengths > 0, np.maximum(1, lengths - window + 1), 0)
        self.item = np.repeat(np.arange(len(lengths)), n_windows)
        self.start = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        self.size = np.minimum(window, lengths)[self.item]
        # The sequence with room behind, and each window's words packed with low and with high padding.
        sequence = np.concatenate([ranks + 1, np.zeros(window + self.per + PRUNE, np.int64)]).astype(np.uint64)
        at = before[:-1][self.item] + self.start
        self.depth = math.ceil(window / self.per)
        self.low = np.zeros((len(at), self.depth), np.uint64)
        self.high = np.zeros((len(at), self.depth), np.uint64)
        top = U64((1 << bits) - 1)
        for k in range(self.depth * self.per):
            inside = k < self.size
            word = np.where(inside, sequence[np.minimum(at + k, len(sequence) - 1)], U64(0))
            step, shift = k // self.per, U64(bits * (self.per - 1 - k % self.per))
            self.low[:, step] |= word << shift
            self.high[:, step] |= np.where(inside, word, top) << shift
        # What a suffix must begin with: the first PRUNE words of a window, fewer where the window is shorter.
        self.begins = {}
        for n in range(1, PRUNE + 1):
            rows = np.flatnonzero(np.minimum(self.size, PRUNE) == n)
            if len(rows):
                table = np.zeros(1 << TABLE_BITS, bool)
                table[self._begin(sequence, at[rows], n)] = True
                self.begins[n] = table

    @staticmethod
    def _begin(sequence: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        code = sequence[at]
        for k in range(1, n):
            code = mix(code) + sequence[at + k]
        return (mix(code) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Ranks from 1 of the words that the benchmark has, else 0."""
        out = np.zeros(len(words), np.uint64)
        maybe = np.flatnonzero(self.known[(words >> U64(64 - TABLE_BITS)).astype(np.int64)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[place] == words[maybe], place + 1, 0)
        return out

    def packed(self, sequence: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """`per` words from at + depth on; behind a 0 there are only 0s, since no match goes on there."""
        out = np.zeros(len(at), np.uint64)
        going = np.ones(len(at), bool)
        for k in range(self.per):
            word = sequence[np.minimum(at + depth + k, len(sequence) - 1)]
            going &= word > 0
            out = (out << U64(self.bits)) | np.where(going, word, U64(0))
        return out

    def suffix_array(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that may begin a match in the order of their words, and their first words, packed."""
        inside = np.flatnonzero(sequence > 0)
        possible = np.zeros(len(inside), bool)
        for n, table in self.begins.items():
            possible |= table[self._begin(sequence, inside, n)]
        at = inside[possible]
        first = self.packed(sequence, at, 0)
        order = np.argsort(first, kind="stable")
        at, last_key = at[order], first[order]
        group = np.cumsum(np.concatenate([[False], last_key[1:] != last_key[:-1]])) if len(at) else np.zeros(0, np.int64)
        low_word = U64((1 << self.bits) - 1)
        depth, rows = self.per, np.arange(len(at))
        while depth < self.longest and len(rows):
            size = np.bincount(group, minlength=group[-1] + 1)
            open_ = (size[group] > 1) & ((last_key & low_word) > 0)
            rows, group = rows[open_], group[open_]
            if not len(rows):
                break
            key = self.packed(sequence, at[rows], depth)
            order = np.lexsort((key, group))
            at[rows] = at[rows[order]]
            key, group = key[order], group[order]
            group = np.cumsum(np.concatenate([[False], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
            last_key, depth = key, depth + self.per
        keys = np.stack([self.packed(sequence, at, self.per * d) for d in range(self.depth)], axis=1)
        return at, keys

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window the range of suffixes that begin with it, by bisection of all at once."""
        bounds = []
        for wanted, strict in ((self.low, False), (self.high, True)):
            low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
            for _ in range(len(keys).bit_length()):
                middle = (low + high) >> 1
                there = keys[np.minimum(middle, len(keys) - 1)]
                less = np.zeros(len(wanted), bool)
                equal = np.ones(len(wanted), bool)
                for d in range(self.depth):
                    less |= equal & (there[:, d] < wanted[:, d])
                    equal &= there[:, d] == wanted[:, d]
                go = (less | equal if strict else less) & (low < high)
                low, high = np.where(go, middle + 1, low), np.where(go | (low >= high), high, middle)
            bounds.append(low)
        return bounds[0], bounds[1]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word bounds of the documents, and all (window, document, first word) of a block that match."""
        words, before = word_hashes(data, offsets, self.alphabet)
        docs = len(before) - 1
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.item):
            return before, none, none, none
        # One 0 behind each document, and some at the end.
        sequence = np.zeros(len(words) + docs + self.longest + self.per + WINDOW + PRUNE, np.uint64)
        doc_of_word = np.repeat(np.arange(docs), np.diff(before))
        sequence[np.arange(len(words)) + doc_of_word] = self.ranks(words)
        at, keys = self.suffix_array(sequence)
        if not len(at):
            return before, none, none, none
        low, high = self.search(keys)
        counts = high - low
        window = np.repeat(np.arange(len(counts)), counts)
        place = at[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        doc = np.searchsorted(before[:-1] + np.arange(docs), place, side="right") - 1
        return before, window, doc, place - before[doc] - doc


def _runs(keys: list[np.ndarray], step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and step, and a mark where a run of equal keys and consecutive steps begins."""
    order = np.lexsort((step, *keys[::-1]))
    begins = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    begins[1:] = ~(same & (np.diff(step[order]) <= 1))
    return order, begins


def _found(test: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    before, window, doc, first = test.matches(data, offsets)
    n_words = np.diff(before)
    docs = len(n_words)
    size, item, item_word = test.size[window], test.item[window], test.start[window]
    # Words inside any window, as spans: what starts no later than the end so far goes on with the span.
    step = np.zeros(int(before[-1]) + docs + 1, np.int64)
    np.add.at(step, before[doc] + doc + first, 1)
    np.add.at(step, before[doc] + doc + first + size, -1)
    covered = np.cumsum(step) > 0
    edges = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc_start = before[:-1] + np.arange(docs)
    span_doc = np.searchsorted(doc_start, begins, side="right") - 1
    n_hit = np.bincount(span_doc, weights=ends - begins, minlength=docs).astype(np.int64)
    spans = pa.StructArray.from_arrays([pa.array((x - doc_start[span_doc]).astype(np.int32)) for x in (begins, ends)], ["first", "last"])
    # Longest matches: windows that follow each other on one diagonal.
    order, new = _runs([doc, item, first - item_word], item_word)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order))[: len(heads)] - 1
    head, tail = order[heads], order[tails]
    match_doc, match_item = doc[head], item[head]
    names = test.ids[match_item]
    matched = pa.StructArray.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array(item_word[head].astype(np.int32)),
            pa.array(first[head].astype(np.int32)),
            pa.array((item_word[tail] + size[tail] - item_word[head]).astype(np.int32)),
        ],
        ["item", "item_word", "first", "words"],
    )
    # `order` goes by document first, so matches do too.
    items = [sorted(set(some)) for some in np.split(names, np.cumsum(np.bincount(match_doc, minlength=docs))[:-1])] if docs else []
    return [
        pa.array(n_words.astype(np.int64)),
        pa.array(n_hit),
        pa.array(items, pa.list_(pa.string())),
        list_array(spans, np.bincount(span_doc, minlength=docs)),
        list_array(matched, np.bincount(match_doc, minlength=docs)),
    ]


def _slices(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items and texts in slices of about `limit` bytes; each is read by the driver on its own."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def _scan(docs: DataFrame, test: tuple[list[str], list[str]], text_col: str, window: int) -> DataFrame:
    """All columns of the documents and the struct `found`; every column is renamed on the way, so none can clash."""
    shared = docs.sparkSession.sparkContext.broadcast({"ids": test[0], "texts": test[1], "built": []})
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if not state["built"]:
            state["built"].append(TestSuffixes(state["ids"], state["texts"], window))
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(place)):
                made = _found(state["built"][0], data, offsets)
                columns = [*batch.slice(first, last - first).columns, *made]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words", "n_hit", "items", "spans", "matches"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", " + FOUND
    found = plain.mapInArrow(run, schema)
    return found.select(*(F.col(f"c{i}") for i in range(len(names))), F.struct("n_words", "n_hit", "items", "spans", "matches").alias("found"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Rows (id, n_words, n_hit, items, spans, matches): words inside matched windows, and the longest matches.

    Spans are [first, last) in words. A match has the item, the word it begins at in the item and in the document,
    and its length in words.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    passes = [_scan(plain, test, "text", window) for test in _slices(benchmark, item_col, item_text_col, slice_bytes)]
    if len(passes) == 1:
        return passes[0].select(F.col("c0").alias(id_col), "found.*")
    # Several passes: gather what they found for each different document, then give it to every row of it.
    key: list[Column] = [F.col("c0").alias("id"), F.xxhash64("c1", F.isnull("c1")).alias("text_hash")]
    found = None
    for one in passes:
        rows = one.select(*key, "found")
        found = rows if found is None else found.unionByName(rows)
    lists = found.groupBy("id", "text_hash").agg(
        F.max("found.n_words").alias("n_words"),
        *(F.array_distinct(F.flatten(F.collect_set(f"found.{c}"))).alias(c) for c in ("items", "spans", "matches")),
    )
    joined = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<struct<first:int,last:int>>), (done, s) -> IF(size(done) > 0 AND element_at(done, -1).last >= s.first, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last)))), concat(done, array(s))))"
    )
    lists = lists.withColumn("spans", joined).withColumn("items", F.array_sort("items"))
    lists = lists.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first)"))
    lists = lists.withColumnRenamed("id", "found_id")
    rows = plain.select("id", F.xxhash64("text", F.isnull("text")).alias("row_hash"))
    rows = rows.join(lists, rows.id.eqNullSafe(lists.found_id) & (rows.row_hash == lists.text_hash))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", "matches")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The documents without any matched window, with their own columns; each slice only sees what is left."""
    names = docs.columns
    for test in _slices(benchmark, item_col, item_text_col, slice_bytes):
        docs = _scan(docs, test, text_col, window).filter("found.n_hit = 0").drop("found").toDF(*names)
    return docs
