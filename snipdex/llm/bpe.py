"""Byte-pair encoding and decoding of words with a contiguous array of ranks.

A word starts as one part per byte. For every boundary between parts the rank of the merge over it is held in a
plain list beside the parts; the lowest rank is searched by a scan, its boundary is deleted and the ranks of the two
neighbours are looked up again. Words are short, so the scan beats any heap; words over `LONG_WORD` parts (runs
without blanks) use a heap over linked parts instead, with the same result.

The text is cut at white space first, and the ids of a piece between blanks are remembered, since no word crosses
white space. A worker keeps that memory over tasks. It holds short pieces only, in two halves: when the younger one has
`RECENT_PIECES`, the older one is given up; a piece found there is young again. So frequent pieces stay, and a worker
needs the same memory however many different pieces there are.

Texts and ids are taken from their Arrow batch in slices of bounded bytes and ids; the tokens of a slice are looked up
and joined by Arrow, without an object for each.

Results: null is encoded as empty; a null list of ids is decoded as null. Empty tables give empty tables.
Only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import list_array

LONG_WORD = 64
KNOWN_PIECES = 1_000_000
KNOWN_LENGTH = 64
RECENT_PIECES = 200_000
SLICE_BYTES = 2_000_000
SLICE_IDS = 500_000

# Fixed values of the tokenizer: white space, the words within a piece.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printed else next(spare)) for b in range(256)]


class MergeTable:
    """Ids of single bytes and merges, from the tokenizer's file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.first = [vocab[c] for c in characters]
        self.last = [vocab[c + suffix] for c in characters] if suffix else self.first
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}

    def encode_word(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word[:-1]]
        parts.append(self.last[word[-1]])
        return self._merge_short(parts) if len(parts) <= LONG_WORD else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 60, -1)
        ranks = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            parts[at] = best[1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges.get((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = merges.get((parts[at - 1], parts[at]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        merges, n = self.merges, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1], parts[i], parts[i + 1]) for i in range(n - 1) if (found := merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (found := merges.get((parts[a], parts[b]))):
                    heapq.heappush(heap, (found[0], a, found[1], parts[a], parts[b]))
        return [p for p in parts if p >= 0]


class WordEncoder:
    """Encodes whole texts; remembers pieces between blanks."""

    def __init__(self, text: str):
        self.table = MergeTable(text)
        self.words = regex.compile(WORD_PATTERN)
        self.blanks = regex.compile(f"[{SPACE}]+")
        self.separators = re.compile("[\x1c-\x1f]")  # str.split cuts at these too, the tokenizer does not
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.table.special, key=len, reverse=True)))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of a piece without blanks, as 32-bit integers."""
        packed = self.older.get(piece)
        if packed is None:
            ids = array("i")
            for word in self.words.findall(piece):
                ids.extend(self.table.encode_word(word.encode()))
            packed = ids.tobytes()
        if len(piece) <= KNOWN_LENGTH:
            if len(self.known) >= RECENT_PIECES:
                self.older = dict(self.known)
                self.known.clear()
            self.known[piece] = packed
        return packed

    def plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no rule for a final sigma
        text = text.lower()
        pieces = self.blanks.split(text) if self.separators.search(text) else text.split()
        known, piece = self.known.get, self.piece
        return [x if (x := known(p)) is not None else piece(p) for p in pieces if p]

    def encode(self, text: str) -> bytes:
        if "<|" not in text or not self.specials.search(text):
            return b"".join(self.plain(text))
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self.plain(text[at : found.start()])
            out.append(array("i", [self.table.special[found.group()]]).tobytes())
            at = found.end()
        return b"".join(out + self.plain(text[at:]))


def shared_tokenizer(docs: DataFrame, path: str):
    """The tokenizer's file, a few MB, for all workers, and a place where each keeps what it builds from it."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast({"file": file.read(), "built": {}})


def built(shared, kind):
    """What a worker has built from the shared file; kept over tasks."""
    state = shared.value["built"]
    if kind.__name__ not in state:
        state[kind.__name__] = kind(shared.value["file"])
    return state[kind.__name__]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows [first, last) of up to `limit` bytes or ids, or one row if that row alone has more."""
    ends = np.cumsum(sizes)
    first, before = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first, before = last, ends[last - 1]


def text_slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids (column 0) and texts (column 1, null as empty) in slices of bounded length; only a slice's texts are made."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in slices(sizes, size):
        yield batch.column(0).slice(first, last - first), [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the token ids of every whole text, without added special tokens."""
    shared = shared_tokenizer(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = built(shared, WordEncoder)
        for batch in batches:
            for keys, texts in text_slices(batch):
                packed = [encoder.encode(t) for t in texts]
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ids = np.frombuffer(b"".join(packed), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([keys, list_array(ids, counts)], names=["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_strings(path: str) -> pa.Array:
    """The token of every id, null where there is none."""
    with open(path, encoding="utf-8") as file:
        tokens = MergeTable(file.read()).tokens
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())


def joined(lists: pa.Array, strings: pa.Array) -> pa.Array:
    """The strings of every list of ids, joined by one blank; null for a null list."""
    parts = strings.take(lists.flatten())
    if parts.null_count:
        raise ValueError("a list holds a null or an id without a token")
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=offsets[1:])
    made = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), parts), pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), made) if lists.null_count else made


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, decoded): the tokens' strings joined by one blank, as this tokenizer has no decoder."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_strings(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = shared.value
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in slices(counts, SLICE_IDS):
                some = lists.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), some, joined(some, strings)], names=["id", "ids", "decoded"])

    kind = dict(tokens.dtypes)[id_col]
    plain = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return plain.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
