"""Token ids of a corpus as compressed blocks in files, and back.

Documents are dealt into ranges of ascending id; each task encodes its range, puts the ids of all its documents one
behind the other and cuts them into blocks of `BLOCK` ids. A row of a file has whole documents, about `ROW` ids or one
longer document: their ids and sizes, and the blocks (`range_coder`: magic, number of ids, checksum, coded ids), the last
of which may be short. Blocks are independent: any of them can be read alone, and Spark's writer commits a file only
when its task is done, so a lost executor leaves no torn file. The files can lie in any store that Spark writes to.

Rows are decoded in any order and give whole documents, so nothing is moved to read them. The place of a document in the
whole stream follows from its row and from the ids per range, one row each.

Results: a null text is encoded as empty and has only the end id. Documents with a null id come first. Rows that
repeat an id follow each other in no fixed order. An empty table gives files without rows, and these no documents.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.llm.bpe import KNOWN_LENGTH, KNOWN_PIECES, byte_characters, shared_tokenizer
from snipdex.llm.range_coder import decode_blocks, encode_blocks

BLOCK = 2048
ROW = 64 * BLOCK
GROUP = 3072
SLICE_BYTES = 6_000_000
END_ID = 1


#: What texts go through before words are merged; pieces of texts for other tokenizers go to the library as they are.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
BLANKS = re.compile("[\t-\r ]")
OTHER, BLANK, LETTER, NUMBER, SIGN = range(5)


def character_kinds(special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the characters below 0x10000 that act alone; `OTHER` are for the library to judge.

    Those are marks and what composes or changes its length, blanks and control characters, apostrophes, which begin
    contractions, and first characters of special tokens."""
    kinds, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for code in range(33, 0xD800):
        char = chr(code)
        kind = {"L": LETTER, "N": NUMBER, "P": SIGN, "S": SIGN}.get(unicodedata.category(char)[0], OTHER)
        small = char.lower()
        if kind != OTHER and len(small) == 1 and unicodedata.normalize("NFC", char) == char and not 0x1100 <= code < 0x1200:
            kinds[code], lower[code] = kind, ord(small)
    for char in ["'", *(s[0] for s in special)]:
        kinds[min(ord(char), 0xFFFF)] = OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    return kinds, lower


class LibraryEncoder:
    """The tokenizers library, asked once for each word that a worker does not remember.

    Texts are cut into words by numpy. What holds a character that `character_kinds` leaves to the library is not: it
    goes to the library whole, from blank to blank, and is remembered like a word."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(text)
        self.kinds, self.lower = character_kinds([t["content"] for t in spec["added_tokens"]])
        if any(spec.get(step) != STEPS[step] for step in STEPS):
            self.kinds[self.kinds != BLANK] = OTHER
        self.byte_names = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.model = self.library.model
        self.known: dict[str, int] = {}  # words with a blank before them, and their places in `sizes`
        self.sizes, self.stream, self.uses, self.characters = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def _forget(self) -> None:
        """Keep the words that were in more than one slice since the last time, or none if that is more than half."""
        keep = np.flatnonzero(self.uses > 1)
        words = list(self.known)
        words = [words[i] for i in keep]
        characters = sum(map(len, words))
        if 2 * len(words) > len(self.known) or 2 * characters > self.characters:
            keep, words, characters = keep[:0], [], 0
        start, sizes = (np.cumsum(self.sizes) - self.sizes)[keep], self.sizes[keep]
        self.stream = self.stream[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.known, self.sizes, self.uses, self.characters = dict(zip(words, range(len(words)))), sizes, np.zeros(len(words), np.int64), characters

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_names)
        return [t.id for t in self.model.tokenize(word)]

    def _places(self, words: list[str], whole: set[int]) -> np.ndarray:
        """Places of different words; those in `whole` are pieces for the whole library."""
        if len(self.known) > KNOWN_PIECES // 2 or self.characters > KNOWN_PIECES * KNOWN_LENGTH // 2:  # the coder needs room too
            self._forget()
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found < 0)
        new = [words[i] for i in at]
        asked = [words[i][1:] for i in at if i in whole] if whole else []
        answers = iter(self.library.encode_batch_fast(asked, add_special_tokens=False))
        ids = [next(answers).ids if i in whole else self._word(words[i][1:]) for i in at.tolist()]
        found[at] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)))
        self.stream = np.append(self.stream, np.fromiter(chain.from_iterable(ids), np.uint32))
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[found] += 1
        self.characters += sum(map(len, new))
        return found

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
        """Words, each with a blank before it, how many each text has, and which are whole pieces if any is."""
        codes = np.frombuffer("\n".join(texts.to_numpy(zero_copy_only=False)).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1)
        kinds = self.kinds.take(codes, mode="clip")
        small = self.lower.take(codes, mode="clip")
        begins = kinds == NUMBER
        begins[1:] |= kinds[1:] != kinds[:-1]
        begins[:1] = True
        inside = kinds != BLANK
        begins &= inside
        other = None
        if not kinds.all():  # a piece with a character of kind OTHER is one word, and stays as it is
            piece = np.cumsum(~inside)
            odd = np.zeros(int(piece[-1]) + 1, bool)
            odd[piece[kinds == OTHER]] = True
            odd = odd[piece] & inside
            small[odd] = codes[odd]
            begins[1:] &= ~(odd[1:] & inside[:-1])
            other = odd[begins]
        firsts = np.flatnonzero(begins)
        counts = np.diff(np.append(0, np.searchsorted(firsts, ends)))
        spaced = np.full(int(inside.sum()) + len(firsts), 32, np.uint32)
        letter = np.ones(len(spaced), bool)
        letter[np.flatnonzero(begins[inside]) + np.arange(len(firsts))] = False
        spaced[letter] = small[inside]
        letters = np.frombuffer(spaced.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        offsets = np.append(np.flatnonzero(letters == 32), len(letters))
        words = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(letters))
        return words, counts, other

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has; null is empty."""
        if len(texts) != 1 or texts.nbytes <= 2 * SLICE_BYTES:
            return self._encode(texts)
        text, found, at = texts[0].as_py(), [], 0
        while at < len(text):  # one long text, in parts that end with a blank
            blank = BLANKS.search(text, at + SLICE_BYTES)
            stop = blank.end() if blank else len(text)
            found.append(self._encode(pa.array([text[at:stop]]))[0])
            at = stop
        ids = np.concatenate(found)
        return ids, np.array([len(ids)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts, other = self._cut(pc.fill_null(texts, ""))
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        whole = set() if other is None else set(np.unique(which[other]).tolist())
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole)
        start = (np.cumsum(self.sizes) - self.sizes)[places]
        sizes = self.sizes[places].take(which)
        ends = np.cumsum(sizes)
        at = np.repeat(start.take(which) - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.stream.take(at), np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])


def arrow_slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids (column 0) and texts (column 1) in slices of up to `size` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)
        first = last


def even_groups(n: int) -> Iterator[tuple[int, int]]:
    """First and last of about `GROUP` blocks each, so that no group is much smaller than the others."""
    step = -(-n // max(1, round(n / GROUP)))
    for first in range(0, n, max(1, step)):
        yield first, min(n, first + step)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all texts, each with the end id behind it, in ascending order of the document ids."""
    shared = shared_tokenizer(docs, tokenizer)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value["built"]
        if "library" not in state:
            state["library"] = LibraryEncoder(shared.value["file"])
        encoder, part = state["library"], TaskContext.get().partitionId()
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # documents not yet in a row: ids, sizes, tokens
        held, placed = 0, 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, placed
            keys = pa.concat_arrays([k for k, _, _ in waiting])
            sizes, stream = (np.concatenate(x) for x in list(zip(*waiting))[1:])
            ends = np.append(0, np.cumsum(sizes))
            cuts = [0]  # a row ends with the first document that brings it to ROW tokens
            while cuts[-1] < len(sizes):
                cut = int(np.searchsorted(ends, ends[cuts[-1]] + ROW))
                if cut > len(sizes) and not last:
                    break
                cuts.append(min(cut, len(sizes)))
            done = cuts[-1]
            firsts = ends[cuts]
            blocks = [stream[at : min(at + BLOCK, stop)] for first, stop in zip(firsts, firsts[1:]) for at in range(first, stop, BLOCK)]
            coded = [c for first, stop in even_groups(len(blocks)) for c in encode_blocks(blocks[first:stop], encoder.ids)]
            n = np.diff(firsts)
            documents = pa.StructArray.from_arrays([keys.slice(0, done), pa.array(sizes[:done])], names=["id", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(placed + firsts[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), documents),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(-(-n // BLOCK))), pa.int32()), pa.array(coded, pa.binary())),
                ],
                names=["part", "start", "n", "documents", "blocks"],
            )
            placed += int(firsts[-1])
            waiting[:] = [(keys.slice(done), sizes[done:], stream[firsts[-1] :].copy())]
            held = len(waiting[0][2])

        for batch in batches:
            for keys, texts in arrow_slices(batch, SLICE_BYTES):
                ids, counts = encoder.encode_all(texts)
                waiting.append((keys, counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))))
                held += len(waiting[-1][2])
                if held >= BLOCK * (GROUP + GROUP // 2):
                    yield from rows(False)
        if held:
            yield from rows(True)

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id")
    ordered.mapInArrow(run, f"part int, start long, n long, documents array<struct<id:{kind},n:long>>, blocks array<binary>").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, ids): every document with its place in the stream and its ids as 32-bit integers, least byte first."""
    stored = spark.read.parquet(path)
    kind = stored.schema["documents"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_blocks = np.append(0, np.cumsum(pc.list_value_length(batch.column(3)).to_numpy()))
            first = 0
            for _, stop in even_groups(int(n_blocks[-1])):
                last = int(np.searchsorted(n_blocks, stop))  # whole rows
                some = batch.slice(first, last - first)
                first = last
                if not some.num_rows:
                    continue
                data = np.concatenate(decode_blocks(some.column(3).flatten().to_pylist()))
                documents, owner = some.column(2).flatten(), some.column(2).value_parent_indices().to_numpy()
                sizes = documents.field("n").to_numpy()
                ends = np.append(0, np.cumsum(sizes))
                if ends[-1] != len(data):
                    raise ValueError("the documents of a row are not those of its blocks")
                row_first = ends[np.append(0, np.cumsum(pc.list_value_length(some.column(2)).to_numpy()))[:-1]]
                start = some.column(1).to_numpy()[owner] + ends[:-1] - row_first[owner]
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * ends), pa.py_buffer(data.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), documents.field("id"), pa.array(start), ids.cast(pa.binary())], names=["part", "id", "start", "data"])

    found = stored.select("part", "start", "documents", "blocks").mapInArrow(run, f"part int, id {kind}, start long, data binary")
    # Where each range begins in the stream; ranges are few: one row for each task that wrote.
    per_range = stored.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    begins, at = [], 0
    for r in per_range:
        begins.append((r["part"], at))
        at += r["n"]
    begins = F.broadcast(spark.createDataFrame(begins, "part int, begins long"))
    return found.join(begins, "part").select(F.col("id").alias(id_col), (F.col("begins") + F.col("start")).alias("start"), F.col("data").alias("ids"))
