"""Exact token counts at every prefix of a text, by dynamic programming.

Within a word, the encoding of a prefix is the encoding of a shorter prefix plus one last token, and that token is the
one that stands next to the shorter prefix's last token when the two are encoded together. So one pass over the word
gives `count[j] = count[i] + 1` for every prefix, without merging. A text's count is the sum over its words, and the
question how far a text goes within a budget needs one search in these counts instead of repeated encodings.

Results: null counts as empty (0 tokens). Special strings inside texts count as one token, as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.llm.bpe import KNOWN_LENGTH, KNOWN_PIECES, SPACE, MergeTable, built, byte_characters, shared_tokenizer, text_slices

# Fixed values of the tokenizer: its words.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class PrefixCounter:
    def __init__(self, text: str):
        self.table = MergeTable(text)
        back = {c: b for b, c in enumerate(byte_characters())}
        # Every beginning of a token, with the token's id or -1.
        self.beginnings: dict[bytes, int] = {}
        self.size: dict[int, int] = {}
        for i, token in self.table.tokens.items():
            if token in self.table.special:
                continue
            data = bytes(back[c] for c in token)
            self.size[i] = len(data)
            for n in range(1, len(data)):
                self.beginnings.setdefault(data[:n], -1)
            self.beginnings[data] = i
        self.bytes_of = {i: data for data, i in self.beginnings.items() if i >= 0}
        self.neighbours: dict[int, bool] = {}
        self.words = regex.compile(WORD_PATTERN)
        self.specials = re.compile("|".join(re.escape(s) for s in self.table.special))
        self.blank = regex.compile(f"[{SPACE}]")
        self.mixed_blanks = regex.compile(f"  |[{SPACE}] [{SPACE}]")
        self.before_blank = regex.compile(f"(?= [^{SPACE}])")
        self.known: dict[str, int] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 20 | right
        found = self.neighbours.get(key)
        if found is None:
            found = self.table.encode_word(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.neighbours) >= 4 * KNOWN_PIECES:
                self.neighbours.clear()
            self.neighbours[key] = found
        return found

    def word(self, word: bytes) -> list[int]:
        """Token counts of all prefixes of a word, by bytes, 0 for the empty one."""
        n = len(word)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        beginnings, neighbours, adjacent = self.beginnings.get, self.neighbours.get, self.adjacent
        for i in range(n):
            left = last[i]
            for j in range(i + 1, n + 1):
                token = beginnings(word[i:j])
                if token is None:
                    break
                if token >= 0 and not count[j]:
                    fits = True if left < 0 else neighbours(left << 20 | token)
                    if fits is None:
                        fits = adjacent(left, token)
                    if fits:
                        count[j], last[j] = count[i] + 1, token
        return count

    def piece(self, piece: str) -> int:
        total = sum(self.word(w.encode())[-1] for w in self.words.findall(piece))
        if len(piece) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            self.known[piece] = total
        return total

    def plain(self, text: str) -> int:
        if not text:
            return 0
        # A blank that follows no white space, or precedes none, begins a word: texts fall apart there.
        if self.mixed_blanks.search(text):
            pieces = self.before_blank.split(text)
        else:
            head, *rest = text.split(" ")
            pieces = [" " + p for p in rest]
            pieces.append(head)
        known, piece = self.known.get, self.piece
        return sum([x if (x := known(p)) is not None else piece(p) for p in pieces if p])

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Texts between special strings, and these strings."""
        at = 0
        if "<|" in text:
            for found in self.specials.finditer(text):
                yield text[at : found.start()], False
                yield found.group(), True
                at = found.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        return sum(1 if special else self.plain(s) for s, special in self.segments(text))

    def prefixes(self, text: str) -> list[int]:
        """Token counts of all prefixes of a text, by characters."""
        out: list[int] = [0]
        whole = 0
        for segment, special in self.segments(text):
            if special:
                # Cut inside, the string is ordinary text and belongs to the segment before it.
                for n in range(1, len(segment)):
                    at = len(out) - n  # where the special string begins
                    out.append(out[back] + self.count(text[back : at + n]) if (back := self._safe(text, at)) else self.count(text[: at + n]))
                whole = whole + 1
                out.append(whole)
                continue
            at, previous = 0, ""
            base = before = whole
            for word in self.words.findall(segment):
                data = word.encode()
                counts = self.word(data)
                place, start = 0, len(out)
                for c in word:
                    place += len(c.encode())
                    out.append(base + counts[place])
                if previous and self.blank.fullmatch(word[0]) and not self.blank.sub("", previous):
                    out[start] = before + self.word((previous + word[0]).encode())[-1]  # cut there, the blanks are one word
                if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                    out[start + 1] = base + self.word(b"'")[-1] + self.word(word[1].encode())[-1]
                before, base = base, base + counts[-1]
                previous = word
            whole = base
        return out

    def _safe(self, text: str, at: int) -> int:
        """A place before `at` where a word surely begins: a blank between other characters."""
        while at > 0 and not (text[at] == " " and not self.blank.match(text[at - 1])):
            at -= 1
        return at

    def longest(self, text: str, budget: int) -> tuple[int, int]:
        """Length and count of the longest prefix of at most `budget` tokens."""
        counts = np.array(self.prefixes(text))
        end = int(np.flatnonzero(counts <= budget)[-1])
        return end, int(counts[end])


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    shared = shared_tokenizer(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = built(shared, PrefixCounter)
        for batch in batches:
            for keys, texts in text_slices(batch):
                made = columns(counter, texts)
                yield pa.RecordBatch.from_arrays([keys, *made.values()], names=["id", *made])

    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens) of whole texts."""

    def columns(counter, texts):
        return {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())}

    return _run(docs, path, id_col, text_col, "n_bytes long, n_tokens long", columns)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, counts): the token count at every prefix, counts[i] for the first i characters."""

    def columns(counter, texts):
        return {"counts": pa.array([counter.prefixes(t) for t in texts], pa.list_(pa.int32()))}

    return _run(docs, path, id_col, text_col, "counts array<int>", columns)


def truncate(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, kept, n_tokens): the longest prefix of each text that has at most `budget` tokens."""

    def columns(counter, texts):
        ends = [counter.longest(t, budget) for t in texts]
        return {"kept": pa.array([t[: e[0]] for t, e in zip(texts, ends)], pa.string()), "n_tokens": pa.array([e[1] for e in ends], pa.int64())}

    return _run(docs, path, id_col, text_col, "kept string, n_tokens long", columns)
