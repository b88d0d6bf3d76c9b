"""Language identification by mixture inference over byte trigrams.

Training counts hashed trigrams per language over all labelled rows: each task adds up its own counts, Spark sums them,
and the smoothed probabilities (`BUCKETS` per language) are the model. A document is read as a mixture: every trigram
comes from one of the languages or from an even background. Expectation-maximisation estimates the shares of all
languages; then sets of the first 1, 2, ... languages by share are fitted on their own, as long as the likelihood less
half a logarithm of the number of trigrams per language still grows. The language with the largest share of the
selected set is predicted, its share is the score. All documents of a block are fitted at once.

Results: null texts and texts without a letter are `und` with score 0; so is everything if no row is labelled. Texts
with letters but without a trigram get the most frequent label. Equal shares go to the more frequent language, then by
name. Rows are judged one by one, so repeated rows have repeated results; only id, text and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import text_chunks

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.05
STEPS = 10
SET_STEPS = 6
MAX_LANGUAGES = 200
UNKNOWN = "und"
FOUND = "lang_pred string, score double, background double, shares map<string,double>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams with a letter, and the row each is in; ASCII signs and digits count as blanks."""
    rows = len(offsets) - 1
    letter = _LETTER[data]
    text = np.where(letter, _LOWER[data], 32).astype(np.uint32)
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    second = text[1:].copy()
    capital = (text[:-1] == 0xC3) & (second >= 0x80) & (second < 0x9F) & (second != 0x97)
    second[capital] += 0x20  # capital letters of Latin-1
    text[1:] = second
    row = np.repeat(np.arange(rows), np.diff(offsets))
    keep = (row[2:] == row[:-2]) & (letter[1:-1] | (letter[:-2] & letter[2:]))
    code = (text[:-2] << 16 | text[1:-1] << 8 | text[2:])[keep]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), row[:-2][keep]


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (most rows first), their shares of the rows, and log probabilities (language, bucket) from all rows.

    The driver gets `BUCKETS` counts per language at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts = np.zeros((0, BUCKETS + 1), np.int64)  # the last column counts rows
        for batch in batches:
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            if len(names) > len(counts):
                counts = np.concatenate([counts, np.zeros((len(names) - len(counts), BUCKETS + 1), np.int64)])
            counts[:, BUCKETS] += np.bincount(codes, minlength=len(names))
            for first, last, data, offsets in text_chunks(batch.column(0)):
                buckets, rows = _trigrams(data, offsets)
                cell = codes[first:last][rows] * BUCKETS + buckets
                counts[:, :BUCKETS] += np.bincount(cell, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
        for name, code in names.items():
            at = np.flatnonzero(counts[code])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[code, at])], names=["lang", "bucket", "count"])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang")).filter("lang is not null and text is not null")
    summed = labelled.mapInArrow(run, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    table = summed.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toPandas()
    counts = {str(lang): np.bincount(g["bucket"], weights=g["count"], minlength=BUCKETS + 1) for lang, g in table.groupby("lang")}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    languages = sorted(counts, key=lambda x: (-counts[x][BUCKETS], x))
    rows = np.array([counts[x][BUCKETS] for x in languages])
    grams = np.array([counts[x][:BUCKETS] for x in languages]).reshape(len(languages), BUCKETS)
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return languages, rows / max(1, rows.sum()), logs.astype(np.float32)


class Mixtures:
    """Fits all documents of a block: rows of `p` are different trigrams of a document, with their counts."""

    def __init__(self, p: np.ndarray, counts: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray):
        self.p, self.counts, self.starts, self.doc, self.total = p, counts, starts, doc, total

    def of(self, docs: np.ndarray) -> "Mixtures":
        """The same for some of the documents."""
        keep = docs[self.doc]
        sizes = np.diff(np.append(self.starts, len(self.doc)))[docs]
        return Mixtures(self.p[keep], self.counts[keep], np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), self.total[docs])

    def fit(self, shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after some steps from the given ones (a share of 0 stays 0), and the log likelihoods."""
        for _ in range(steps):
            joint = self.p * shares[self.doc]
            joint *= (self.counts / joint.sum(axis=1))[:, None]
            shares = (np.add.reduceat(joint, self.starts, axis=0) / self.total[:, None]).astype(np.float32)
        mixed = np.einsum("ij,ij->i", self.p, shares[self.doc])
        return shares, np.add.reduceat(self.counts * np.log(mixed), self.starts)


def _select(block: Mixtures, n_languages: int) -> np.ndarray:
    """Shares of the languages and, last, of the background, for the set with the best penalised likelihood."""
    docs = len(block.total)
    even = np.full((docs, n_languages + 1), 1 / (n_languages + 1), np.float32)
    shares, _ = block.fit(even, STEPS)
    order = np.argsort(-shares[:, :n_languages], axis=1, kind="stable")
    best_shares, best = np.zeros_like(shares), np.full(docs, -np.inf)
    open_, part = np.arange(docs), block
    for size in range(1, n_languages + 1):
        start = np.zeros((len(open_), n_languages + 1), np.float32)
        np.put_along_axis(start, order[open_, :size], np.take_along_axis(shares[open_], order[open_, :size], 1) + 1e-3, 1)
        start[:, -1] = shares[open_, -1] + 1e-3
        start /= start.sum(axis=1, keepdims=True)
        fitted, likelihood = part.fit(start, SET_STEPS)
        value = likelihood - size * 0.5 * np.log(part.total)
        better = value > best[open_]
        best[open_[better]], best_shares[open_[better]] = value[better], fitted[better]
        if not better.any():
            break
        open_, part = open_[better], part.of(better) if not better.all() else part
    return best_shares


def _predict(data: np.ndarray, offsets: np.ndarray, probabilities: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Shares (language ..., background) of each row."""
    rows, languages = len(offsets) - 1, len(prior)
    buckets, row = _trigrams(data, offsets)
    out = np.zeros((rows, languages + 1), np.float32)
    out[:, :languages] = prior
    if len(buckets):
        cell, counts = np.unique(row << BUCKET_BITS | buckets, return_counts=True)
        doc = cell >> BUCKET_BITS
        seen, starts, doc = np.unique(doc, return_index=True, return_inverse=True)
        counts = counts.astype(np.float32)
        block = Mixtures(probabilities[cell & (BUCKETS - 1)], counts, starts, doc, np.add.reduceat(counts, starts))
        out[seen] = _select(block, languages)
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", found_col: str = "language") -> DataFrame:
    """The documents' own columns and a struct `found_col` (lang_pred, score, background, shares of the selected set).

    `found_col` replaces a column of that name.
    """
    languages, prior, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(np.concatenate([np.exp(logs), np.full((1, BUCKETS), 1 / BUCKETS, np.float32)]).T.copy() if languages else None)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(place)):
                part = batch.slice(first, last - first)
                lettered = _has_letter(part.column(place), data, offsets)
                shares = _predict(data, offsets, shared.value, prior) if languages else np.zeros((len(lettered), 1), np.float32)
                known = lettered & bool(languages)
                best = shares[:, :-1].argmax(axis=1) if languages else np.zeros(len(lettered), int)
                score = np.where(known, shares[:, :-1].max(axis=1, initial=0.0), 0.0)
                predicted = [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                maps = [[(languages[i], float(s[i])) for i in np.flatnonzero(s[:-1] > 0)] if k else [] for s, k in zip(shares, known.tolist())]
                made = [pa.array(predicted), pa.array(np.clip(score, 0, 1).astype(np.float64)), pa.array(shares[:, -1].astype(np.float64)), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*batch.schema.names, "lang_pred", "score", "background", "shares"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    found = plain.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", " + FOUND)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != found_col]
    return found.select(*kept, F.struct("lang_pred", "score", "background", "shares").alias(found_col))


def _has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter: by their bytes if one is in a-z, else by their characters."""
    ascii_letter = (_LETTER[data] & (data < 128)).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    other = np.flatnonzero(~found & (offsets[1:] > offsets[:-1]))
    if len(other):
        for i, text in zip(other.tolist(), pc.take(texts, pa.array(other)).to_pylist()):
            found[i] = text is not None and any(c.isalpha() for c in text)
    return found


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: a quarter, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_unknown(docs: DataFrame, text_col: str = "text", label_col: str = "lang", most_background: float = 0.5) -> DataFrame:
    """The documents, with their own columns, that have a language: texts of no language or mostly background go."""
    model = learn(docs, text_col, label_col)
    own = "language" + "_" * max((len(n) for n in docs.columns), default=0)  # longer than any name there is
    found = predict(docs, model, text_col, own)
    if model[0]:
        return found.filter((F.col(f"{own}.lang_pred") != UNKNOWN) & (F.col(f"{own}.background") <= most_background)).drop(own)
    return found.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")).drop(own)
