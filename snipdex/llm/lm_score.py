"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores whole documents.

Words become one of `BUCKETS` tokens by their hash. The network sees the `SIDE` tokens before and after a masked one
and predicts its class; the token within its class follows the corpus counts. The frequent tokens are classes of their
own, the others share classes by their number. So log p(token | both sides) = log p(class | both sides) +
log p(token | class), and a document's score is the sum over all its tokens.

Training takes the whole corpus: counts come from every token, and in `ROUNDS` rounds, each over its share of the
documents (by a hash of the text), every task trains a copy of the model on its documents. Every token of every document
is masked once: the network never sees the token it predicts, so all positions of a text are targets of its round. The
moved parameters are averaged in Spark by block, weighted by how often each row was trained, in two steps
so that no task gathers all copies of a block; the driver only sees the model, whose size is fixed.

Results: null, empty and blank texts have 0 tokens, a sum of 0 and no mean. Equal texts have equal scores up to the
rounding of sums; empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.llm.arrow_text import U64, mix, not_blank, text_chunks, word_hashes

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
CLASSES = 128
OWN = 64
WIDTH = 16
SIDE = 2
HIDDEN = 32
ROUNDS = 2
STEP = 4096
BATCH = 2048
RATE = 0.1
BLOCK_ROWS = 256
SALT = 64

Model = dict[str, np.ndarray]


def _first_model() -> Model:
    rng = np.random.default_rng(5)
    f = np.float32
    return {
        "embedding": rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(f),
        "inner": rng.normal(0, 0.15, (2 * SIDE * WIDTH + 1, HIDDEN)).astype(f),  # the last row is the bias
        "outer": rng.normal(0, 0.15, (HIDDEN + 1, CLASSES)).astype(f),
    }


def _tokens(data: np.ndarray, offsets: np.ndarray, alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens from 1, their neighbours on both sides (0 beyond the text), and the number of tokens before each row."""
    words, before = word_hashes(data, offsets, alphabet)
    tokens = (words >> U64(64 - BUCKET_BITS)).astype(np.int64) + 1
    rows = len(before) - 1
    place = np.arange(len(tokens)) + SIDE * (np.repeat(np.arange(rows), np.diff(before)) + 1)
    line = np.zeros(len(tokens) + SIDE * (rows + 1), np.int64)
    line[place] = tokens
    steps = np.array([s for s in range(-SIDE, SIDE + 1) if s])
    return tokens, line[place[:, None] + steps], before


#: Scores up to this size can be exponentiated and added up in single precision as they are.
SAFE = 60


def _forward(model: Model, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = model["embedding"].take(around.ravel(), axis=0).reshape(len(around), -1)
    hidden = seen @ model["inner"][:-1]
    hidden += model["inner"][-1]
    np.tanh(hidden, out=hidden)
    scores = hidden @ model["outer"][:-1]
    scores += model["outer"][-1]
    if np.abs(model["outer"]).sum(axis=0).max() > SAFE:  # no score is larger, since tanh is not above 1
        scores -= scores.max(axis=1, keepdims=True)
    return seen, hidden, scores


def _train(model: Model, squares: Model, around: np.ndarray, target: np.ndarray) -> None:
    """One step with rates that fall with the squares of past gradients."""
    seen, hidden, scores = _forward(model, around)
    np.exp(scores, out=scores)
    scores *= (1 / (scores.sum(axis=1, keepdims=True) * np.float32(len(target)))).astype(np.float32)
    scores[np.arange(len(target)), target] -= np.float32(1 / len(target))
    back = (scores @ model["outer"][:-1].T) * (1 - hidden * hidden)
    moved = {
        "outer": np.concatenate([hidden.T @ scores, scores.sum(axis=0, keepdims=True)]),
        "inner": np.concatenate([seen.T @ back, back.sum(axis=0, keepdims=True)]),
    }
    into = (back @ model["inner"][:-1].T).reshape(-1, WIDTH)
    flat = around.ravel().astype(np.uint16)  # sorted by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    rows = flat[starts]
    summed = np.add.reduceat(into.take(order, axis=0), starts, axis=0)
    past = squares["embedding"].take(rows, axis=0) + summed * summed
    squares["embedding"][rows] = past
    model["embedding"][rows] = model["embedding"].take(rows, axis=0) - RATE * summed / np.sqrt(past + 1e-10)
    for name, step in moved.items():
        squares[name] += step * step
        model[name] -= RATE * step / np.sqrt(squares[name] + 1e-10)


def _counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every token in the corpus; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, counts = not_blank(), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words, _ = word_hashes(data, offsets, alphabet)
                counts += np.bincount((words >> U64(64 - BUCKET_BITS)).astype(np.int64) + 1, minlength=BUCKETS + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["token", "count"])

    summed = docs.select("text").mapInArrow(run, "token int, count long").groupBy("token").agg(F.sum("count").alias("count")).toPandas()
    return np.bincount(summed["token"], weights=summed["count"], minlength=BUCKETS + 1)


def _classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every token, and the log probability of the token within it."""
    kind = OWN + (mix(np.arange(BUCKETS + 1, dtype=np.uint64), 2) % U64(CLASSES - OWN)).astype(np.int64)
    kind[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(OWN)
    counts = counts + 0.5
    return kind, np.log(counts / np.bincount(kind, weights=counts, minlength=CLASSES)[kind]).astype(np.float32)


def _moved(docs: DataFrame, model: Model, kind: np.ndarray, number: int) -> DataFrame:
    """A round: rows (name, first, salt, moved, weights) by block of parameters, weights being how often a row was trained."""
    shared = docs.sparkSession.sparkContext.broadcast((model, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, classes = shared.value
        own = {n: v.copy() for n, v in start.items()}
        squares = {n: np.zeros_like(v) for n, v in start.items()}
        uses = np.zeros(BUCKETS + 1, np.int64)
        alphabet, trained = not_blank(), 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                tokens, around, _ = _tokens(data, offsets, alphabet)
                order = np.argsort(mix(np.arange(len(tokens), dtype=np.uint64), number))  # documents mixed within the block
                for first in range(0, len(order), STEP):
                    some = order[first : first + STEP]
                    _train(own, squares, around[some], classes[tokens[some]])
                uses += np.bincount(around.ravel(), minlength=BUCKETS + 1)
                trained += len(tokens)
        if trained:
            task = TaskContext.get().partitionId()
            for name, values in own.items():
                for first in range(0, len(values), BLOCK_ROWS):
                    block = slice(first, first + BLOCK_ROWS)
                    weights = uses[block] if name == "embedding" else np.full(len(values[block]), trained)
                    moved = (values[block] - start[name][block]).astype(np.float64) * weights[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([first], pa.int32()), pa.array([task % SALT], pa.int32()), pa.array([moved.ravel()], pa.list_(pa.float64())), pa.array([weights], pa.list_(pa.int64()))],
                        names=["name", "first", "salt", "moved", "weights"],
                    )

    schema = "name string, first int, salt int, moved array<double>, weights array<long>"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[:1].copy()
        row["moved"] = [sum(pdf["moved"].iloc[1:], pdf["moved"].iloc[0].copy())]
        row["weights"] = [sum(pdf["weights"].iloc[1:], pdf["weights"].iloc[0].copy())]
        return row

    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number).select("text")
    return part.mapInArrow(run, schema).groupBy("name", "first", "salt").applyInPandas(added, schema).groupBy("name", "first").applyInPandas(added, schema)


def _round(docs: DataFrame, model: Model, kind: np.ndarray, number: int) -> Model:
    out = {n: v.copy() for n, v in model.items()}
    for r in _moved(docs, model, kind, number).toPandas().itertuples():
        weights = np.maximum(np.asarray(r.weights), 1)
        out[r.name][r.first : r.first + len(weights)] += (np.asarray(r.moved).reshape(len(weights), -1) / weights[:, None]).astype(np.float32)
    return out


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, np.ndarray, np.ndarray]:
    """The model: network, classes of tokens, log probabilities of tokens within their class."""
    docs = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    kind, within = _classes(_counts(docs))
    model = _first_model()
    for number in range(ROUNDS):
        model = _round(docs, model, kind, number)
    return model, kind, within


def score(docs: DataFrame, trained: tuple[Model, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, log_likelihood, mean_log_prob, perplexity) of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kind, within = shared.value
        alphabet = not_blank()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                tokens, around, before = _tokens(data, offsets, alphabet)
                each = np.zeros(len(tokens) + 1)
                for at in range(0, len(tokens), BATCH):
                    some = slice(at, at + BATCH)
                    _, _, scores = _forward(model, around[some])
                    chosen = scores[np.arange(len(scores)), kind[tokens[some]]]
                    each[at : at + len(chosen)] = chosen - np.log(np.exp(scores).sum(axis=1)) + within[tokens[some]]
                sums = np.add.reduceat(each, before[:-1]) if len(before) > 1 else np.zeros(0)
                counts = np.diff(before)
                sums = np.where(counts > 0, sums, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(counts.astype(np.int64)), pa.array(sums)], names=["id", "n_tokens", "log_likelihood"])

    kind_ = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = plain.mapInArrow(run, f"id {kind_}, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return found.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
