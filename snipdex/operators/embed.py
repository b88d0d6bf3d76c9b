"""Batched embedding through a pluggable model function.

An embedder is any picklable callable from a list of texts to one vector per text.  It runs
inside the partitions, on fixed-size batches; text and vector stay in one row.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipdex.functions import text as X

Embedder = Callable[[Sequence[str]], "np.ndarray | list"]

# Fixed values
DEFAULT_MAX_TOKENS = 8192
DEFAULT_BATCH = 10
DEFAULT_ATTEMPTS = 3
BACKOFF_CEILING_MS = 30000

_EMBEDDERS: dict[str, Callable[..., Embedder]] = {}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """Make a model function available by name."""
    _EMBEDDERS[name.lower()] = factory


def embedder(name: str, **options) -> Embedder:
    try:
        return _EMBEDDERS[name.lower()](**options)
    except KeyError:
        raise ValueError(f"unknown embedder {name}; known: {sorted(_EMBEDDERS)}") from None


CACHED_TOKENS = 1 << 17
COUNTED_TOKENS = 1 << 16


class _Slots(dict):
    """Twice the dimension of each word, and one more where its sign is negative."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        digest = hashlib.md5(token.encode()).hexdigest()
        self[token] = 2 * (int(digest[:8], 16) % self.dim) + (int(digest[8], 16) >= 8)
        return self[token]


def hashed_tokens(dim: int = 64) -> Embedder:
    """A deterministic offline model: a signed, hashed bag of lower-cased words, unit length."""
    slots, words = _Slots(dim), re.compile(r"\w+")

    def run(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        sizes, found, first = [], [], 0
        for row, text in enumerate(texts):
            # Two slots for each dimension, one for each sign; the words of several texts are counted at once.
            before = len(found)
            found.extend(map(slots.__getitem__, words.findall(text.lower())))
            sizes.append(len(found) - before)
            if len(found) >= COUNTED_TOKENS or row + 1 == len(texts):
                places = np.array(found, dtype=np.int64) + np.repeat(np.arange(len(sizes)) * 2 * dim, sizes)
                counts = np.bincount(places, minlength=len(sizes) * 2 * dim).reshape(len(sizes), dim, 2)
                out[first : row + 1] = counts[:, :, 0] - counts[:, :, 1]
                sizes, found, first = [], [], row + 1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1.0)

    return run


register_embedder("hashed_tokens", hashed_tokens)


def _call(model: Embedder, texts: list[str], dim: int, attempts: int, base_ms: int, strict: bool):
    """One batch with retries; after the last failure zero vectors, or the error if strict."""
    for attempt in range(1, attempts + 1):
        try:
            vectors = np.asarray(model(texts), dtype=np.float32)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"model gave {vectors.shape}, wanted {(len(texts), dim)}")
            return vectors, True
        except Exception:
            if attempt == attempts:
                if strict:
                    raise
                break
            time.sleep(min(base_ms * 2 ** (attempt - 1), BACKOFF_CEILING_MS) / 1000)
    return np.zeros((len(texts), dim), dtype=np.float32), False


def embed(
    df: DataFrame,
    text_col: str,
    model: Embedder,
    dim: int,
    batch: int = DEFAULT_BATCH,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    attempts: int = DEFAULT_ATTEMPTS,
    base_ms: int = 1000,
    strict: bool = False,
    vector_col: str = "vector",
) -> DataFrame:
    """Add a vector per row, and `embed_ok`.

    The other columns, the original text included, pass through.  A text over `max_tokens` is cut
    into parts that fit; its vector is the mean of theirs by length, scaled to unit length, so
    nothing of a text is left out.  Blank texts are dropped.
    """
    text = F.col(text_col)
    # A character counts twice at most, so parts of half as many characters fit without an estimate.
    half = max(1, max_tokens // 2)
    fits = (F.length(text) <= half) | (X.estimate_tokens(text) <= max_tokens)
    # Blank texts are dropped in Python and a text that fits goes there once: a filter on the text would be pushed into the
    # plan of `df` and have every text made twice.
    ready = df.withColumns({"_blank": X.is_blank(text), "_parts": F.when(~fits, X.chunks(text, half, 0))})
    names, asked = df.columns, text_col
    if text_col not in names:  # a field of a column
        asked, ready = "_text", ready.withColumn("_text", text)
    schema = T.StructType(
        list(df.schema.fields)
        + [T.StructField(vector_col, T.ArrayType(T.FloatType())), T.StructField("embed_ok", T.BooleanType())]
    )
    size = max(1, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(pc.invert(pc.fill_null(part.column("_blank"), True)))
            for start in range(0, part.num_rows, size):
                rows = part.slice(start, size)
                texts = [some or [text] for some, text in zip(rows.column("_parts").to_pylist(), rows.column(asked).to_pylist())]
                vectors, ok = _of_parts(texts, lambda some: _call(model, some, dim, attempts, base_ms, strict), size, dim)
                offsets = pa.array(np.arange(0, (len(vectors) + 1) * dim, dim, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))
                yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [lists, pa.array(ok)], names=names + [vector_col, "embed_ok"])

    return ready.mapInArrow(run, schema)


def _of_parts(texts: list[list[str]], call, size: int, dim: int) -> tuple[np.ndarray, list[bool]]:
    """One vector per list of parts, and whether all its parts were embedded."""
    parts = [(row, t) for row, some in enumerate(texts) for t in some if t.strip()]
    total, weight, ok = np.zeros((len(texts), dim), np.float64), np.zeros(len(texts)), [True] * len(texts)
    for start in range(0, len(parts), size):
        some = parts[start : start + size]
        vectors, good = call([t for _, t in some])
        at, lengths = np.array([row for row, _ in some]), np.array([len(t) for _, t in some], np.float64)
        np.add.at(total, at, vectors.astype(np.float64) * lengths[:, None])
        np.add.at(weight, at, lengths)
        if not good:
            for row in at:
                ok[row] = False
    means = total / np.where(weight > 0, weight, 1)[:, None]
    lengths = np.linalg.norm(means, axis=1, keepdims=True)
    several = np.array([len(some) > 1 for some in texts], bool)[:, None]
    return np.where(several, means / np.where(lengths > 0, lengths, 1), means).astype(np.float32), ok


def embed_once(
    df: DataFrame, text_col: str, model: Embedder, dim: int, cache: str, model_name: str, vector_col: str = "vector", **options
) -> DataFrame:
    """`embed`, with a stored table of vectors by model and content: each different text goes through the model once.

    Texts that the table below `cache` has not are embedded, one row for each, and appended; failed ones are not, and are
    tried again by the next call. One writer at a time.
    """
    from snipdex.session import path_exists

    spark = df.sparkSession
    folder = f"{cache}/model={hashlib.sha256(model_name.encode()).hexdigest()[:16]}-{dim}"
    schema = "content_id string, vector array<float>"
    known = spark.read.schema(schema).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], schema)
    rows = df.filter(~X.is_blank(F.col(text_col))).withColumn("_content", F.sha2(text_col, 256))
    missing = rows.join(known.select(F.col("content_id").alias("_content")), "_content", "left_anti")
    missing = missing.groupBy("_content").agg(F.first(text_col).alias("_text"))
    fresh = embed(missing, "_text", model, dim, **options)
    fresh.filter("embed_ok").select(F.col("_content").alias("content_id"), "vector").write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder).dropDuplicates(["content_id"]).select(F.col("content_id").alias("_content"), F.col("vector").alias("_vector"))
    joined = rows.join(found, "_content", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.select(*df.columns, F.coalesce("_vector", zero).alias(vector_col), F.col("_vector").isNotNull().alias("embed_ok"))
