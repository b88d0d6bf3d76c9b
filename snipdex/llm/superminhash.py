"""SuperMinHash signatures of sets, for whole blocks of documents at once.

Every element of a set draws, round after round, the next bin of a random permutation of the bins and a random rank;
a bin keeps the lowest (round, rank) of all elements. As no element visits a bin twice, the bins' values are negatively
correlated and the share of equal bins has a lower variance than with independent hash functions. A document is done
as soon as all its bins are filled, since later rounds only bring higher values: large sets stop after a round or two.
"""

from __future__ import annotations

import numpy as np

from snipdex.llm.arrow_text import U64, mix

EMPTY = np.uint64(2**64 - 1)


def signatures(elements: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` values per document; documents' elements follow each other and differ within a document.

    Documents without elements keep the value EMPTY in all bins.
    """
    docs = len(counts)
    values = np.full(docs * bins, EMPTY)
    owner = np.repeat(np.arange(docs, dtype=np.int64) * bins, counts)
    left = np.arange(len(elements), dtype=np.int64)
    order = np.empty((0, bins), np.uint8)
    for step in range(bins):
        draw = mix(elements, step)
        at = step + (((draw & U64(0xFFFFFFFF)) * U64(bins - step)) >> U64(32)).astype(np.int64)
        if step == 0:
            chosen = at
        else:
            rows = np.arange(len(at))
            chosen = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, step]
        np.minimum.at(values, owner + chosen, (draw >> U64(32)) | U64(step << 32))
        open_docs = (values.reshape(docs, bins) == EMPTY).any(axis=1) & (counts > 0)
        stay = open_docs[owner // bins]
        if not stay.any():
            break
        elements, owner = elements[stay], owner[stay]
        if step == 0:
            left = at[stay]
            order = np.tile(np.arange(bins, dtype=np.uint8), (len(left), 1))
            order[np.arange(len(left)), left] = 0
        elif not stay.all():
            order = order[stay]
    return values.reshape(docs, bins)
