"""Words of a column of texts in slices of bounded size, split by Arrow without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that are worked on at a time, a longer text alone.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words between ASCII white space each text has (null: none), and all words, text after text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return np.diff(before[split.offsets.to_numpy()]), flat.filter(pa.array(real))


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal where the words are, and the words that the numbers stand for."""
    if not len(words):
        return np.zeros(0, np.int32), words
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all else as it is."""
    return pc.ascii_lower(texts)
