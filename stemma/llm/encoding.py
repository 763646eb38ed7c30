"""BPE encoding and decoding of a text column (see ``bytebpe`` for the method).

One narrow pass: each task encodes its rows in slices, decodes the ids again and
returns both, so no row is moved and memory stays at one slice and the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stemma.llm.bytebpe import loaded
from stemma.llm.shared import quoted, unused, with_replaced

#: Characters of text that are worked on at a time, a longer text alone.
SLICE_CHARS = 2_000_000


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about SLICE_CHARS characters, with their texts (null: empty)."""
    start, chars, texts = 0, 0, []
    for i, x in enumerate(batch.column(column)):
        text = x.as_py() or ""
        if texts and chars + len(text) > SLICE_CHARS:
            yield batch.slice(start, i - start), texts
            start, chars, texts = i, 0, []
        texts.append(text)
        chars += len(text)
    if texts:
        yield batch.slice(start), texts


def encode_decode(df: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (string) for a text column.

    ``path``: a byte-level BPE file that every executor can open; special
    strings inside a text become their ids, none are added.  ``carry``: the
    input columns to return, all but ``text`` by default; input columns named
    like an output are replaced.  A null or empty text has no ids and decodes
    to the empty string; repeated rows stay repeated; an empty table gives an
    empty table; the length of a text is not limited.
    """
    carry = [c for c in (with_replaced(df, ids, decoded) if carry is None else carry) if c not in (ids, decoded) and (carry is not None or c != text)]
    held = unused(df, "__text")
    source = df.select(*[quoted(c) for c in carry], quoted(text).cast("string").alias(held))
    schema = T.StructType([*[source.schema[c] for c in carry], T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part, texts in text_slices(batch, held):
                coded = bpe.encode(texts)
                flat = np.frombuffer(b"".join(coded), "<i4")
                ends = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
                tokens = flat.tolist()
                back = [bpe.decode(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                item = pa.field("element", pa.int32(), nullable=False)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), type=pa.list_(item))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], lists, pa.array(back, pa.string())], names=[*carry, ids, decoded])

    return source.mapInArrow(run, schema)
