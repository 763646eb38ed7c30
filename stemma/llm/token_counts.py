"""Token counts through a cache of digests.

The cache is a Parquet table of (tokenizer digest, content digest, count), kept
wherever the caller says.  Normalised contents are joined to it by both digests;
only distinct misses are encoded, and their counts are appended.  A text moves
at most once, and only when it is a miss: each task first drops repeats of its
own, so even the largest group of copies sends one row from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.encoding import text_slices
from stemma.llm.shared import quoted, shared_folder, unused, with_replaced

#: Words kept in a worker's memory before they are forgotten.
CACHE_WORDS = 400_000
CACHE_SCHEMA = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


@lru_cache(maxsize=4)
def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordCounts:
    """Token counts of texts, as the sum over the words between spaces and line feeds.

    Only for tokenizers no token of which crosses such a place (the words' own
    counts are the library's, so nothing of its normalisation is repeated here).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, int] = {"": 0}

    def counts(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = 0
        missing = list({w for words in split for w in words if w not in known})
        for k in range(0, len(missing), 20_000):
            part = missing[k : k + 20_000]
            known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]


class PieceCounts:
    """Token counts by a sentencepiece model, text by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class TextCounts(WordCounts):
    """Token counts by the tokenizers library, text by text."""

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(path: str):
    """The counter for a tokenizer's file; words are counted apart where its pre-tokens hold no white space."""
    if path.endswith(".model"):
        return PieceCounts(path)
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    apart = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in str(spec.get("normalizer"))
    return (WordCounts if apart else TextCounts)(path)


def normalised(text, path: str):
    """What is digested: the content, null as empty; where tokens hold no white space, line ends and tabs as spaces."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(content, "\n\r\t", "   ") if isinstance(counter(path), WordCounts) and not isinstance(counter(path), TextCounts) else content


def content_digest(text):
    return F.unhex(F.sha2(text, 256))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest the task has not seen; a task's digests fit in its memory as its input split does."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The cached counts of one tokenizer version, each digest once, or None if there's no cache yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # jobs at the same time may have added the same


def count_tokens(df: DataFrame, path: str, cache: str | None = None, limit: int = 2048, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over_limit: str = "over_limit") -> DataFrame:
    """Adds UTF-8 bytes, token count and whether that is over ``limit`` to each row.

    ``path``: a tokenizers ``.json`` or sentencepiece ``.model`` file that every
    executor can open.  ``cache``: folder of the cache, a new one in the shared
    folder if not given.  A null text counts as empty (0 bytes); repeated rows
    stay; all other columns stay, but those named like an output are replaced;
    an empty table gives an empty result and leaves the cache as it is.
    """
    spark = df.sparkSession
    cache, version = cache or shared_folder(spark), tokenizer_digest(path)
    content = normalised(quoted(text), path)
    texts = df.select(content.alias("text")).select(content_digest(F.col("text")).alias("digest"), "text")
    misses = texts.mapInArrow(_first_of_each, texts.schema)
    if (known := read_cache(spark, cache, version)) is not None:
        misses = misses.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in _first_of_each(batches):
            for part, own in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(own)), part.column("digest"), pa.array(count(own), pa.int64())], names=CACHE_SCHEMA.names)

    misses.repartition("digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    digest, size, n = unused(df, "__digest"), unused(df, "__bytes"), unused(df, "__n")
    known = read_cache(spark, cache, version).withColumnRenamed("digest", digest).withColumnRenamed("n_tokens", n)
    kept = with_replaced(df, n_bytes, n_tokens, over_limit)
    rows = df.select(*[quoted(c) for c in kept], F.octet_length(F.coalesce(quoted(text).cast("string"), F.lit(""))).cast("long").alias(size), content_digest(content).alias(digest))
    return rows.join(known, digest, "left").select(*[quoted(c) for c in kept], F.col(size).alias(n_bytes), F.col(n).alias(n_tokens), (F.col(n) > limit).alias(over_limit))
