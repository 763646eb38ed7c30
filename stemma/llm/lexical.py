"""Ranked lexical search over document shards with precomputed integer impacts.

``index`` turns documents into shards.  A shard is a row that holds, as compressed
sparse rows, the postings of every term of its documents: for each term the
documents that have it and the impact of each, an integer in which term frequency
and document length are already weighed.  ``search`` goes through a shard term
by term and adds weight times impact to a dense accumulator over the shard's
documents, takes the k best with ``argpartition``, and keeps what ties with the
k-th so that ids decide; tasks merge the shards they have read, Spark the tasks.

An index is a table: it can be stored once and searched often.  Its shards are
of bounded size (a document above the bound is one of its own), and of the
queries a task holds one slice of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.shared import quoted, written
from stemma.llm.words import codes_of, slices, words_of

#: UTF-8 bytes of the texts of a shard, a longer text alone.
SHARD_BYTES = 4 << 20
#: Bytes of queries that are searched for together, a longer query alone.
SLICE_BYTES = 4 << 20
#: Terms are runs of these ASCII characters and of all that is not ASCII; A-Z count as a-z.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c if c >= 128 or chr(c) in LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Impacts in parts of a thousand million; length counts for 90 % of a document's norm.
UNIT, PARTS = 1_000_000_000, 90

SHARD = T.StructType(
    [
        T.StructField("documents", T.ArrayType(T.LongType(), False)),
        T.StructField("terms", T.ArrayType(T.StringType(), False)),
        T.StructField("starts", T.ArrayType(T.IntegerType(), False)),
        T.StructField("places", T.ArrayType(T.IntegerType(), False)),
        T.StructField("impacts", T.ArrayType(T.IntegerType(), False)),
    ]
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each text has (null: none), and all terms."""
    own = pc.fill_null(texts.cast(pa.string()), "")
    own = pa.concat_arrays([own]) if own.offset else own
    size, offsets, data = len(own), own.buffers()[1], own.buffers()[2]
    if not size or data is None:
        return np.zeros(size, np.int64), pa.array([], pa.string())
    ends = np.frombuffer(offsets, np.int32, size + 1, offset=4 * own.offset)
    low = int(ends[0])
    plain = pa.py_buffer(data.slice(low, int(ends[-1]) - low).to_pybytes().translate(_PLAIN))
    return words_of(pa.StringArray.from_buffers(size, pa.py_buffer((ends - low).astype(np.int32)), plain))


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many texts have a term, and how many terms all texts have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = terms = 0
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, _ = terms_of(part.column("text"))
                texts, terms = texts + int((sizes > 0).sum()), terms + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"texts": pa.array([texts]), "terms": pa.array([terms])})

    own = docs.select(quoted(text).cast("string").alias("text")).mapInArrow(count, "texts long, terms long")
    found = own.agg(F.sum("texts").alias("texts"), F.sum("terms").alias("terms")).first()
    return found["texts"] or 0, found["terms"] or 0


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", totals: tuple[int, int] | None = None) -> DataFrame:
    """Shards of the documents: ``documents``, ``terms`` (ascending), ``starts`` (of each term's postings, and their end), ``places`` and ``impacts``.

    The impact of a term that a document of n terms holds tf times is
    10^9 tf div (1000 tf + 8 m), where m is 10 + 90 n N div L for N documents
    with terms and L terms in all; ``totals``: (N, L), counted by default.  A
    document without a key is left out; one without terms is in no posting;
    documents that share a key are documents of their own.
    """
    known = docs.filter(quoted(key).isNotNull()).select(quoted(key).cast("long").alias("key"), quoted(text).cast("string").alias("text"))
    texts, terms = statistics(known) if totals is None else totals

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                sizes, words = terms_of(part.column("text"))
                code, names = codes_of(words)
                order = pc.array_sort_indices(names).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                docs_here = len(sizes)
                pair, tf = np.unique(rank[code] * docs_here + np.repeat(np.arange(docs_here), sizes), return_counts=True)
                term, place = pair // docs_here, pair % docs_here
                norm = (100 - PARTS) + PARTS * sizes * texts // max(terms, 1)
                impact = UNIT * tf // (1000 * tf + 8 * norm[place])
                starts = np.searchsorted(term, np.arange(len(order) + 1))
                row = [part.column("key").cast(pa.int64()), names.take(pa.array(order)), pa.array(starts, pa.int32()), pa.array(place, pa.int32()), pa.array(impact, pa.int32())]
                yield pa.RecordBatch.from_arrays([_one(x) for x in row], names=SHARD.names)

    return known.mapInArrow(build, SHARD)


def _one(values: pa.Array) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, type=pa.list_(pa.field("element", values.type, nullable=False)))


def stored(shards: DataFrame) -> DataFrame:
    """An index as a table in the shared folder."""
    return written(shards, options={"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"})


def search(shards: DataFrame, queries: DataFrame, texts: int, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(``query_id``, ``rank``, ``doc_id``, ``score``): for each query the k documents of highest score above 0.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), N being ``texts`` and df
    the documents that hold it; a query's terms count once each.  Equal scores
    go by ascending document id, and documents that share an id are results of
    their own.  A query with a null id takes no part, one with a null text or
    without terms finds nothing; of queries that share an id and a text one is
    asked, of those with different texts the one with the least text.  Fewer
    matches give fewer rows, empty tables none.
    """
    asked = queries.filter(quoted(key).isNotNull()).groupBy(quoted(key).cast("long").alias("id")).agg(F.min(quoted(text).cast("string")).alias("text")).filter("text IS NOT NULL")
    asked = written(asked.withColumn("size", F.octet_length("text")))
    total = asked.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total * 5 // (4 * SLICE_BYTES)))
    found = [_searched(shards, asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == s), texts, k) for s in range(parts)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _searched(shards: DataFrame, asked: DataFrame, texts: int, k: int) -> DataFrame:
    spark = shards.sparkSession
    own = asked.orderBy("id").toPandas()  # a slice
    ids = own["id"].to_numpy(np.int64)
    sizes, words = terms_of(pa.array(own["text"].tolist(), pa.string()))
    code, names = codes_of(words)
    order = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    wanted = names.take(pa.array(order))
    ends = np.cumsum(sizes)
    terms = [np.unique(rank[code[e - n : e]]) for n, e in zip(sizes, ends, strict=True)]
    lists = spark.sparkContext.broadcast((wanted, terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = lists.value[0]
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, size = _postings(names, batch.column("terms")[row].values, batch.column("starts")[row].values)[::2]
                total[at] += size
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "n": pa.array(total[some])})

    df = np.zeros(len(wanted), np.int64)
    counts = shards.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # the slice's terms
        df[r["term"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(weight)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, terms), weight = lists.value, shared.value
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                docs, places, impacts = (batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("documents", "places", "impacts"))
                at, start, size = _postings(names, batch.column("terms")[row].values, batch.column("starts")[row].values)
                where = np.full(len(names), -1)
                where[at] = np.arange(len(at))
                lists_here = [(places[a : a + n], impacts[a : a + n] * np.int64(w)) for a, n, w in zip(start.tolist(), size.tolist(), weight[at].tolist(), strict=True)]
                for q, own in enumerate(terms):
                    score = np.zeros(len(docs), np.int64)
                    for t in where[own].tolist():
                        if t >= 0:
                            score[lists_here[t][0]] += lists_here[t][1]  # a term's places differ
                    hit = np.flatnonzero(score)
                    if len(hit):
                        top[q] = _highest(*(np.concatenate([x, y]) for x, y in zip(top.get(q, (docs[:0], score[:0])), (docs[hit], score[hit]), strict=True)), k)
        for q, (doc, score) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), ids[q])), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

    kept = shards.mapInArrow(best, "query_id long, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return kept.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _postings(wanted: pa.Array, terms: pa.Array, starts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``wanted`` of the terms that the shard has, and where the postings of each begin and how many they are."""
    found = pc.index_in(wanted, value_set=terms)
    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    own = found.drop_null().to_numpy(zero_copy_only=False)
    begin = starts.to_numpy(zero_copy_only=False).astype(np.int64)
    return at, begin[own], begin[own + 1] - begin[own]


def _highest(docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, of those that tie with the k-th the least ids."""
    if len(score) > k:
        bound = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        above, tied = np.flatnonzero(score > bound), np.flatnonzero(score == bound)
        tied = tied[np.argsort(docs[tied], kind="stable")[: k - len(above)]]
        at = np.concatenate([above, tied])
        return docs[at], score[at]
    return docs, score
