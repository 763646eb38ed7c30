"""Stretches of a text that repeat with a period, found by comparing its words with themselves at every lag.

Words become numbers.  For each lag q up to n / least exponent the numbers are
compared with themselves q places on, whole arrays at a time; where they agree
for long enough the text has period q.  Documents of a slice stand one after the
other, longest first, so that one comparison serves all that are long enough for
the lag.  Agreements are run-length coded only around places that agree at three
neighbouring multiples of a third of the length asked for, which no run misses.

A long document is not one task's work: its lags are dealt in ranges of LAGS, and
Spark spreads the (document, range) rows over all machines; what the ranges find
is put together by the document's digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.shared import few_or_shuffled, quoted, unused, with_replaced, written
from stemma.llm.words import codes_of, slices, words_of

#: Lags of a document that one row deals out, and bytes of a text above which its lags are dealt.
LAGS, LONG = 2048, 65_536
EXPONENT, LEAST = 4, 6
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
WORDS = "[^\\x20\\x09-\\x0D]+"


def scanned(ids: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST, lags: np.ndarray | None = None) -> pd.DataFrame:
    """``doc``, ``start``, ``length``, ``period`` of all runs.

    ``ids``: word numbers (not negative), document after document; ``lags``: the
    first and last lag to compare of each document, all by default.  A run that
    is found at multiples of its period too has the least lag that found it.
    """
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    own = np.cumsum(sizes) - sizes
    begin = np.cumsum(size + 1) - (size + 1)
    line = np.empty(int((size + 1).sum()), np.int32)
    place = np.repeat(begin - own[order], size) + np.repeat(own[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(own[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    line[place] = ids[source]
    line[begin + size] = -1 - np.arange(len(size), dtype=np.int32)  # an end equals nothing
    first = np.ones(len(size), np.int64) if lags is None else lags[order, 0]
    last = size // exponent if lags is None else np.minimum(lags[order, 1], size // exponent)
    last = np.where(size >= least, last, 0)
    found: list[tuple[int, int, int, int]] = []
    for q in range(int(first.min(initial=1)), int(last.max(initial=0)) + 1):
        k = int(np.searchsorted(-size, -max(exponent * q, least), side="right"))  # documents long enough
        end = int(begin[k - 1] + size[k - 1]) if k else 0
        if end <= q:
            continue
        equal = line[: end - q] == line[q:end]
        need = max(least - q, (exponent - 1) * q)
        marks = max(1, min(3, need))
        step = max(1, need // marks)
        every = equal[::step]
        agree = every
        for k in range(1, marks):
            agree = agree[:-1] & every[k:]
        at = np.flatnonzero(agree)
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) > 1)
        for i, j in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True):
            low, high = max(0, (i - 1) * step + 1), min(end - q, (j + marks) * step)
            breaks = np.concatenate([[-1], np.flatnonzero(~equal[low:high]), [high - low]])
            for b in np.flatnonzero(np.diff(breaks) > max(need, 1)).tolist():
                start, stop = low + int(breaks[b]) + 1, low + int(breaks[b + 1])
                d = int(np.searchsorted(begin, start, side="right")) - 1
                if stop + q <= begin[d] + size[d] and first[d] <= q <= last[d]:
                    found.append((int(order[d]), start - int(begin[d]), stop - start + q, q))
    runs = pd.DataFrame(found, columns=["doc", "start", "length", "period"], dtype=np.int64)
    return runs.drop_duplicates(["doc", "start", "length"]).sort_values(["doc", "start", "period"], kind="stable")


def _lists(runs: pd.DataFrame, docs: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(runs["doc"], minlength=docs))]).astype(np.int32)
    fields = [pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")]
    values = pa.StructArray.from_arrays([pa.array(runs[f.name].to_numpy(np.int64)) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", values.type, nullable=False)))


def _collapsed(words: pa.Array, sizes: np.ndarray, runs: pd.DataFrame) -> pa.Array:
    """Texts of the words that no run repeats, joined by one space."""
    own = np.cumsum(sizes) - sizes
    cover = np.zeros(len(words) + 1, np.int64)
    begin = own[runs["doc"].to_numpy(np.int64)] + runs["start"].to_numpy(np.int64)
    np.add.at(cover, begin + runs["period"].to_numpy(np.int64), 1)
    np.add.at(cover, begin + runs["length"].to_numpy(np.int64), -1)
    kept = np.cumsum(cover[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    ends = before[np.concatenate([own, [len(words)]])].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(kept))), " ")


def periodic_runs(df: DataFrame, text: str = "text", carry: list[str] | None = None, runs: str = "runs", collapsed: str = "collapsed", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Adds ``runs`` (``start``, ``length``, ``period`` in words, by start and period) and ``collapsed``, the text without repetitions.

    Words stand between ASCII white space.  A run is a stretch with smallest
    period q and a length of ``least`` words and of ``exponent`` (2 or more)
    periods that no word beside it extends; ``collapsed`` has the words that no
    run holds after its first period, joined by one space.  Null, empty and
    blank texts have no runs and collapse to the empty string; texts of any
    length are compared at every lag; repeated rows stay repeated; an empty
    table stays empty; input columns named like an output are replaced.
    ``carry``: the input columns to return, all by default.
    """
    carry = with_replaced(df, runs, collapsed) if carry is None else carry
    held, digest, known = (unused(df, n) for n in ("__text", "__digest", "__known"))
    source = df.select(*[quoted(c) for c in carry], quoted(text).cast("string").alias(held))
    schema = T.StructType([*[source.schema[c] for c in carry], T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    long = F.coalesce(F.octet_length(held) > LONG, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, held):
                sizes, words = words_of(part.column(held))
                table = scanned(codes_of(words)[0], sizes, exponent, least)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], _lists(table, len(sizes)), _collapsed(words, sizes, table)], names=schema.names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                sizes, words = words_of(part.column(held))
                table = pd.DataFrame(part.column(known)[0].as_py() or [], columns=["start", "length", "period"], dtype=np.int64).assign(doc=0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], _lists(table, 1), _collapsed(words, sizes, table)], names=schema.names)

    texts = source.filter(long).withColumn(digest, F.sha2(held, 256))
    found = few_or_shuffled(written(_dealt(texts.select(F.col(digest).alias("digest"), F.col(held).alias("text")), exponent, least)), F.size("known") * 24)
    of_long = texts.join(found.select(F.col("digest").alias(digest), F.col("known").alias(known)), digest, "left").mapInArrow(joined, schema)
    return source.filter(~long).mapInArrow(whole, schema).unionByName(of_long)


def _dealt(texts: DataFrame, exponent: int, least: int) -> DataFrame:
    """``digest``, ``known`` (the runs) of each distinct text that has any; the lags of one text are many tasks' work."""
    each = texts.groupBy("digest").agg(F.first("text").alias("text"))
    most = F.greatest(F.lit(1), F.floor(F.regexp_count("text", F.lit(WORDS)) / exponent)).cast("int")
    ranges = each.select("digest", "text", F.explode(F.sequence(F.lit(1), most, F.lit(LAGS))).alias("first"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, words = words_of(batch.column("text").slice(k, 1))
                low = batch.column("first")[k].as_py()
                table = scanned(codes_of(words)[0], sizes, exponent, least, np.array([[low, low + LAGS - 1]]))
                ids = pa.array([batch.column("digest")[k].as_py()] * len(table), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(table[n].to_numpy(np.int64)) for n in ("start", "length", "period")]], names=["digest", "start", "length", "period"])

    rows = ranges.repartition(tasks, "digest", "first").mapInArrow(scan, "digest string, start long, length long, period long")
    least_period = rows.groupBy("digest", "start", "length").agg(F.min("period").alias("period"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "period", "length")))  # of one text, fewer than its words
    return least_period.groupBy("digest").agg(F.transform(ordered, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("known"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties to the least start, then period; null without runs."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (more > 0), run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)  # by start and period, so that the first of equals stays
