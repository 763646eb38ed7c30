"""Packing documents into sequences of bounded length by linear grouping.

Lengths are integers up to the capacity, so the whole packing problem is the
histogram of lengths: at most ``capacity`` numbers, whatever the input.  The
driver plans on that histogram and the executors carry the plan out:

1. Large lengths are put into groups of equal cardinality and rounded up to the
   longest of their group; a linear programme over configurations of these few
   sizes, by column generation with a knapsack, says how often to use each.
2. Actual pieces, in order of length, take the places of their group.  Bins that
   hold the same lengths are one run in the plan.
3. What is left over and all small pieces go, longest first, each into the
   fullest bin that still has room.

Every piece has a rank among the pieces of its length (the count of such pieces
in earlier partitions plus its place in its own), and the plan maps ranges of
ranks to sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.encoding import text_slices
from stemma.llm.shared import quoted, written

CAPACITY = 1024
#: Pieces longer than this part of the capacity are large.
LARGE = 1 / 8
#: Groups of equal cardinality for the large pieces.
GROUPS = 160
#: Steps of the linear programme; when they run out, its last, feasible, answer holds.
LP_STEPS = 1500


# -- the plan ---------------------------------------------------------------


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = LP_STEPS) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, in a least fractional packing."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    level = inverse @ demand
    order = np.arange(k)
    for step in range(steps):
        worth = inverse.sum(0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")  # sizes ascend
        for room in range(1, capacity + 1):
            best[room] = best[room - 1]
            if n := fits[room]:
                gain = best[room - sizes[:n]] + worth[:n]
                if gain[at := int(gain.argmax())] > best[room] + 1e-12:
                    best[room], last[room] = gain[at], at
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        move = inverse @ column
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        level = np.maximum(level - ratio[out] * move, 0)
        level[out] = ratio[out]
        basis[:, out] = column
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
            level = np.maximum(inverse @ demand, 0)
        else:
            pivot = inverse[out] / move[out]
            inverse = inverse - np.outer(move, pivot)
            inverse[out] = pivot
    return [(basis[:, i].astype(int), float(level[i])) for i in order if level[i] > 0]


class Plan:
    """Rows (length, first rank, first sequence, pieces of the row in a sequence, offset); a row holds until the next rank."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self._free: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, how many)
        self._rooms: list[int] = []
        self._taken = dict.fromkeys(counts, 0)
        left = {s: n for s, n in counts.items() if n > 0}
        if full := left.pop(capacity, 0):
            self._place(capacity, full, self._open(full), 1, 0)
        self._by_groups(left, [s for s in sorted(left, reverse=True) if s > large * capacity], groups)
        for size in sorted(left, reverse=True):
            self._best_fit(size, left[size])

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        self.rows.append((size, self._taken[size], first, each, offset))
        self._taken[size] += n

    def _put_back(self, room: int, first: int, n: int) -> None:
        if room and n:
            if not self._free.get(room):
                self._free[room] = []
                bisect.insort(self._rooms, room)
            self._free[room].append((first, n))

    def _by_groups(self, left: dict[int, int], sizes: list[int], groups: int) -> None:
        total = sum(left[s] for s in sizes)
        if not total:
            return
        share, members, fill = max(1, -(-total // groups)), [], 0
        for s in sizes:  # descending: the first of a group is its longest
            n = left[s]
            while n:
                if fill == 0:
                    members.append([])
                take = min(n, share - fill)
                members[-1].append([s, take])
                fill = (fill + take) % share
                n -= take
        members.reverse()
        rounded = np.array([g[0][0] for g in members])
        merged: dict[int, list] = {}
        for r, g in zip(rounded, members, strict=True):  # groups of one length are one size
            merged.setdefault(int(r), []).extend(g)
        rounded = np.array(sorted(merged))
        stock = [merged[int(r)] for r in rounded]
        demand = np.array([sum(n for _, n in g) for g in stock], float)
        for column, level in configurations(rounded, demand, self.capacity):
            have = [sum(n for _, n in stock[g]) // column[g] for g in np.flatnonzero(column)]
            n = min([int(level + 1e-6), *have])
            if n < 1:
                continue
            slots = []  # the lengths that each place takes, sequence after sequence
            for g in np.repeat(np.flatnonzero(column), column[np.flatnonzero(column)]):
                need, runs = n, []
                while need:
                    s, there = stock[g][0]
                    take = min(need, there)
                    runs.append((s, take))
                    need -= take
                    stock[g][0][1] -= take
                    if stock[g][0][1] == 0:
                        stock[g].pop(0)
                slots.append(runs)
            cuts = sorted({c for runs in slots for c in np.cumsum([t for _, t in runs]).tolist()})
            first, at = self._open(n), 0
            offsets = [0] * len(cuts)
            for runs in slots:
                ends = np.cumsum([t for _, t in runs]).tolist()
                at = 0
                for i, cut in enumerate(cuts):
                    s = runs[bisect.bisect_left(ends, cut)][0]
                    self._place(s, cut - at, first + at, 1, offsets[i])
                    left[s] -= cut - at
                    offsets[i] += s
                    at = cut
            at = 0
            for i, cut in enumerate(cuts):
                self._put_back(self.capacity - offsets[i], first + at, cut - at)
                at = cut

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            at = bisect.bisect_left(self._rooms, size)
            if at < len(self._rooms):
                room = self._rooms[at]
                first, many = self._free[room].pop()
                if not self._free[room]:
                    self._rooms.pop(at)
            else:
                room, many = self.capacity, -(-n // (self.capacity // size))
                first = self._open(many)
            each, offset = room // size, self.capacity - room
            whole = min(many, n // each)
            if whole:
                self._place(size, whole * each, first, each, offset)
                self._put_back(room - each * size, first, whole)
                n -= whole * each
            if whole < many:
                if n:
                    self._place(size, n, first + whole, n, offset)
                    self._put_back(room - n * size, first + whole, 1)
                    self._put_back(room, first + whole + 1, many - whole - 1)
                    n = 0
                else:
                    self._put_back(room, first + whole, many - whole)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The rows in order of length and rank, a column each."""
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


# -- documents --------------------------------------------------------------

_TIKTOKEN: dict[str, object] = {}


def _tiktoken(path: str):
    """The vocabulary of a byte-level BPE file in tiktoken's encoder, which gives the same ids."""
    if path not in _TIKTOKEN:
        import tiktoken

        from stemma.llm.bytebpe import PRETOKEN, ByteBpe

        bpe = ByteBpe(path)
        ranks = {b: i for i, b in enumerate(bpe.token_bytes) if b and i not in set(bpe.special.values())}
        _TIKTOKEN[path] = tiktoken.Encoding("packing", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens=bpe.special)
    return _TIKTOKEN[path]


def tokenized_pieces(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of each row's ids: only a document over the capacity is cut, and its first piece takes the remainder."""
    source = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))
    fields = [source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "__place")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _tiktoken(path), [0] * (capacity + 1)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                rows, out, ids_out = [], [], []
                for i, t in enumerate(texts):
                    ids = np.append(encoder.encode_to_numpy(t, allowed_special="all"), end_id).astype("<u4")
                    start, number = 0, 0
                    while start < len(ids):
                        size = (len(ids) - start) % capacity or capacity
                        own = ids[start : start + size]
                        out.append((number, start, size, zlib.crc32(own.tobytes()), seen[size]))
                        rows.append(i)
                        if with_ids:
                            ids_out.append(own.astype(np.int32))
                        seen[size] += 1
                        start, number = start + size, number + 1
                table = np.array(out, np.int64).reshape(-1, 5)
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(table[:, i]) for i in range(5)]]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []), names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields)).withColumn("__part", F.spark_partition_id())


def pack(df: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` ids.

    Returns per piece: ``doc_id`` (the key column), ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id`` (0 to one less than the number of
    sequences), ``offset`` and, if ``with_ids``, ``ids``.  A null or empty text
    is a document of just ``end_id``; a null key stays null; equal rows are
    packed each; other columns are ignored, so their names can't clash; an
    empty table gives an empty result.
    """
    pieces = written(tokenized_pieces(df, path, end_id, key, text, capacity, with_ids))
    counts = written(pieces.groupBy("length", "__part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    sizes, ranks, firsts, eaches, offsets = Plan(histogram, capacity, large, groups).arrays()
    earlier = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    keys = sizes << 44 | ranks

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted(keys, size << 44 | rank, side="right") - 1
        bins, slot = np.divmod(rank - ranks[row], eaches[row])
        return pd.DataFrame({"sequence_id": firsts[row] + bins, "offset": offsets[row] + slot * size})

    placed = pieces.join(base, ["length", "__part"]).withColumn("__at", place("length", F.col("__place") + F.col("__base")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset", *["ids"] * with_ids)
