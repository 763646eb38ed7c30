"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are ordered by a 64-bit hash of their text, so equal texts are neighbours.
Sizes are summed for each hash, range-partitioned, totalled for each partition,
and the totals' prefix sums turn local running sums into global ones.  Cutting
those at equal targets gives one hash bound between any two shards, so a row's
shard follows from its own hash: no text moves to be placed.

A group of equal texts larger than HEAVY of a shard would make a cut miss its
target; there are few of these by their size (under shards / HEAVY), and they
are dealt out first, largest to the emptiest shard, the cuts then filling each
shard up to the target.  A group larger than a whole target can't be kept whole
at near-equal sizes: its rows are cut like any others.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.shared import few_or_shuffled, quoted, unused, with_replaced, written

#: The part of a shard's target from which a group of equal texts is placed by itself.
HEAVY = 0.005
#: Parts into which the rows of a group larger than a shard are spread.
PIECES = 1024


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more; a null has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _poured(fill: list[float], size: float) -> list[int]:
    """The shard of each piece of a group, dealt to the emptiest shards, each shard's pieces in a row."""
    shards = len(fill)
    counts = [0] * shards
    for _ in range(PIECES):
        to = min(range(shards), key=lambda k: (fill[k], k))
        counts[to] += 1
        fill[to] += size / PIECES
    return [k for k in range(shards) for _ in range(counts[k])]


def cuts(groups: DataFrame, shards: int) -> tuple[list[int], dict[int, int], dict[int, list[int]]]:
    """For groups (``hash``, ``size``): the last hash of all shards but the last one, the shard of each heavy group, and of each piece of larger ones.

    The driver sees the totals of the partitions, fewer than shards / HEAVY
    heavy groups and shards - 1 bounds.
    """
    ranged = written(groups.repartitionByRange("hash").withColumn("part", F.spark_partition_id()))
    total = ranged.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    heavy = ranged.filter(F.col("size") > HEAVY * target).orderBy(F.desc("size"), "hash").collect()
    fill, placed, spread = [0.0] * shards, {}, {}
    for r in heavy:
        if r["size"] > target:
            spread[r["hash"]] = _poured(fill, r["size"])
            continue
        to = min(range(shards), key=lambda k: (fill[k], k))
        if fill[to] + r["size"] <= target:  # else no shard has room for all of it: it is cut with the rest
            placed[r["hash"]] = to
            fill[to] += r["size"]
    light = ranged.filter(~F.col("hash").isin([*placed, *spread])) if placed or spread else ranged
    totals = {r["part"]: r["t"] for r in light.groupBy("part").agg(F.sum("size").alias("t")).collect()}
    before, run = {}, 0
    for part in sorted(totals):
        before[part] = run
        run += totals[part]
    ends, goal = [], 0.0
    for k in range(shards - 1):
        goal += target - fill[k]
        ends.append(goal)
    parts = sorted(before)
    bounds = [-(2**63)] * (shards - 1)
    wanted = {}
    for k, end in enumerate(ends):
        if parts and end > 0:
            wanted.setdefault(parts[max(0, bisect.bisect_left([before[p] for p in parts], end) - 1)], []).append(k)
    if wanted:
        running = F.sum("size").over(W.partitionBy("part").orderBy("hash"))
        near = light.filter(F.col("part").isin(list(wanted))).select("part", "hash", "size", running.alias("run"))
        asked = [F.max(F.when((F.col("part") == part) & (F.col("run") - F.col("size") / 2 <= ends[k] - before[part]), F.col("hash"))).alias(f"b{k}") for part, ks in wanted.items() for k in ks]
        found = near.agg(*asked).first()
        lowest = near.groupBy("part").agg(F.min("hash").alias("least")).collect()
        least = {r["part"]: r["least"] for r in lowest}
        for part, ks in wanted.items():
            for k in ks:
                bounds[k] = found[f"b{k}"] if found[f"b{k}"] is not None else least[part] - 1
    for k in range(1, shards - 1):
        bounds[k] = max(bounds[k], bounds[k - 1])
    return bounds, placed, spread


def shard(df: DataFrame, shards: int = 8, text: str = "text", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows with their ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard), texts included.

    The bytes of shards are near equal, equal texts share a shard (but for
    groups larger than a shard, which are spread).  Null texts count as empty and go with them;
    repeated rows have a slot each; input columns named like an output are
    replaced; an empty table gives an empty result.
    """
    held = {n: unused(df, f"__{n}") for n in ("hash", "shard", "part", "place", "base")}
    hashed = _hash(quoted(text).cast("string"))
    groups = df.select(hashed.alias("hash"), text_size(quoted(text)).alias("size")).groupBy("hash").agg(F.sum("size").alias("size"))
    bounds, placed, spread = cuts(groups, shards)
    by_range = F.lit(0)
    for b in bounds:
        by_range = by_range + (F.col(held["hash"]) > F.lit(b).cast("long")).cast("int")
    to = by_range
    if placed:
        heavy = F.create_map(*[x for h, k in placed.items() for x in (F.lit(h).cast("long"), F.lit(k))])
        to = F.coalesce(F.try_element_at(heavy, F.col(held["hash"])), by_range)
    for h, pieces in spread.items():
        piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PIECES)).cast("int")
        to = F.when(F.col(held["hash"]) == F.lit(h).cast("long"), F.get(F.array(*[F.lit(k) for k in pieces]), piece)).otherwise(to)
    kept = with_replaced(df, shard, slot)
    rows = df.select(*[quoted(c) for c in kept], hashed.alias(held["hash"])).withColumn(held["shard"], to).drop(held["hash"])
    fields = [*rows.schema.fields, T.StructField(held["place"], T.LongType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * shards
        for batch in batches:
            place = []
            for k in batch.column(held["shard"]).to_pylist():
                place.append(seen[k])
                seen[k] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[f.name for f in fields])

    numbered = written(rows.mapInArrow(number, T.StructType(fields)).withColumn(held["part"], F.spark_partition_id()))
    counts = written(numbered.groupBy(held["shard"], held["part"]).agg((F.max(held["place"]) + 1).alias("n")))
    earlier = W.partitionBy(held["shard"]).orderBy(held["part"]).rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(held["shard"], held["part"], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(held["base"]))
    joined = numbered.join(few_or_shuffled(base), [held["shard"], held["part"]])  # a row for each shard and partition
    return joined.select(*[quoted(c) for c in kept], F.col(held["shard"]).alias(shard), (F.col(held["base"]) + F.col(held["place"])).alias(slot))


def write_shards(df: DataFrame, folder: str, shard: str = "shard", slot: str = "slot") -> None:
    """Writes sharded rows as one folder of Parquet for each shard."""
    df.repartition(shard, (F.col(slot) / 1_000_000).cast("long")).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)


def crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, as an unsigned integer."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


