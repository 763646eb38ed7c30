"""Comparison of crowded values tile by tile, without a pair left out or written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shingles, and members, of a value that one tile should hold; two tiles meet in a task.
TILE_SHINGLES, TILE = 1 << 20, 4096


def merged_groups(known: DataFrame, items: DataFrame, prepared: Callable[[pd.DataFrame], tuple[Callable, Callable]]) -> DataFrame:
    """Distinct pairs (``a``, ``b``) of groups that hold similar members of one value.

    ``known``: (``band``, ``uid``, ``size``, ``group``), ``items``: (``uid``, ...) with what the
    comparison needs.  Only values whose members are in several groups are looked
    at.  The members of the largest group there, which need no comparison among
    themselves, are dealt to tiles of their own; any other two tiles of a value
    meet in one task, so that no pair is left out, however crowded a value is.
    ``prepared`` turns the rows of a task into ``screened(i, others)``, which of the
    others to look at, and ``same(i, j)``, which decides; members that are connected
    by then are passed over, so that links form a forest.
    """
    each = known.groupBy("band", "group").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    mixed = each.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("n", "group", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("groups > 1")
    tiles = lambda n, s: F.ceil(F.greatest(n / TILE, s / TILE_SHINGLES)).cast("int")
    whole = (F.col("n") <= TILE) & (F.col("s") <= TILE_SHINGLES)
    mains = F.when(whole, 0).otherwise(tiles(F.col("top.n"), F.col("top.s")))
    others = F.when(whole, 1).otherwise(tiles(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")))
    planned = mixed.select("band", F.col("top.group").alias("main"), mains.alias("mains"), others.alias("others"))
    members = known.join(planned, "band").withColumn("in_main", (F.col("group") == F.col("main")) & (F.col("mains") > 0))
    own = F.when(F.col("in_main"), F.pmod(F.xxhash64("uid"), F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(F.xxhash64("uid"), F.col("others"))).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(F.col("in_main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "group")
    names = ["band", "i", "j"]

    def compare(pdf: pd.DataFrame, found: list[tuple[int, int]]) -> None:
        group, tile, within = pdf["group"].to_numpy(), pdf["own"].to_numpy(), pdf["i"].iat[0] == pdf["j"].iat[0]
        label = group.copy()
        if (label == label[0]).all():
            return
        screened, same = prepared(pdf)
        for i in range(len(group) - 1):
            ask = label[i + 1 :] != label[i]
            if not within:
                ask &= tile[i + 1 :] != tile[i]
            for j in screened(i, np.flatnonzero(ask) + i + 1).tolist():
                if label[i] != label[j] and same(i, j):
                    found.append((min(group[i], group[j]), max(group[i], group[j])))
                    label[label == label[j]] = label[i]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            found: list[tuple[int, int]] = []
            keys = pdf[names].to_numpy()
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
            if held and (last != keys[0]).any():
                compare(pd.concat(held), found)
                held = []
            for a, b in zip(starts[:-2], starts[1:-1], strict=True):
                own = pdf.iloc[a:b]
                compare(pd.concat([*held, own]) if held else own, found)
                held = []
            held.append(pdf.iloc[starts[-2] :])
            last = keys[-1]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        if held:
            found = []
            compare(pd.concat(held), found)
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.join(items, "uid").repartition(*names).sortWithinPartitions(*names, "uid").mapInPandas(run, "a long, b long").distinct()
