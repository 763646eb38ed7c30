"""Near-duplicate vectors by a refined neighbour graph (NN-descent).

Equal vectors of a label are one class.  Neighbour lists start from random
hyperplane buckets, then neighbours of neighbours are compared and lists keep
the most similar, until a round adds hardly any.  Only neighbours within the
graph's FLOOR are kept, so lists are short where nothing is similar.

A list that is full of links is saturated: its vector may have more.  Links that
a bucket holds join components before lists are cut, and besides its nearest a
vector keeps the nearest of other components, so that pockets of near-equal
vectors go on looking for each other.  Saturated lists are enlarged to the whole
connected component of their vector, compared tile by tile, and only counts of
links leave a tile.  Recall is audited against brute force for a bounded set of
vectors; while it is too low, more buckets are added, and at last all vectors of
a label are compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.components import components
from stemma.llm.shared import quoted, written
from stemma.llm.topk import finite

SIMILARITY = 0.98
#: Neighbours are kept from this cosine.
FLOOR = 0.9
NEIGHBOURS = 16
#: Sets of hyperplanes, and vectors that a bucket should hold.
TABLES = 10
BUCKET = 24
ROUNDS = 4
#: Vectors of a component compared at once.
TILE = 512
#: Vectors whose links are counted by brute force, the recall they must show, and how often buckets are added.
AUDIT = 200
RECALL = 0.98
TRIES = 3


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, float) for v in vectors])
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _grouped(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the least row of its connected component."""
    label = np.arange(len(close))
    while True:
        near = np.minimum(label, np.where(close, label, len(close)).min(1))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _top(ids: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's most similar others within FLOOR, also among those it isn't connected with; with NaN, one it is connected with."""
    np.fill_diagonal(cosine, -2)
    k = min(NEIGHBOURS, len(ids) - 1)
    label = _grouped(cosine >= SIMILARITY)
    joined = np.flatnonzero(label != np.arange(len(ids)))
    found = [(ids[joined], ids[label[joined]], np.full(len(joined), np.nan))]
    for other in [cosine, np.where(label[:, None] == label[None, :], -2, cosine)] if len(joined) else [cosine]:
        near = np.argpartition(-other, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(other, near, 1)
        r, c = np.nonzero(value >= FLOOR)
        found.append((ids[r], ids[near[r, c]], value[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucketed(classes: DataFrame, bits: int, seed: int) -> DataFrame:
    """(``c``, ``other``, ``cosine``) between vectors of one bucket, in TABLES sets of buckets."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, own in pdf.groupby(pdf["v"].map(len)):
                rows = unit_rows(own["v"])
                for t in range(TABLES):
                    planes = np.random.default_rng([seed, t, size]).standard_normal((size, bits + 8))
                    side = rows @ planes > 0
                    code = side[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
                    finer = side[:, bits:] @ (1 << np.arange(8, dtype=np.int64))
                    yield pd.DataFrame({"g": own["g"], "size": np.int32(size), "t": np.int32(t), "code": code, "finer": finer, "c": own["c"], "v": own["v"]})

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def compare(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                if len(part) > 1:
                    rows = unit_rows(part["v"])
                    a, b, s = _top(part["c"].to_numpy(), rows @ rows.T)
                    yield pd.DataFrame({"c": a, "other": b, "cosine": s})

        names = ["g", "size", "t", "code"]
        for pdf in batches:
            pdf = pd.concat([*held, pdf], ignore_index=True)
            keys = pdf[names]
            new = (keys != keys.shift()).any(axis=1).to_numpy()
            starts = [*np.flatnonzero(new), len(pdf)]
            for a, b in zip(starts[:-2], starts[1:-1], strict=True):
                yield from compare(pdf.iloc[a:b])
            tail = pdf.iloc[starts[-2] :]
            whole = len(tail) // 256 * 256  # a long bucket goes on in parts, in order of its finer code
            yield from compare(tail.iloc[:whole])
            held = [tail.iloc[whole:]]
        if held:
            yield from compare(held[0])

    rows = classes.mapInPandas(hashed, "g long, size int, t int, code long, finer long, c long, v array<double>")
    dealt = rows.repartition("g", "size", "t", "code").sortWithinPartitions("g", "size", "t", "code", "finer", "c")
    return dealt.mapInPandas(paired, "c long, other long, cosine double")


def _grouped_links(links: DataFrame) -> DataFrame:
    """(``c``, ``component``) of the vectors that links (``c``, ``other``) connect."""
    return written(components(links.select("c", "other"), "c", "other").withColumnRenamed("node", "c"))


def _lists(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Both directions of all edges, each vector's NEIGHBOURS most similar in its component and as many in ``foreign`` ones."""
    both = edges.select("c", "other", "cosine").unionByName(edges.select(F.col("other").alias("c"), F.col("c").alias("other"), "cosine")).groupBy("c", "other").agg(F.max("cosine").alias("cosine"))
    placed = both.join(labels.withColumnRenamed("component", "own"), "c", "left").join(labels.select(F.col("c").alias("other"), F.col("component").alias("far")), "other", "left")
    placed = placed.withColumn("foreign", F.coalesce("own", "c") != F.coalesce("far", "other"))
    rank = F.row_number().over(W.partitionBy("c", "foreign").orderBy(F.desc("cosine"), "other"))
    return placed.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS).select("c", "other", "cosine", "foreign")


def _cosine(a: str, b: str) -> Column:
    """Of two array columns of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))).otherwise(0.0)


def _descended(classes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists after comparing neighbours of neighbours, round by round, and all links (``c``, ``other``) seen."""
    is_link = F.isnan("cosine") | (F.col("cosine") >= SIMILARITY)
    links, known = edges.filter(is_link).select("c", "other"), edges.filter(~F.isnan("cosine"))
    labels = _grouped_links(links)
    lists = written(_lists(known, labels))
    vectors = classes.select("c", "v")
    for _ in range(ROUNDS):
        full = lists.groupBy("c").agg((F.count_if(~F.col("foreign") & (F.col("cosine") >= SIMILARITY)) >= NEIGHBOURS).alias("full"))
        open_ = lists.join(full, "c").filter(~F.col("full") | F.col("foreign"))  # in their component saturated ones are enlarged later
        far = lists.select(F.col("c").alias("other"), F.col("other").alias("beyond"))
        pairs = open_.join(far, "other").filter("c <> beyond").select("c", F.col("beyond").alias("other"), "full").distinct()
        pairs = pairs.join(lists.select("c", "other"), ["c", "other"], "left_anti")
        placed = pairs.join(labels.withColumnRenamed("component", "own"), "c", "left").join(labels.select(F.col("c").alias("other"), F.col("component").alias("far")), "other", "left")
        pairs = placed.filter(~F.col("full") | (F.coalesce("own", "c") != F.coalesce("far", "other"))).select("c", "other")
        scored = pairs.join(vectors, "c").join(vectors.select(F.col("c").alias("other"), F.col("v").alias("w")), "other")
        found = written(scored.select("c", "other", _cosine("v", "w").alias("cosine")).filter(F.col("cosine") >= FLOOR))
        if found.count() == 0:
            break
        before = lists
        links = links.unionByName(found.filter(F.col("cosine") >= SIMILARITY).select("c", "other"))
        lists = written(_lists(before.select("c", "other", "cosine").unionByName(found), labels))
        if lists.join(before, ["c", "other"], "left_anti").count() * 1000 < lists.count():
            break
    return lists, links


def _tiles(classes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``c``, ``links``): weights of all others of a component within SIMILARITY, counted tile by tile; and (``c``, ``other``) that connect them."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = classes.join(members, "c").join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))

    def packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(pdf["v"])
        return pd.DataFrame({"component": [key[0]], "tile": [key[1]], "tiles": [int(pdf["tiles"].iloc[0])], "ids": [pdf["c"].to_numpy().tobytes()], "n": [pdf["n"].to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()]})

    tiles = written(own.groupBy("component", "tile").applyInPandas(packed, "component long, tile int, tiles int, ids binary, n binary, rows binary"))
    left = tiles.select("component", F.col("ids").alias("a_ids"), F.col("rows").alias("a_rows"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a_ids, b_ids, n = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.n, np.int64)
                close = np.frombuffer(r.a_rows).reshape(len(a_ids), -1) @ np.frombuffer(r.rows).reshape(len(b_ids), -1).T >= SIMILARITY
                close[a_ids[:, None] == b_ids[None, :]] = False
                yield pd.DataFrame({"c": a_ids, "links": close @ n})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.concatenate([np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.ids, np.int64)])
                a = len(r.a_ids) // 8
                rows = np.concatenate([np.frombuffer(r.a_rows).reshape(a, -1), np.frombuffer(r.rows).reshape(len(ids) - a, -1)])
                label = _grouped(rows @ rows.T >= SIMILARITY)
                at = np.flatnonzero(ids != ids[label])
                yield pd.DataFrame({"c": ids[at], "other": ids[label[at]]})

    pairs = left.join(tiles.drop("tiles"), ["component", "tile"])
    return pairs.mapInPandas(counted, "c long, links long").groupBy("c").agg(F.sum("links").alias("links")), pairs.mapInPandas(joined, "c long, other long").distinct()


def _linked(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``c``, ``links``, ``component``) of all classes that have links, from the edges found."""
    lists, links = _descended(classes, edges)
    close = lists.filter(F.col("cosine") >= SIMILARITY)
    both = written(close.select("c", "other").unionByName(close.select(F.col("other").alias("c"), F.col("c").alias("other"))).distinct())
    labels = _grouped_links(links.unionByName(both))
    full = close.groupBy("c").count().filter(F.col("count") >= NEIGHBOURS).select("c")
    grown = written(labels.join(full, "c").select("component").distinct())
    by_tiles, _ = _tiles(classes, written(labels.join(grown, "component", "left_semi")))
    by_lists = both.join(labels.join(grown, "component", "left_anti"), "c").join(classes.select(F.col("c").alias("other"), "n"), "other").groupBy("c").agg(F.sum("n").alias("links"))
    return written(by_tiles.unionByName(by_lists).join(labels, "c"))


def _exact(classes: DataFrame) -> DataFrame:
    """What ``_linked`` gives, with all vectors of a label and length compared."""
    counts, joined = _tiles(classes, classes.select("c", F.xxhash64("g", F.size("v")).alias("component")))
    return written(counts.filter("links > 0").join(_grouped_links(written(joined)), "c"))


def audited(classes: DataFrame, linked: DataFrame) -> float:
    """Links found by brute force for AUDIT vectors (those with the least hash) that ``linked`` counts, as a share."""
    sample = classes.orderBy(F.xxhash64("c", "v"), "c").limit(AUDIT // 2).unionByName(classes.join(linked.select("c"), "c", "left_semi").orderBy(F.xxhash64("c"), "c").limit(AUDIT // 2)).dropDuplicates(["c"])
    asked = sample.toPandas()
    if not len(asked):
        return 1.0
    groups = [(g, size, own["c"].to_numpy(), unit_rows(own["v"])) for (g, size), own in asked.groupby([asked["g"], asked["v"].map(len)])]
    shared = classes.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (g, size), own in pdf.groupby([pdf["g"], pdf["v"].map(len)]):
                for h, s, ids, rows in shared.value:
                    if (g, size) == (h, s):
                        close = rows @ unit_rows(own["v"]).T >= SIMILARITY
                        close[ids[:, None] == own["c"].to_numpy()[None, :]] = False
                        yield pd.DataFrame({"c": ids, "true": close @ own["n"].to_numpy(np.int64)})

    truth = classes.mapInPandas(count, "c long, true long").groupBy("c").agg(F.sum("true").alias("true"))
    got = truth.join(linked, "c", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("links", F.lit(0))).alias("found")).first()
    return (got["found"] or 0) / got["true"] if got["true"] else 1.0


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``), one row for each row.

    Rows are linked if their labels are equal and not null and their vectors'
    cosine is at least 0.98.  ``n_links`` counts other rows linked directly,
    ``component_id`` is the least key reachable, the row's own included, and
    ``kept`` tells whether that is the row's own.  A row with a null label, or
    a vector that is null, empty, zero or holds null or non-finite components,
    has no links; vectors of different lengths don't link; rows that repeat,
    with their key or without, are rows of their own and link to each other.
    A null key names no component.  Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = df.select(quoted(key).cast("long").alias("vec_id"), quoted(vector).cast("array<double>").alias("v"), quoted(label).cast("string").alias("l"))
    good = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("l").isNotNull()
    rows = written(rows.withColumn("good", F.coalesce(good, F.lit(False))))
    usable = rows.filter("good").select("vec_id", "l", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = usable.groupBy("l", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("c", F.monotonically_increasing_id()).withColumn("g", F.xxhash64("l"))
    classes = written(classes)
    most = classes.groupBy("g").count().agg(F.max("count")).first()[0] or 1
    bits = int(np.clip(np.ceil(np.log2(max(most, 1) / BUCKET)), 1, 40))
    edges, linked = None, None
    for turn in range(TRIES):
        new = written(_bucketed(classes, bits, turn))
        edges = new if edges is None else edges.unionByName(new)
        linked = _linked(classes, edges)
        if audited(classes, linked) >= RECALL:
            break
    else:
        linked = _exact(classes)
    named = classes.join(linked, "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = written(named.select("l", "v", "n", "least", "component", F.coalesce("links", F.lit(0)).alias("links")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("l", "v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    found = usable.join(of, ["l", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
